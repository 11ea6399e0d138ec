"""Splits that keep related records together (problem 2): components by random-mate contraction.

Records are joined to the keys they share; the graph of keys is contracted by joins. Each round first
hooks every vertex of one edge into its only neighbour, then tosses a coin per vertex: tails with a heads
neighbour hook into the smallest such neighbour. Edges are relabelled, and the rounds go on until none is
left. The hooks of all rounds form trees, which are unwound by pointer jumping (as many joins as the
logarithm of the number of rounds). Components are then split by cumulative weight.

Every round is written to the shared folder; the driver sees only edge counts. Hooks are pre-aggregated
per task, so a vertex with a third of all edges costs no more than others; joins leave skew to AQE.
Vertices are 64-bit hashes: a collision can merge two groups, never tear one apart.

Defined results: a record without any key is a group of its own; null and blank keys link nothing.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkstone.llm.text_forms import _per_distinct, consistent_form
from inkstone.session import materialize

_NAME_WORD = re.compile(r"[^\W_]+")
#: Groups of one weight that are ranked together.
CELL_GROUPS = 200_000


def _name_key(name: str | None) -> str | None:
    """The name words in order, composed and case folded; null for a name without words."""
    if name is None:
        return None
    words = sorted(_NAME_WORD.findall(consistent_form(name).casefold()))
    return " ".join(words) or None


@F.arrow_udf(StringType())
def name_key(values: pa.Array) -> pa.Array:
    return _per_distinct(values, _name_key)


def mail_key(column: Column) -> Column:
    flat = F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))
    return F.when(flat != "", flat)


def vertex(kind: str, key: Column) -> Column:
    return F.when(key.isNotNull(), F.xxhash64(F.lit(kind), key))


def links(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (u < v) between the keys of each row: its first key present to each other one."""
    packed = rows.select(F.filter(F.array(*keys), lambda k: k.isNotNull()).alias("ks")).where("size(ks) > 1")
    ends = packed.select(F.get("ks", F.lit(0)).alias("x"), F.explode(F.slice("ks", 2, len(keys))).alias("y"))
    return ends.where("x != y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return edges.select(F.explode(ends).alias("e")).select("e.u", "e.v")


def _contract(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(hooks: child, parent, turn), (edges left) of one round."""
    sole = _both_ways(edges).groupBy("u").agg(F.count(F.lit(1)).alias("degree"), F.min("v").alias("v")).where("degree = 1")
    # Of an edge that stands alone, the larger end hooks into the smaller.
    alone = sole.select(F.col("u").alias("v"), F.col("v").alias("u"))
    leaves = materialize(sole.select("u", "v").join(alone.select("u", "v").where("u < v").select(F.col("u"), F.col("v")), ["u", "v"], "left_anti"), "leaves")
    hooks_l = leaves.select(F.col("u").alias("child"), F.col("v").alias("parent"))
    gone = leaves.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    inner = materialize(edges.join(gone, ["u", "v"], "left_anti"), "inner")
    heads = lambda c: F.pmod(F.xxhash64(F.lit(turn), F.col(c)), F.lit(2)) == 1
    mates = _both_ways(inner).where(~heads("u") & heads("v")).groupBy("u").agg(F.min("v").alias("parent"))
    mates = materialize(mates.withColumnRenamed("u", "child"), "mates")
    of_u = mates.select(F.col("child").alias("u"), F.col("parent").alias("pu"))
    of_v = mates.select(F.col("child").alias("v"), F.col("parent").alias("pv"))
    moved = inner.join(of_u, "u", "left").join(of_v, "v", "left").select(F.coalesce("pu", "u").alias("x"), F.coalesce("pv", "v").alias("y")).where("x != y")
    left = moved.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
    hooks = hooks_l.unionByName(mates.select("child", "parent")).withColumn("turn", F.lit(turn))
    return hooks, materialize(left, "edges")


def components(edges: DataFrame) -> DataFrame:
    """(vertex, label) of every vertex that hooked somewhere; a vertex not listed is its own label."""
    edges = materialize(edges, "edges")
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        round_hooks, edges = _contract(edges, len(hooks))
        hooks.append(round_hooks)
    if not hooks:
        return edges.select(F.col("u").alias("vertex"), F.col("v").alias("label"))
    at = materialize(reduce(DataFrame.unionByName, hooks).select(F.col("child").alias("vertex"), F.col("parent").alias("label")), "hooks")
    # A chain gains at most two hooks a round: a leaf's and its neighbour's.
    for _ in range((2 * len(hooks)).bit_length()):
        over = at.select(F.col("vertex").alias("label"), F.col("label").alias("beyond"))
        at = materialize(at.join(over, "label", "left").select("vertex", F.coalesce("beyond", "label").alias("label")), "labels")
    return at


def related_groups(records: DataFrame, id_col: str, keys: list[str], edges: DataFrame) -> DataFrame:
    """(id, group_id, group_size): group_id is the smallest id among the group's records."""
    label = components(edges)
    first_key = F.coalesce(*[F.col(k) for k in keys])
    keyed = records.groupBy(id_col).agg(F.min(first_key).alias("vertex"))
    placed = keyed.join(label, "vertex", "left").select(
        id_col, F.when(F.col("vertex").isNull(), F.struct(F.lit(1).alias("own"), F.col(id_col).cast("bigint").alias("g"))).otherwise(F.struct(F.lit(0).alias("own"), F.coalesce("label", "vertex").alias("g"))).alias("c")
    )
    placed = materialize(placed, "placed")
    totals = placed.groupBy("c").agg(F.min(id_col).alias("group_id"), F.count(F.lit(1)).alias("group_size"))
    return placed.join(totals, "c").select(id_col, "group_id", "group_size")


def assign_splits(groups: DataFrame, id_col: str, parts: dict[str, float]) -> DataFrame:
    """(id, group_id, split): groups fall to the splits by cumulative weight, heaviest first.

    Weights are summed per (weight, hash bucket) cell first. Light groups, the bulk of them, have as many cells as keep
    each below ``CELL_GROUPS`` groups; the window over the cells sees one row a cell, so it grows with the groups over
    ``CELL_GROUPS`` while the groups themselves are ranked cell by cell.
    """
    weights = materialize(groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("w")), "group-weights")
    # Distinct weights number at most the square root of twice the records.
    sizes = weights.groupBy("w").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CELL_GROUPS), F.lit(1)).alias("cells"))
    weights = weights.join(sizes, "w").select("group_id", "w", F.pmod(F.xxhash64("group_id"), F.col("cells")).alias("cell"))
    weights = materialize(weights, "weights")
    cells = weights.groupBy("w", "cell").agg(F.sum("w").alias("mass"))
    before = Window.orderBy(F.col("w").desc(), "cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("w", "cell", F.coalesce(F.sum("mass").over(before), F.lit(0)).alias("start"), F.sum("mass").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("w", "cell").orderBy("group_id")
    ranked = weights.withColumn("nth", F.row_number().over(inside) - 1).join(starts, ["w", "cell"])
    middle = (F.col("start") + F.col("nth") * F.col("w") + F.col("w") / 2) / F.col("total")
    names, shares = list(parts), list(parts.values())
    split = F.lit(names[-1])
    for i in range(len(names) - 2, -1, -1):
        split = F.when(middle <= sum(shares[: i + 1]), names[i]).otherwise(split)
    return groups.join(ranked.select("group_id", split.alias("split")), "group_id").select(id_col, "group_id", "split")
