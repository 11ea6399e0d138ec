"""Score cutoffs that keep a target fraction per group (problem 4): sketch-bracketed exact selection.

A quantile sketch with a guaranteed rank error gives each group bounds that bracket its cutoff. One
pass counts the records above the bracket; only bracketed records are sorted, pre-aggregated by value,
so ties of any size are one row. A group whose bracket misses, which the counts would show, is selected
over its whole range instead, so the result is exact in any case.

Defined results: records with null, NaN or out-of-range scores are left out; a group without records
gives no row; a group without a target gives no row; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 2000


def latest_records(rows: DataFrame, key: str, at: str, columns: dict[str, Column]) -> DataFrame:
    """The columns of the row with the latest ``at`` per key; partial aggregation runs before the shuffle."""
    packed = F.struct(*[c.alias(name) for name, c in columns.items()])
    return rows.groupBy(F.col(key)).agg(F.max_by(packed, F.col(at)).alias("r")).select(key, "r.*")


def fraction_cutoffs(records: DataFrame, group: list[str], score: str, percent: str, accuracy: int = ACCURACY) -> DataFrame:
    """(group..., cutoff, kept): largest score at or above which lie at least ``percent`` % of the group."""
    inner = [f"_group{i}" for i in range(len(group))]
    renamed = records.select(*[F.col(c).alias(g) for c, g in zip(group, inner)], F.col(score).alias("_score"), F.col(percent).alias("_percent"))
    found = _select(renamed, inner, "_score", "_percent", accuracy)
    return found.select(*[F.col(g).alias(c) for c, g in zip(group, inner)], "cutoff", "kept")


def _select(records: DataFrame, group: list[str], score: str, percent: str, accuracy: int) -> DataFrame:
    by = [F.col(c) for c in group]
    eps = 1.0 / accuracy
    ratio = 1 - F.col("percent") / 100.0
    sketch = records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(percent).alias("percent"),
        F.percentile_approx(score, F.array(*[F.lit(i / 200) for i in range(201)]), F.lit(accuracy)).alias("q"),
    )
    # The cutoff is the k-th largest; q holds every half percent with a rank error of at most eps n.
    bounds = sketch.select(
        *by,
        "n",
        F.ceil(F.col("percent") * F.col("n") / 100.0 - F.lit(1e-9)).alias("k"),
        F.get("q", F.greatest(F.floor((ratio - 2 * eps) * 200), F.lit(0)).cast("int")).alias("lo"),
        F.get("q", F.least(F.ceil((ratio + 2 * eps) * 200) + 1, F.lit(200)).cast("int")).alias("hi"),
    )
    same = lambda a, b: [F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in group]
    r, b = records.alias("r"), bounds.alias("b")
    placed = r.join(b, same("r", "b")).select(*[F.col(f"r.{c}").alias(c) for c in group], F.col(f"r.{score}").alias("s"), "n", "k", "lo", "hi")
    counts = placed.groupBy(*by, "n", "k", "lo", "hi").agg(
        F.sum(F.when(F.col("s") > F.col("hi"), 1).otherwise(0)).alias("above"),
        F.sum(F.when(F.col("s") >= F.col("lo"), 1).otherwise(0)).alias("from_lo"),
    )
    missed = (F.col("above") >= F.col("k")) | (F.col("from_lo") < F.col("k"))
    safe = counts.select(
        *by, "k", F.when(missed, F.lit(None)).otherwise(F.col("lo")).alias("lo"), F.when(missed, F.lit(None)).otherwise(F.col("hi")).alias("hi"),
        F.when(missed, F.lit(0)).otherwise(F.col("above")).alias("above"),
    )
    s = safe.alias("s")
    inside = (
        records.alias("r")
        .join(s, same("r", "s"))
        .where(F.col("s.lo").isNull() | F.col(f"r.{score}").between(F.col("s.lo"), F.col("s.hi")))
        .groupBy(*[F.col(f"r.{c}").alias(c) for c in group], F.col(f"r.{score}").alias("v"), "k", "above")
        .agg(F.count(F.lit(1)).alias("ties"))
    )
    down = Window.partitionBy(*group).orderBy(F.col("v").desc())
    return (
        inside.withColumn("kept", F.col("above") + F.sum("ties").over(down))
        .where("kept >= k and kept - ties < k")
        .select(*group, F.col("v").alias("cutoff"), "kept")
    )
