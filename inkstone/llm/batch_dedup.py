"""Deduplicating new batches against all history (problem 6): graph index shards.

Each batch of accepted history is a segment with its own navigable small-world graph over sketches of
words and shingles; every ``FAN_IN`` neighbouring segments are compacted into one, and so on up, so a new
batch meets a number of graphs that grows with the logarithm of the number of batches, and a row is
indexed once per level. Graphs hold at most ``GRAPH_NODES`` nodes; larger segments are split by hash.
Beams are tuned against exhaustive search when a graph is built, and widened while their worst node still
reaches the threshold, so neighbours are never capped. Everything a search returns is reranked exactly on
the whole shingle sets. Equal shingle sets are one node, equal task keys are matched by joins, and neither
is ever expanded into pairs before it is known which rows are accepted.

Acceptance depends on earlier acceptance only; it is settled in rounds over groups (keys, classes and
their neighbours) by minima per group, which partial aggregation keeps free of skew.

Defined results: rows no batch names take no part; null, blank and short prompts match by key only; null
keys match nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import compute, fs, parquet
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm import shingling
from inkstone.llm.graph_index import Graph, sketch
from inkstone.llm.near_duplicates import signed_members, verify
from inkstone.session import materialize, spread

WIDTH = 64
HASHES = 16
FAN_IN = 4
GRAPH_NODES = 100_000
QUERY_ROWS = 16_384
#: Queries whose hits are held at once.
HELD_QUERIES = 2048
#: Tasks a core that search, and how often a query is sent at most so that there are as many.
SEARCHES, COPIES = 4, 4
#: Sketches less similar, or with fewer equal hashes, are no candidates. Of measured pairs at or above 0.5, none had
#: sketches below 0.75 or fewer than 5 equal hashes; at exactly 0.5, fewer than 4 of 16 are equal in 1 % of cases.
SKETCH_THRESHOLD = 0.68
AGREE = 4
_SKETCHED = "id bigint, s1 bigint, s2 bigint, vec binary, mh binary"


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, words or text) to (id, s1, s2, vec, mh): sketches of words and shingles, one byte a dimension, and hashes.

    Rows without shingles are dropped.
    """
    known = shingling.WordHashes()
    for batch in shingling.pieces(batches):
        n = batch.num_rows
        sizes, hashes = shingling.word_hashes(batch.column(1), known)
        word_sizes, words = shingling.distinct(np.repeat(np.arange(n), sizes), hashes, n)
        set_sizes, sets = shingling.distinct(*shingling.runs(sizes, hashes, 3), n)
        s1, s2 = shingling.signatures(set_sizes, sets)
        of = lambda sizes, values: sketch(values, np.repeat(np.arange(n), sizes), n, WIDTH)  # noqa: E731, B023
        both = np.round(np.hstack([of(word_sizes, words), of(set_sizes, sets)]) * (127 / np.sqrt(2))).astype(np.int8)
        least = shingling.minhashes(set_sizes, sets, HASHES)
        kept = np.flatnonzero(set_sizes > 0)
        yield pa.record_batch(
            [batch.column(0).take(pa.array(kept)), pa.array(s1[kept]), pa.array(s2[kept]), pa.array([both[i].tobytes() for i in kept], pa.binary()), pa.array([least[i].tobytes() for i in kept], pa.binary())],
            names=["id", "s1", "s2", "vec", "mh"],
        )


def _hashes(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype=np.uint32).reshape(len(packed), HASHES)


def _unit(vectors: list[bytes]) -> np.ndarray:
    out = np.frombuffer(b"".join(vectors), dtype=np.int8).reshape(len(vectors), 2 * WIDTH).astype(np.float32)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)
    return out


def segments_before(batch: int, fan_in: int = FAN_IN) -> list[tuple[int, int]]:
    """(level, number) of the compacted segments that make up the history before a batch."""
    out, level, end = [], 0, batch
    while end:
        first = end - end % fan_in
        out += [(level, k) for k in range(first, end)]
        end, level = first // fan_in, level + 1
    return out


def _graph_of(level: Column, number: Column, part: Column) -> Column:
    return F.concat_ws("/", level, number, part)


def neighbour_candidates(nodes: DataFrame, batches: int, graph_nodes: int = GRAPH_NODES) -> DataFrame:
    """(cid_a < cid_b): classes whose sketches are close, one of a batch before the other's last.

    ``nodes`` has cid, vec, mh, first and last (numbers of the first and last batch of the class's rows).
    """
    spark = nodes.sparkSession
    per_batch = {r["first"]: r["n"] for r in nodes.groupBy("first").agg(F.count(F.lit(1)).alias("n")).collect()}
    used = sorted({s for b in range(batches) for s in segments_before(b)})
    held = {(lv, k): sum(per_batch.get(b, 0) for b in range(k * FAN_IN**lv, (k + 1) * FAN_IN**lv)) for lv, k in used}
    parts = {s: max(1, -(-int(n * 1.05) // graph_nodes)) for s, n in held.items() if n}
    if not parts:
        return nodes.select(F.col("cid").alias("cid_a"), F.col("cid").alias("cid_b")).limit(0)
    # These tables have one row per segment and batch: they grow with the number of batches only.
    into = spark.createDataFrame([(b, lv, k, parts[lv, k]) for lv, k in parts for b in range(k * FAN_IN**lv, (k + 1) * FAN_IN**lv)], "first int, level int, number int, parts int")
    placed = nodes.join(F.broadcast(into), "first").select(
        _graph_of(F.col("level"), F.col("number"), F.pmod(F.xxhash64("cid"), F.col("parts"))).alias("graph"), "cid", "vec", "mh"
    )

    units = sum(parts.values())
    graphs = materialize(placed.repartition(units, "graph").groupBy("graph").applyInArrow(_build, "graph string, payload binary"), "graphs", rows_per_file=1)
    asks = {b: [f"{lv}/{k}/{p}" for lv, k in segments_before(b) for p in range(parts.get((lv, k), 0))] for b in range(batches)}
    # How many rows ask follows from the rows per batch, so the queries need not be written to be counted.
    per_last = {r["last"]: r["n"] for r in nodes.groupBy("last").agg(F.count(F.lit(1)).alias("n")).collect()}
    return search_graphs(nodes.select(F.col("last").alias("asker"), "cid", "vec", "mh"), graphs, asks, per_last)


def _build(table: pa.Table) -> pa.Table:
    graph = Graph.build(table["cid"].to_numpy(), _unit(table["vec"].to_pylist()), SKETCH_THRESHOLD, hashes=_hashes(table["mh"].to_pylist()))
    return pa.table({"graph": table["graph"].slice(0, 1), "payload": pa.array([graph.dumps()], pa.binary())})


def _stored(path: str, name: str) -> Graph:
    """A stored graph, read where it lies; files may hold several."""
    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_file(at) as file:
        for batch in parquet.ParquetFile(file).iter_batches(1, columns=["graph", "payload"]):
            if batch["graph"][0].as_py() == name:
                return Graph.loads(batch["payload"][0].as_buffer())
    raise FileNotFoundError(f"{name} in {path}")


def _searching(units: list[list[str]], paths: dict[str, str]):
    """For mapInArrow over queries (unit, cid, vec, mh): each partition is one unit, whose graphs are searched one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking = [b for b in batches if b.num_rows]
        for unit in sorted({u for b in asking for u in b["unit"].unique().to_pylist()}):
            own = [b.filter(compute.equal(b["unit"], unit)) for b in asking]
            ids, vectors, hashes = (np.concatenate(x) for x in zip(*[(b["cid"].to_numpy(), _unit(b["vec"].to_pylist()), _hashes(b["mh"].to_pylist())) for b in own]))
            for name in units[unit]:
                graph = _stored(paths[name], name)
                pa.default_memory_pool().release_unused()
                for at in range(0, len(ids), HELD_QUERIES):
                    part = slice(at, at + HELD_QUERIES)
                    q, x = graph.search(vectors[part], SKETCH_THRESHOLD, hashes[part], AGREE)
                    q = ids[part][q]
                    other = q != x
                    q, x = q[other], x[other]
                    yield pa.record_batch([pa.array(np.minimum(q, x), pa.int64()), pa.array(np.maximum(q, x), pa.int64())], names=["cid_a", "cid_b"])
                del graph

    return run


def search_graphs(asked: DataFrame, graphs: DataFrame, asks: dict[int, list[str]], rows_of: dict[int, int]) -> DataFrame:
    """(cid_a < cid_b) of queries (asker, cid, vec, mh) and the nodes close to them in stored graphs (graph, payload).

    ``asks`` names the graphs that an asker's queries go to, ``rows_of`` the number of its queries. Queries are cut into
    blocks, each of which is sent to one task, or a few where there are few blocks. Tasks read one graph after the other
    where it is stored: graphs are large and asked by many blocks, so they are neither shuffled nor held by the JVM.
    """
    spark = asked.sparkSession
    # One row per graph.
    paths = {r["graph"]: re.sub("^file:/+", "file:///", r["path"]) for r in graphs.select("graph", F.col("_metadata.file_path").alias("path")).collect()}
    share = sum(rows_of.get(a, 0) * len(names) for a, names in asks.items()) / (SEARCHES * spark.sparkContext.defaultParallelism)
    units: list[list[str]] = []
    plan = []
    for a, names in asks.items():
        n = rows_of.get(a, 0)
        if n and names:
            blocks = -(-n // QUERY_ROWS)
            copies = min(len(names), COPIES, math.ceil(n / blocks * len(names) / share))
            plan.append((a, len(units), blocks, copies))
            units += [names[c::copies] for _ in range(blocks) for c in range(copies)]
    if not units:
        return asked.select(F.col("cid").alias("cid_a"), F.col("cid").alias("cid_b")).limit(0)
    # One row per asker.
    placed = asked.join(F.broadcast(spark.createDataFrame(plan, "asker int, first int, blocks int, copies int")), "asker")
    start = F.col("first") + F.pmod(F.xxhash64("cid", F.lit(3)), F.col("blocks")).cast("int") * F.col("copies")
    sent = placed.select(F.explode(F.sequence(start, start + F.col("copies") - 1)).alias("unit"), "cid", "vec", "mh")
    return sent.repartitionById(len(units), "unit").mapInArrow(_searching(units, paths), "cid_a bigint, cid_b bigint").distinct()


def settle(rows: DataFrame, near: DataFrame) -> DataFrame:
    """Rows with ``state``: A accepted, D duplicate. rows: id, batch, k, cid; near: (c, d) both ways and c = c."""
    rows = materialize(rows.withColumn("state", F.lit("U")), "rows")
    while True:
        least = lambda state: F.min(F.when(F.col("state") == state, F.col("batch")))
        by_key = rows.where("k is not null").groupBy("k").agg(least("A").alias("ka"), least("U").alias("ku"))
        by_class = rows.where("cid is not null").groupBy("cid").agg(least("A").alias("ca"), least("U").alias("cu"))
        around = near.join(by_class.withColumnRenamed("cid", "d"), "d").groupBy("c").agg(F.min("ca").alias("na"), F.min("cu").alias("nu"))
        seen = rows.join(by_key, "k", "left").join(around.withColumnRenamed("c", "cid"), "cid", "left")
        before = lambda c: F.coalesce(F.col(c) < F.col("batch"), F.lit(False))
        state = (
            F.when(F.col("state") != "U", F.col("state"))
            .when(before("ka") | before("na"), "D")
            .when(before("ku") | before("nu"), "U")
            .otherwise("A")
        )
        rows = materialize(seen.select("id", "batch", "k", "cid", state.alias("state")), "rows")
        if rows.where("state = 'U'").isEmpty():
            return rows


def batch_duplicates(tasks: DataFrame, batches: DataFrame, id_col: str, key: Column, words: Column, batch_col: str, threshold: float = 0.5) -> DataFrame:
    """(id_a < id_b): each duplicate row with each accepted row of an earlier batch that it matches."""
    spark = tasks.sparkSession
    named = batches.groupBy(id_col).agg(F.min(batch_col).alias("name")).where("name is not null")
    # The names of the batches, not their rows.
    names = sorted(r[0] for r in named.select("name").distinct().collect())
    numbers = spark.createDataFrame([(n, i) for i, n in enumerate(names)] or [("", 0)], "name string, batch int")
    numbered = named.join(F.broadcast(numbers), "name").select(id_col, "batch")
    worded = spread(tasks.select(F.col(id_col).cast("bigint").alias("id"), words.alias("w")).where("id is not null and w is not null"))
    # Shingle sets are not kept: only signatures, sketches and hashes are, and the sets of candidates are made again.
    signed = materialize(worded.mapInArrow(_sketched, _SKETCHED), "signed")
    within = signed.join(numbered.select(F.col(id_col).alias("id")), "id", "left_semi")
    members, heads = signed_members(within.select("id", "s1", "s2"))
    placed = materialize(
        tasks.select(F.col(id_col).alias("id"), key.alias("k")).join(numbered.withColumnRenamed(id_col, "id"), "id").join(members, "id", "left"), "placed"
    )
    spans = placed.where("cid is not null").groupBy("cid").agg(F.min("batch").alias("first"), F.max("batch").alias("last"))
    sketched = signed.join(heads, ["id", "s1", "s2"], "left_semi").dropDuplicates(["id"]).select(F.col("id").alias("cid"), "vec", "mh")
    candidates = materialize(neighbour_candidates(materialize(sketched.join(spans, "cid"), "nodes"), len(names)), "candidates")
    wanted = candidates.select(F.explode(F.array("cid_a", "cid_b")).alias("id")).distinct()
    chosen = tasks.select(F.col(id_col).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("seed"), words.alias("w")).join(wanted, "id", "left_semi")
    # A row repeated under one id may hold several sets: the one that named the class is taken.
    sets = chosen.mapInArrow(shingling.shingled_batches(3), shingling.SHINGLED).join(heads, ["id", "s1", "s2"], "left_semi")
    sets = materialize(sets.dropDuplicates(["id"]).select(F.col("id").alias("cid"), "n", "sh"), "sets")
    pairs = materialize(verify(candidates, sets, threshold).select("cid_a", "cid_b"), "pairs")
    own = spans.where("first < last").select(F.col("cid").alias("c"), F.col("cid").alias("d"))
    both = F.array(F.struct(F.col("cid_a").alias("c"), F.col("cid_b").alias("d")), F.struct(F.col("cid_b").alias("c"), F.col("cid_a").alias("d")))
    near = pairs.select(F.explode(both).alias("e")).select("e.c", "e.d")
    # A class met in one batch only has no earlier member of its own, unless a neighbour brings it in.
    near = materialize(near.unionByName(own), "near")
    shared_keys = placed.where("k is not null").groupBy("k").agg(F.min("batch").alias("lo"), F.max("batch").alias("hi")).where("lo < hi").select("k", F.lit(True).alias("many"))
    linked = near.select(F.col("c").alias("cid")).distinct().withColumn("close", F.lit(True))
    involved = placed.join(shared_keys, "k", "left").join(linked, "cid", "left").where("many or close")
    settled = settle(involved.select("id", "batch", "k", "cid"), near)
    dup = settled.where("state = 'D'").select(F.col("id").alias("b"), F.col("batch").alias("tb"), "k", "cid")
    kept = settled.where("state = 'A'").select(F.col("id").alias("a"), F.col("batch").alias("ta"), "k", "cid")
    by_key = dup.join(kept.drop("cid"), "k").where("ta < tb").select("a", "b")
    by_text = dup.join(near.withColumnRenamed("c", "cid"), "cid").join(kept.select("a", "ta", F.col("cid").alias("d")), "d").where("ta < tb").select("a", "b")
    return by_key.unionByName(by_text).distinct().select(F.least("a", "b").alias(f"{id_col}_a"), F.greatest("a", "b").alias(f"{id_col}_b"))
