"""A history of accepted records that new batches are checked against (problem 6): stored graph shards.

``History.add_batch`` takes one batch: it sketches the batch's rows only, searches the stored graphs with them,
verifies what they return on stored shingle sets, matches keys and equal sets by joins, and stores the accepted rows
as a new shard. ``History.compact`` is a step of its own, to be run on a schedule: it merges every ``FAN_IN`` shards
of a level into one of the next, from what the shards hold, so a batch meets a number of shards that grows with the
logarithm of the number of batches. Nothing of earlier batches is sketched or shingled again.

Each batch is stored under its name, rows last, so a batch that was interrupted is simply added again, and one added
twice is recorded once. Batches must come in the order of their names.

Defined results are those of ``batch_dedup``: null keys match nothing; null, blank and short texts match by key only;
rows without an id take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import shingling
from inkstone.llm.batch_dedup import _SKETCHED, FAN_IN, GRAPH_NODES, _build, _sketched, search_graphs
from inkstone.llm.graph_index import Graph
from inkstone.llm.near_duplicates import signed_members, verify
from inkstone.session import materialize

_GRAPHS = "graph string, payload binary"
_ROWS = "id bigint, k string, cid bigint, s1 bigint, s2 bigint"
_SETS = "cid bigint, n int, sh array<bigint>"


def _nodes(table: pa.Table) -> pa.Table:
    """The nodes that stored graphs hold, as they were put in."""
    graphs = [Graph.loads(p.as_py()) for p in table["payload"]]
    vec = [(g.vectors * 127).round().astype(np.int8) for g in graphs]
    return pa.table(
        {
            "cid": pa.array(np.concatenate([g.ids for g in graphs]), pa.int64()),
            "vec": pa.array([v.tobytes() for part in vec for v in part], pa.binary()),
            "mh": pa.array([h.tobytes() for g in graphs for h in g.hashes], pa.binary()),
        }
    )


class History:
    """Accepted rows, their shingle sets and their graphs under one folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # Folders ---------------------------------------------------------------------------------------

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _names(self, relation: str) -> list[str]:
        """Complete folders of a relation."""
        fs, target = self._fs(f"{self.root}/{relation}")
        if not fs.exists(target):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(target)]
        done = lambda n: fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{relation}/{n}/_SUCCESS"))
        return sorted(n for n in names if done(n))

    def _read(self, relation: str, schema: str, but: str | None = None) -> DataFrame:
        names = [n for n in self._names(relation) if n != but]
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{relation}/{n}" for n in names])

    def _write(self, df: DataFrame, relation: str, name: str) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{relation}/{name}")

    def _drop(self, relation: str, name: str) -> None:
        fs, target = self._fs(f"{self.root}/{relation}/{name}")
        fs.delete(target, True)

    def _shards(self) -> list[str]:
        """Live shards: those of which no merged shard holds the batches. A name is level-first-last."""
        names = self._names("shards")
        spans = {n: tuple(n.split("~")[1:]) for n in names}
        level = {n: int(n.split("~")[0]) for n in names}
        inside = lambda n, m: level[m] > level[n] and spans[m][0] <= spans[n][0] and spans[n][1] <= spans[m][1]
        return [n for n in names if not any(inside(n, m) for m in names)]

    # Batches ---------------------------------------------------------------------------------------

    def add_batch(self, name: str, rows: DataFrame, id_col: str, key: Column, words: Column, threshold: float = 0.5) -> DataFrame:
        """(id_a < id_b): each duplicate row of the batch with each accepted earlier row that it matches."""
        ids = F.col(id_col).cast("bigint").alias("id")
        given = rows.select(ids, key.alias("k"), words.alias("w")).where("id is not null")
        signed = materialize(given.select("id", "w").where("w is not null").mapInArrow(_sketched, _SKETCHED), "signed")
        members, heads = signed_members(signed.select("id", "s1", "s2"))
        one = signed.groupBy("id").agg(F.min(F.struct("s1", "s2", "vec", "mh")).alias("s")).select("id", "s.*")
        placed = materialize(given.groupBy("id").agg(F.min("k").alias("k")).join(members, "id", "left").join(one.select("id", "s1", "s2"), "id", "left"), "placed")
        nodes = materialize(one.join(heads.select("id"), "id", "left_semi").select(F.col("id").alias("cid"), "vec", "mh"), "nodes")
        sets = given.where("w is not null").select("id", F.lit(0).cast("bigint").alias("seed"), "w").mapInArrow(shingling.shingled_batches(3), shingling.SHINGLED)
        sets = materialize(sets.join(heads, ["id", "s1", "s2"], "left_semi").dropDuplicates(["id"]).select(F.col("id").alias("cid"), "n", "sh"), "sets")

        old = self._read("rows", _ROWS, but=f"batch={name}")
        pairs = self._near(name, nodes, sets, threshold)
        by_key = placed.where("k is not null").select("k", F.col("id").alias("b")).join(old.where("k is not null").select("k", F.col("id").alias("a")), "k").select("a", "b")
        equal = placed.where("s1 is not null").select("s1", "s2", F.col("id").alias("b")).join(old.where("s1 is not null").select("s1", "s2", F.col("id").alias("a")), ["s1", "s2"]).select("a", "b")
        close = pairs.join(placed.select(F.col("cid").alias("q"), F.col("id").alias("b")), "q").join(old.select(F.col("cid").alias("x"), F.col("id").alias("a")), "x").select("a", "b")
        found = materialize(by_key.unionByName(equal).unionByName(close).distinct(), "found")

        fresh = materialize(placed.join(found.select(F.col("b").alias("id")).distinct(), "id", "left_anti"), "fresh")
        # The representative of a class is the least of its accepted rows; classes are accepted or not as a whole but for keys.
        heads_of = fresh.where("cid is not null").groupBy("cid").agg(F.min("id").alias("head"))
        kept = fresh.join(heads_of, "cid", "left").select("id", "k", F.col("head").alias("cid"), "s1", "s2")
        renamed = lambda df: df.join(heads_of, "cid").drop("cid").withColumnRenamed("head", "cid")
        self._write(renamed(sets).select("cid", "n", "sh"), "sets", f"batch={name}")
        self._store_shard(renamed(nodes).select("cid", "vec", "mh"), f"0~{name}~{name}")
        self._write(kept, "rows", f"batch={name}")
        return found.select(F.least("a", "b").alias(f"{id_col}_a"), F.greatest("a", "b").alias(f"{id_col}_b"))

    def _near(self, name: str, nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
        """(q, x): classes of the batch and of the history that reach the threshold."""
        shards = [s for s in self._shards() if s.split("~")[2] < name]
        if not shards:
            return self.spark.createDataFrame([], "q bigint, x bigint")
        graphs = self.spark.read.schema(_GRAPHS).parquet(*[f"{self.root}/shards/{s}" for s in shards])
        # One row per stored graph, each of which is asked every node of the batch.
        names = [r["graph"] for r in graphs.select("graph").collect()]
        asked = nodes.select(F.lit(0).alias("asker"), "cid", "vec", "mh")
        candidates = materialize(search_graphs(asked, graphs, {0: names}, {0: nodes.count()}), "candidates")
        stored = self._read("sets", _SETS, but=f"batch={name}").join(candidates.select(F.explode(F.array("cid_a", "cid_b")).alias("cid")).distinct(), "cid", "left_semi")
        mine = sets.select(F.col("cid"), "n", "sh")
        good = verify(candidates, stored.unionByName(mine), threshold).select("cid_a", "cid_b")
        own = nodes.select(F.col("cid").alias("q"))
        first = good.join(own, good["cid_a"] == own["q"]).select("q", F.col("cid_b").alias("x"))
        second = good.join(own, good["cid_b"] == own["q"]).select("q", F.col("cid_a").alias("x"))
        return materialize(first.unionByName(second).join(nodes.select(F.col("cid").alias("x")), "x", "left_anti"), "near")

    def _store_shard(self, nodes: DataFrame, shard: str) -> None:
        nodes = materialize(nodes, "shard")
        parts = max(1, -(-nodes.count() // GRAPH_NODES))
        graph = F.concat(F.lit(f"{shard}/"), F.pmod(F.xxhash64("cid"), F.lit(parts)))
        built = nodes.select(graph.alias("graph"), "cid", "vec", "mh").repartition(parts, "graph").groupBy("graph").applyInArrow(_build, _GRAPHS)
        self._write(built, "shards", shard)

    def compact(self) -> list[str]:
        """Merges every ``FAN_IN`` successive shards of a level, lowest level first; returns the new shards."""
        made = []
        level = 0
        while True:
            live = [s for s in self._shards() if int(s.split("~")[0]) == level]
            for at in range(0, len(live) - len(live) % FAN_IN, FAN_IN):
                group = live[at : at + FAN_IN]
                shard = f"{level + 1}~{group[0].split('~')[1]}~{group[-1].split('~')[2]}"
                graphs = self.spark.read.schema(_GRAPHS).parquet(*[f"{self.root}/shards/{s}" for s in group])
                self._store_shard(graphs.groupBy("graph").applyInArrow(_nodes, "cid bigint, vec binary, mh binary"), shard)
                for s in group:
                    self._drop("shards", s)
                made.append(shard)
            if not any(int(s.split("~")[0]) > level for s in self._shards()):
                return made
            level += 1


