"""Frequency of every distinct value or term (problem 1): recursive radix spilling.

Records become (field, term, occurrences, records) rows, pre-aggregated inside each task before anything
moves. The rows are then partitioned by the leading bits of a term hash into the shared folder. Radix
partitions above a row limit are split by further hash bits, again and again, until each fits or holds a
single term (whose rows are about one per task). Each leaf is read from its folder, without another shuffle,
by a DuckDB instance of its own with a fixed memory limit, so the size of the vocabulary is bounded by disk only.

Defined results: null and blank values are no records; a text without words is a record without terms;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.session import materialize, scratch_path

RADIX_BITS = 4
LEAF_ROWS = 2_000_000
DUCKDB_MEMORY = "300MB"
#: Rows a task holds before it sums them up.
HELD_ROWS = 400_000
_COUNTED = "field_name string, term string, occurrences bigint, records bigint"
_SPILLED = "field_name string, term string, occurrences bigint, records bigint, h bigint"


def _summed(parts: list[pa.RecordBatch | pa.Table]) -> pa.Table:
    """Counts of equal terms added up, within a task."""
    table = pa.concat_tables([pa.Table.from_batches([p]) if isinstance(p, pa.RecordBatch) else p for p in parts])
    out = table.group_by(["field_name", "term"]).aggregate([("occurrences", "sum"), ("records", "sum")])
    return out.rename_columns([c.removesuffix("_sum") for c in out.column_names]).select(["field_name", "term", "occurrences", "records"])


def _count_batch(words: pa.ListArray, field_name: str) -> pa.RecordBatch:
    flat = words.flatten().dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    vocabulary = len(flat.dictionary)
    record = np.repeat(np.arange(len(words), dtype=np.int64), lengths)
    occurrences = np.bincount(codes, minlength=vocabulary)
    records = np.bincount(np.unique(record * max(vocabulary, 1) + codes) % max(vocabulary, 1), minlength=vocabulary)[:vocabulary]
    # The row without a term carries the number of records, which the marks are taken against.
    terms = pa.concat_arrays([flat.dictionary.cast(pa.string()), pa.array([None], pa.string())])
    return pa.record_batch(
        {
            "field_name": pa.array([field_name] * len(terms), pa.string()),
            "term": terms,
            "occurrences": pa.array(np.append(occurrences, len(codes)), pa.int64()),
            "records": pa.array(np.append(records, len(words)), pa.int64()),
        }
    )


def partial_counts(records: DataFrame, field_name: str, terms: Column, held_rows: int = HELD_ROWS) -> DataFrame:
    """Counts of each task's records, whose terms are an array; plus one row without a term.

    A task adds its batches up as it goes and gives what it holds only when distinct terms alone fill the limit, so a
    term costs a task one row (and one more for every ``held_rows`` distinct terms), however often it occurs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch | pa.Table] = []
        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(_count_batch(batch.column(0), field_name))
                rows += held[-1].num_rows
            if rows > held_rows:
                held = [_summed(held)]
                rows = held[0].num_rows
                if rows > held_rows // 2:
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if held:
            yield from _summed(held).to_batches()

    return records.select(F.coalesce(terms, F.array().cast("array<string>")).alias("terms")).mapInArrow(run, _COUNTED)


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as readers outside Spark know it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def _aggregate_leaves(memory: str):
    """For mapInArrow over rows (folder): each folder is one leaf, read where it lies and aggregated by a DuckDB of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        from pyarrow import dataset, fs

        for folder in (f for batch in batches for f in batch.column(0).to_pylist()):
            system, at = fs.FileSystem.from_uri(folder)
            part = dataset.dataset(at, filesystem=system, format="parquet", schema=pa.schema([("field_name", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())]))  # noqa: F841 - read by name below
            # Leaves fit the memory; should one spill after all, it does so in the shared folder or not at all.
            spill = f"{at}-duckdb" if folder.startswith("file:") else ""
            with duckdb.connect(config={"threads": 1, "memory_limit": memory, "preserve_insertion_order": False, "temp_directory": spill}) as db:
                yield from db.sql(
                    "SELECT field_name, term, CAST(sum(occurrences) AS BIGINT) AS occurrences, CAST(sum(records) AS BIGINT) AS records FROM part GROUP BY field_name, term"
                ).to_arrow_reader(50_000)

    return run


def count_terms(parts: DataFrame, bits: int = RADIX_BITS, leaf_rows: int = LEAF_ROWS, memory: str = DUCKDB_MEMORY) -> DataFrame:
    """Total (occurrences, records) of every (field_name, term) over partial counts."""
    spark = parts.sparkSession
    pending: DataFrame | None = parts.select("field_name", "term", "occurrences", "records", F.xxhash64("field_name", "term").alias("h"))
    # Writers of a level: enough to keep every core busy, whatever their number.
    writers = max(2, -(-spark.sparkContext.defaultParallelism // (1 << bits)))
    leaves: list[str] = []
    level, shift, prefix = 0, 64, F.lit("")
    while pending is not None:
        shift -= bits
        path = scratch_path(spark, f"radix-{level}")
        radix = F.shiftrightunsigned("h", shift).bitwiseAND((1 << bits) - 1).cast("int") if shift > 0 else F.lit(0)
        spill = pending.withColumn("leaf", F.concat(prefix, F.lpad(F.hex(radix.cast("bigint")), 1, "0")))
        spill.repartition("leaf", F.pmod(F.hash("term"), F.lit(writers))).write.partitionBy("leaf").option("compression", "zstd").parquet(path)
        back = spark.read.schema(f"{_SPILLED}, leaf string").parquet(path)
        sizes = {r["leaf"]: (r["n"], r["hs"]) for r in back.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), (F.max("h") > F.min("h")).alias("hs")).collect()}
        large = {k for k, (n, several) in sizes.items() if n > leaf_rows and several and shift - bits > 0}
        home = _qualified(spark, path)
        leaves += [f"{home}/leaf={k}" for k in sorted(sizes) if k not in large]
        pending = back.where(F.col("leaf").isin(*large)).withColumnRenamed("leaf", "above") if large else None
        prefix = F.col("above")
        level += 1
    if not leaves:
        return spark.createDataFrame([], _COUNTED)
    # One row per folder: the folders number the rows over the row limit, or the radix of one level.
    folders = spark.createDataFrame([(f,) for f in leaves], "folder string").repartition(len(leaves), "folder")
    return folders.mapInArrow(_aggregate_leaves(memory), _COUNTED)


def marked_terms(parts: DataFrame, rare: Column, common: Column) -> DataFrame:
    """(field_name, term, occurrences, records, total_records, mark) of every term; mark may be null.

    ``rare`` and ``common`` are conditions over field_name, records and total_records.
    """
    counted = materialize(count_terms(parts), "terms")
    totals = counted.where("term is null").select("field_name", F.col("records").alias("total_records"))
    # One row per field counted, so the broadcast does not grow with the data.
    return (
        counted.where("term is not null")
        .join(F.broadcast(totals), "field_name")
        .withColumn("mark", F.when(rare, "rare").when(common, "common"))
        .select("field_name", "term", "occurrences", "records", "total_records", "mark")
    )
