"""Arriving submissions: stateless scoring, windowed flag rates with late data, duplicates, and micro-batches against history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.operators import cohort, similarity
from inkstone.plans import pipeline
from inkstone.sources.store import Store


def score_stream(submissions: DataFrame, text_col: str = "prompt", with_models: bool = False) -> DataFrame:
    """Scoring keeps no state, so it runs on a stream as on a table."""
    df = pipeline.signalled(submissions, text_col)
    return pipeline.determined(pipeline.modelled(df) if with_models else df, with_models)


def flag_rates(scored: DataFrame, at: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, end, n, flagged) per event-time window; rows later than the watermark are left out."""
    flag = F.sum(cohort.is_flagged(F.col("determination")).cast("int"))
    grouped = scored.withWatermark(at, late).groupBy(F.window(at, window).alias("w")).agg(F.count(F.lit(1)).alias("n"), flag.alias("flagged"))
    return grouped.select("w.start", "w.end", "n", "flagged")


def without_repeats(submissions: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    return submissions.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def rolling_profiles(store: Store, features: list[str] = ()) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: records a micro-batch of scored submissions and brings the authors' profiles up to date.

    Safe to repeat: a batch is recorded under its number, and profiles are aggregates of what is recorded.
    """

    def run(batch: DataFrame, batch_number: int) -> None:
        store.record_batch("submissions", batch, f"stream_{batch_number:012d}")
        store.rebuild_profiles(features)

    return run


def against_history(store: Store, signature: str = "minhash") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: compares a micro-batch with all earlier ones, then appends it. Safe to repeat."""

    def run(batch: DataFrame, batch_number: int) -> None:
        name = f"stream_{batch_number:012d}"
        if store.holds("fingerprints"):
            history = store.read("fingerprints").where(F.col("batch_id") < name)
            found = similarity.cross_batch(batch, history, "task_id", "attempter", signature)
            found.withColumn("batch_id", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{store.root}/matches")
        store.record_batch("fingerprints", batch, name)

    return run
