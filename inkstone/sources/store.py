"""The memory of past batches: one parquet dataset per relation, partitioned by batch where it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.operators import cohort, memory

RELATIONS = ("submissions", "fingerprints", "confirmed", "baselines", "calibration", "profiles", "matches")


class Store:
    """Writes replace the batch they name and nothing else, so a repeated batch is recorded once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, relation: str) -> str:
        if relation not in RELATIONS:
            raise ValueError(f"no relation {relation}")
        return f"{self.root}/{relation}"

    def read(self, relation: str) -> DataFrame:
        return self.spark.read.parquet(self.path(relation))

    def holds(self, relation: str) -> bool:
        """Whether anything was written to a relation yet; a folder that cannot be looked at is an error."""
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(relation))
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def record_batch(self, relation: str, rows: DataFrame, batch_id: str) -> None:
        stamped = rows.withColumn("batch_id", F.lit(batch_id))
        stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(self.path(relation))

    def confirm(self, confirmations: DataFrame) -> None:
        """Appends confirmations with the verdict of the first submission of their task."""
        first = self.read("submissions").where("task_id is not null").groupBy("task_id").agg(F.min_by(F.struct("determination", "confidence"), "sub_id").alias("x"))
        enriched = confirmations.join(first, "task_id", "left").select(
            *confirmations.columns, F.col("x.determination").alias("pipeline_determination"), F.col("x.confidence").alias("pipeline_confidence")
        )
        enriched.write.mode("append").parquet(self.path("confirmed"))

    def snapshot(self, relation: str, name: str) -> str | None:
        """Copies a relation aside under a name; None if there is nothing to copy."""
        if not self.holds(relation):
            return None
        path = f"{self.root}/snapshots/{relation}-{name}"
        self.read(relation).write.mode("overwrite").parquet(path)
        return path

    def rebuild_calibration(self, name: str = "previous") -> DataFrame:
        """Quantiles of all submissions with a confirmed truth; the latest confirmation stands, the old table is kept aside."""
        self.snapshot("calibration", name)
        truth = cohort.latest(self.read("confirmed").select("task_id", "ground_truth", "verified_at"), "task_id", ["verified_at"])
        table = cohort.conformal_table(self.read("submissions").join(truth, "task_id"))
        table.write.mode("overwrite").parquet(self.path("calibration"))
        return self.read("calibration")

    def rebuild_profiles(self, features: list[str] = ()) -> DataFrame:
        """Profiles of all authors over everything recorded, so repeated and late batches change nothing twice."""
        confirmed = self.read("confirmed") if self.holds("confirmed") else self.spark.createDataFrame([], "attempter string, ground_truth string")
        memory.author_memory(self.read("submissions"), confirmed, list(features)).write.mode("overwrite").parquet(self.path("profiles"))
        return self.read("profiles")

    def rebuild_all(self, name: str = "previous", features: list[str] = ()) -> dict[str, DataFrame]:
        """Everything that is derived from the recorded batches, in order."""
        return {"calibration": self.rebuild_calibration(name), "profiles": self.rebuild_profiles(features)}

    def everything_of(self, attempter: str) -> DataFrame:
        """(relation, key): all that is recorded under a name."""
        keys = {r: k for r, k in (("submissions", "sub_id"), ("confirmed", "confirm_id"), ("fingerprints", "fp_id")) if self.holds(r)}
        return memory.history({r: self.read(r) for r in keys}, attempter, keys)

    def author_history(self, attempter: str) -> DataFrame:
        return self.read("submissions").where(F.trim("attempter") == attempter.strip()).orderBy(F.col("recorded_at").desc()).limit(5)
