"""Reading tables, cutting lineage and spreading work; shared by every operator."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    A folder of our own is used only where that is unset and the executors are threads of this process: on a
    cluster, each would write to its own disk and reads would come back incomplete.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    return f"file://{tempfile.gettempdir()}/inkstone-shared"


def _forget() -> None:
    for spark, path in _scratch:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may be gone; the folder is the cluster's to clean
            pass


atexit.register(_forget)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark).rstrip('/')}/inkstone/{label}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def materialize(df: DataFrame, label: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    Readers take many rows of a file at once, so very large rows go into files of ``rows_per_file``.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, factor: int = 3) -> DataFrame:
    """Repartition inputs of few splits before CPU-heavy stages; leaves well-split inputs alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * factor)
