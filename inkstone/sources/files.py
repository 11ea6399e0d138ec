"""Readers of submission files: CSV, XLSX, PDF, JSON lines, and resolution of their columns."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

# The columns of a submission and the headers that may name them, best first.
COLUMNS = {
    "prompt": ("prompt",),
    "task_id": ("task_id", "id"),
    "occupation": ("occupation",),
    "attempter": ("attempter_name", "attempter"),
    "stage": ("pipeline_stage_name", "stage"),
    "attempter_email": ("attempter_email",),
    "reviewer": ("reviewer",),
    "reviewer_email": ("reviewer_email",),
}
LEAST_PROMPT = 50
SUBMISSION = StructType([StructField(c, StringType()) for c in COLUMNS])
LABELLED = StructType(
    [StructField(c, StringType()) for c in ("task_id", "ground_truth", "domain", "length_bin", "determination", "occupation", "attempter")]
    + [StructField("confidence", DoubleType()), StructField("word_count", IntegerType())]
)


def letter_index(spec: str) -> int | None:
    """Zero-based column of a letter (A, AB) or a one-based number; None if it is neither."""
    spec = spec.strip().upper()
    if spec.isdigit():
        return int(spec) - 1 if int(spec) > 0 else None
    if spec and len(spec) <= 2 and all(c in string.ascii_uppercase for c in spec):
        n = 0
        for c in spec:
            n = 26 * n + ord(c) - 64
        return n - 1
    return None


def resolve(columns: list[str], wanted: str | None, candidates: tuple[str, ...]) -> str | None:
    """A column by position, by exact header whatever its case, or by part of a header (never by the part ``id``)."""
    if wanted:
        at = letter_index(wanted)
        if at is not None and at < len(columns):
            return columns[at]
        candidates = (wanted, *candidates)
    lower = {c.lower().strip(): c for c in reversed(columns)}
    for name in candidates:
        if name.lower() in lower:
            return lower[name.lower()]
    for name in candidates:
        if name.lower() != "id":
            for c in columns:
                if name.lower() in c.lower():
                    return c
    return None


def as_submissions(df: DataFrame, wanted: dict[str, str] | None = None) -> DataFrame:
    """Rows with a prompt long enough, all columns as strings, missing ones empty."""
    found = {c: resolve(df.columns, (wanted or {}).get(c), names) for c, names in COLUMNS.items()}
    if not found["prompt"]:
        raise ValueError(f"no prompt column among {df.columns}")
    cols = [F.coalesce(F.col(f"`{src}`").cast("string"), F.lit("")).alias(c) if src else F.lit("").alias(c) for c, src in found.items()]
    return df.select(*cols).where(F.length("prompt") >= LEAST_PROMPT).withColumn("task_id", F.substring("task_id", 1, 20))


def read_csv(spark: SparkSession, path: str, wanted: dict[str, str] | None = None) -> DataFrame:
    """Quoted line breaks are kept together; values stay the text they are, so ``001`` is not 1."""
    return as_submissions(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path), wanted)


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None, wanted: dict[str, str] | None = None) -> DataFrame:
    """One workbook, read on the driver: a workbook holds at most 1,048,576 rows. Needs openpyxl."""
    try:
        import openpyxl  # noqa: F401
        import pandas as pd
    except ImportError as e:
        raise RuntimeError("reading workbooks needs openpyxl") from e
    book = pd.ExcelFile(path)
    # Sheets preferred in this order.
    preferred = [s for s in (sheet, "FullTaskX", "Full Task Connected", "Claim Sheet", "Sample List") if s in book.sheet_names]
    frame = book.parse(preferred[0] if preferred else book.sheet_names[0], dtype=str).fillna("")
    return as_submissions(spark.createDataFrame(frame), wanted).withColumn("prompt", F.trim("prompt"))


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """One row per page with enough text, files spread over tasks; a file without such pages is one row. Needs pypdf."""

    def pages(batches):
        import io

        import pandas as pd
        from pypdf import PdfReader

        for batch in batches:
            rows = []
            for content in batch["content"]:
                texts = [(p.extract_text() or "").strip() for p in PdfReader(io.BytesIO(content)).pages]
                kept = [(f"page_{i}", t) for i, t in enumerate(texts, 1) if len(t) >= LEAST_PROMPT]
                rows += kept or [("full_document", "\n".join(texts))]
            yield pd.DataFrame(rows, columns=["task_id", "prompt"])

    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pypdf") from e
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(pages, "task_id string, prompt string")


def read_labelled(spark: SparkSession, path: str, schema: StructType = LABELLED) -> DataFrame:
    """JSON lines under a fixed schema; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, text) of JSON lines that hold ``text`` or ``prompt``; rows without either are dropped."""
    rows = spark.read.schema("task_id string, text string, prompt string").option("mode", "DROPMALFORMED").json(path)
    return rows.select("task_id", F.coalesce("text", "prompt").alias("text")).where("task_id != '' and text != ''")


def write_results(df: DataFrame, path: str) -> None:
    """Scored rows as CSV; nested columns become JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_flagged_results(df: DataFrame, pairs: DataFrame, key: str, path: str) -> None:
    """Scored rows as CSV with ``similarity_flags``: each row's partners with their flags (pairs: key_a, key_b, flags)."""
    ways = F.array(F.struct(F.col(f"{key}_a").alias("k"), F.col(f"{key}_b").alias("o"), "flags"), F.struct(F.col(f"{key}_b").alias("k"), F.col(f"{key}_a").alias("o"), "flags"))
    sides = pairs.select(F.explode(ways).alias("x")).select("x.*")
    label = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("o").cast("string"), F.array_join("flags", "+")))), "; ")
    labels = sides.groupBy(F.col("k").alias(key)).agg(label.alias("similarity_flags"))
    write_results(df.join(labels, key, "left").withColumn("similarity_flags", F.coalesce("similarity_flags", F.lit(""))), path)


def append_baselines(df: DataFrame, path: str, batch: str) -> None:
    """Scored rows as JSON lines for baselines; a batch written twice is there once."""
    df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").json(path)


def write_candidates(found: DataFrame, path: str) -> None:
    """Vocabulary candidates as one CSV in order of their log odds: a short list by its threshold."""
    found.orderBy(F.col("log_odds").desc(), "token").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_fairness_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(text, ground_truth, proficiency_level) of JSON lines; rows without a text are dropped, levels may be null."""
    rows = spark.read.schema("text string, ground_truth string, proficiency_level string").option("mode", "DROPMALFORMED").json(path)
    return rows.where("text != ''")


def run_directory(root: str, name: str, started: str) -> dict[str, str]:
    """Paths of one run under a root: results, reports, log of parameters; ``started`` is written as given."""
    base = f"{root.rstrip('/')}/{name}_{started}"
    return {"base": base, "results": f"{base}/results", "reports": f"{base}/reports", "parameters": f"{base}/parameters"}


def write_parameters(spark: SparkSession, paths: dict[str, str], parameters: dict[str, str]) -> None:
    rows = [(k, str(v)) for k, v in sorted(parameters.items())]
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").json(paths["parameters"])
