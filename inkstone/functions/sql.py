"""The engine's functions under SQL names: ``register(spark)`` makes them available to ``spark.sql``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from inkstone.operators import residue_python

# SQL functions that are expanded into the plan they are used in; nothing leaves the JVM.
EXPRESSIONS = {
    "ink_words": ("t STRING", "INT", r"regexp_count(t, '(?U)\\S+')"),
    "ink_length_bin": ("t STRING", "STRING", r"CASE WHEN regexp_count(t, '(?U)\\S+') < 100 THEN 'short' WHEN regexp_count(t, '(?U)\\S+') < 300 THEN 'medium' WHEN regexp_count(t, '(?U)\\S+') < 800 THEN 'long' ELSE 'very_long' END"),
    "ink_jaccard": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(a) > 0 AND size(b) > 0 THEN size(array_intersect(a, b)) / size(array_union(a, b)) ELSE 0D END"),
    "ink_risk_tier": ("confirmed_ai BIGINT, flag_rate DOUBLE", "STRING", "CASE WHEN confirmed_ai > 0 AND flag_rate > 0.5 THEN 'CRITICAL' WHEN flag_rate > 0.3 OR confirmed_ai > 0 THEN 'HIGH' WHEN flag_rate > 0.15 THEN 'ELEVATED' ELSE 'NORMAL' END"),
    "ink_is_flagged": ("determination STRING", "BOOLEAN", "coalesce(determination IN ('RED', 'AMBER', 'MIXED'), false)"),
    "ink_cosine": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x))",
    ),
}
# Functions that need Python, on Arrow batches.
ARROW = {"ink_normalized": residue_python.normalized, "ink_compression": residue_python.compression, "ink_spans": residue_python.spans, "ink_highlighted": residue_python.highlighted}


class PdfPages:
    """Table function: (page, text) of the pages of a PDF given as bytes; needs pypdf. Null bytes give no rows."""

    def eval(self, content: bytes) -> Iterator[tuple[int, str]]:
        if content is None:
            return
        import io

        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("reading PDF files needs pypdf") from e
        for i, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1):
            yield i, (page.extract_text() or "").strip()


class WordChunks:
    """Table function: (chunk, words, text) of successive runs of words of a text."""

    def eval(self, text: str, size: int) -> Iterator[tuple[int, int, str]]:
        words = (text or "").split()
        for i in range(0, len(words), max(size or 1, 1)):
            part = words[i : i + max(size or 1, 1)]
            yield i // max(size or 1, 1), len(part), " ".join(part)


TABLES = {"ink_pdf_pages": (PdfPages, "page int, text string"), "ink_word_chunks": (WordChunks, "chunk int, words int, text string")}


def register(spark: SparkSession) -> list[str]:
    """Registers every function for the session and returns their names."""
    for name, (arguments, result, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    for name, function in ARROW.items():
        spark.udf.register(name, function)
    for name, (handler, schema) in TABLES.items():
        spark.udtf.register(name, udtf(handler, returnType=schema))
    return [*EXPRESSIONS, *ARROW, *TABLES]
