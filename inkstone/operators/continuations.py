"""Continuations of a text scored against its own ending, relationally: for any source of regenerated texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import regex, text

# N-gram lengths and their weights; thresholds of mean and greatest score.
WEIGHTS = ((2, 0.25), (3, 0.50), (4, 0.25))
RED, RED_MOST, AMBER, YELLOW = 0.20, 0.22, 0.12, 0.08


def overlap_score(original: Column, regenerated: Column) -> Column:
    """Weighted F1 of the distinct 2-, 3- and 4-grams two token arrays share."""

    def of(pair: Column) -> Column:
        def part(n: int, w: float) -> Column:
            grams = F.struct(F.array_distinct(text.ngrams(pair["a"], n)).alias("x"), F.array_distinct(text.ngrams(pair["b"], n)).alias("y"))
            f1 = lambda g: F.when((F.size(g["x"]) > 0) & (F.size(g["y"]) > 0), 2 * F.size(F.array_intersect(g["x"], g["y"])) / (F.size(g["x"]) + F.size(g["y"]))).otherwise(0.0)
            return text.bound(grams, f1) * w

        return regex.total([part(n, w) for n, w in WEIGHTS])

    return text.bound(F.struct(original.alias("a"), regenerated.alias("b")), of)


def determination(mean: Column, most: Column) -> Column:
    return F.when((mean >= RED) & (most >= RED_MOST), "RED").when(mean >= AMBER, "AMBER").when(mean >= YELLOW, "YELLOW").otherwise("GREEN")


def confidence(mean: Column, det: Column) -> Column:
    return (
        F.when(det == "RED", F.least(0.60 + mean, F.lit(0.90))).when(det == "AMBER", F.least(0.40 + mean, F.lit(0.70)))
        .when(det == "YELLOW", F.least(0.20 + mean, F.lit(0.40))).otherwise(F.greatest(0.10 - mean, F.lit(0.0)))
    )


def requests(texts: DataFrame, key: str, text_col: str, ratios: tuple[float, ...] = (0.3, 0.5, 0.7), samples: int = 3) -> DataFrame:
    """(custom_id, key, ratio, sample, prefix, rest, layout): what a model is to be asked to continue.

    Texts of fewer than 150 words, and cuts that leave fewer than 30, ask nothing.
    """
    w = texts.select(F.col(key), F.col(text_col).alias("_t"), text.words(F.col(text_col)).alias("_w")).where(F.size("_w") >= 150)
    asked = w.select("*", F.explode(F.array(*map(F.lit, ratios))).alias("ratio")).withColumn("_cut", F.floor(F.size("_w") * F.col("ratio")).cast("int")).where(F.size("_w") - F.col("_cut") >= 30)
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    return asked.select(
        F.concat_ws("-", F.col(key), "ratio", "sample").alias("custom_id"), key, "ratio", "sample",
        F.array_join(F.slice("_w", F.lit(1), F.col("_cut")), " ").alias("prefix"), F.array_join(F.slice("_w", F.col("_cut") + 1, F.size("_w")), " ").alias("rest"), format_flags(F.col("_t")).alias("layout"),
    )


def score_responses(asked: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """(key, bscore, bscore_max, determination, confidence, stability, cuts) from responses (custom_id, text).

    Responses under unknown ids and of fewer than ten words are left out; longer ones than one and a half times the
    rest are cut there. The cut at one half speaks for a text, else its least; a stable score adds confidence.
    """
    both = asked.select("custom_id", key, "ratio", text.words(F.lower("rest")).alias("o")).join(responses.select("custom_id", text.words(F.lower("text")).alias("g")), "custom_id").where(F.size("g") >= 10)
    score = F.round(overlap_score(F.col("o"), F.slice("g", F.lit(1), F.floor(F.size("o") * 1.5).cast("int"))), 4)
    cuts = both.select(key, "ratio", score.alias("b")).groupBy(key, "ratio").agg(F.avg("b").alias("m"), F.max("b").alias("top"))
    speaks = F.struct((F.col("ratio") != 0.5).alias("other"), "ratio")
    texts = cuts.groupBy(key).agg(
        F.min_by(F.struct("m", "top"), speaks).alias("s"), F.count(F.lit(1)).alias("cuts"), F.avg(F.round("m", 4)).alias("mean"), F.var_samp(F.round("m", 4)).alias("v")
    )
    stability = F.when(F.col("cuts") >= 2, F.greatest(1 - F.col("v") / 0.02, F.lit(0.0))).otherwise(0.0)
    det = determination(F.col("s.m"), F.col("s.top"))
    sure = F.round(confidence(F.col("s.m"), det), 4)
    return texts.select(
        key, F.round("s.m", 4).alias("bscore"), F.round("s.top", 4).alias("bscore_max"), det.alias("determination"),
        F.when((stability >= 0.75) & (F.col("mean") >= 0.15), F.round(F.least(sure + 0.10, F.lit(1.0)), 4)).otherwise(sure).alias("confidence"), F.round(stability, 4).alias("stability"), "cuts",
    )


def score_samples(samples: DataFrame, key: str, ratio: str, original: str, regenerated: str) -> DataFrame:
    """(key, bscore, bscore_max, stability, determination): samples averaged per cut, cuts per text."""
    scored = samples.select(key, ratio, overlap_score(text.proxy_tokens(F.col(original)), text.proxy_tokens(F.col(regenerated))).alias("b"))
    cuts = scored.groupBy(key, ratio).agg(F.avg("b").alias("m"), F.max("b").alias("top"))
    texts = cuts.groupBy(key).agg(F.avg("m").alias("m"), F.max("top").alias("top"), F.coalesce(F.var_samp("m"), F.lit(0.0)).alias("v"))
    return texts.select(
        key, F.round("m", 4).alias("bscore"), F.round("top", 4).alias("bscore_max"), F.round(F.greatest(1 - F.col("v") / 0.02, F.lit(0.0)), 4).alias("stability"),
        determination(F.col("m"), F.col("top")).alias("determination"),
    )


def format_flags(t: Column) -> Column:
    """Layout a continuation should keep."""
    return F.struct(
        t.contains("\n\n").alias("paragraphs"),
        regex.has(t, r"^\d+[\.\)]\s", False, True).alias("numbered"),
        regex.has(t, r"^[-•]\s", False, True).alias("bullets"),
        regex.has(t, r"^#+\s", False, True).alias("headings"),
    )
