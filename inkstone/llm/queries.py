"""Queries of the training-data operators and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import batch_dedup, cutoffs, eval_leaks, group_splits, language_id, near_duplicates, residue, term_counts, text_forms, tokenization
from inkstone.session import materialize, spread, table


# Problem 1 -----------------------------------------------------------------------------------------


def p1_term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    is_blank = lambda c: F.regexp_replace(c, r"(?U)\s+", "") == ""
    records = table(spark, d, "corpus").select("task_id", "text").where(F.col("text").isNotNull() & ~is_blank("text")).distinct()
    ids = table(spark, d, "confirmed").select(F.lower(F.regexp_replace("task_id", r"(?U)^\s+|\s+$", "")).alias("id")).where("id != ''")
    parts = term_counts.partial_counts(records, "corpus.text", text_forms.words(F.col("text"))).unionByName(
        term_counts.partial_counts(ids, "confirmed.task_id", F.array("id"))
    )
    of_text = F.col("field_name") == "corpus.text"
    rare = F.when(of_text, F.col("records") < 3).otherwise(F.col("records") == 1)
    common = F.when(of_text, F.col("records") * 100 > F.col("total_records") * 15).otherwise(
        (F.col("records") >= 5) & (F.col("records") * 100 > F.col("total_records"))
    )
    return term_counts.marked_terms(parts, rare, common)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_term_frequencies(spark, d).where("mark is not null").select("field_name", "term", "mark")


_P1_SQL = r"""
WITH r AS (SELECT DISTINCT task_id, text FROM corpus WHERE text IS NOT NULL AND regexp_replace(text, '\s+', '', 'g') <> ''),
w AS (SELECT row_number() OVER () AS rec, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM r),
t AS (SELECT 'corpus.text' AS field_name, term, count(*) AS occurrences, count(DISTINCT rec) AS records
      FROM (SELECT rec, unnest(ws) AS term FROM w) GROUP BY term),
i AS (SELECT lower(regexp_replace(task_id, '^\s+|\s+$', '', 'g')) AS term FROM confirmed),
c AS (SELECT 'confirmed.task_id' AS field_name, term, count(*) AS occurrences, count(*) AS records FROM i WHERE term <> '' GROUP BY term),
a AS (SELECT *, (SELECT count(*) FROM r) AS total_records FROM t
      UNION ALL SELECT *, (SELECT count(*) FROM i WHERE term <> '') FROM c)
SELECT field_name, term, occurrences, records, total_records,
  CASE WHEN field_name = 'corpus.text' THEN CASE WHEN records < 3 THEN 'rare' WHEN records * 100 > total_records * 15 THEN 'common' END
       WHEN records = 1 THEN 'rare' WHEN records >= 5 AND records * 100 > total_records THEN 'common' END AS mark
FROM a
"""


# Problem 2 -----------------------------------------------------------------------------------------


def _p2_groups(spark: SparkSession, d: str) -> DataFrame:
    gs = group_splits
    tasks = table(spark, d, "tasks").select(
        gs.vertex("task", text_forms.task_key(F.col("task_id"))).alias("t"),
        gs.vertex("name", gs.name_key("attempter")).alias("a"),
        gs.vertex("mail", gs.mail_key(F.col("attempter_email"))).alias("e"),
    )
    confirmed = table(spark, d, "confirmed").select(
        "confirm_id",
        gs.vertex("task", text_forms.task_key(F.col("task_id"))).alias("t"),
        gs.vertex("name", gs.name_key("attempter")).alias("a"),
    )
    confirmed = materialize(confirmed, "confirmed")
    edges = gs.links(tasks, ["t", "a", "e"]).unionByName(gs.links(confirmed, ["t", "a"])).distinct()
    return gs.related_groups(confirmed, "confirm_id", ["t", "a"], edges)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _p2_groups(spark, d).where("group_size > 1").select("confirm_id", "group_id")


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    groups = materialize(_p2_groups(spark, d), "groups")
    return group_splits.assign_splits(groups, "confirm_id", {"train": 0.70, "validation": 0.15, "test": 0.15})


# Problems 3 and 5 ----------------------------------------------------------------------------------


def _p3_rows(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "tasks").where("prompt is not null")
    return spread(tasks.select("row_idx", "prompt", text_forms.occupation_key(F.col("occupation")).alias("occ")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(_p3_rows(spark, d), "row_idx", "prompt", "occ", width=3, threshold=0.5)


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each row's class of equal shingle sets and the number of classes that p3_found links it with."""
    return near_duplicates.near_duplicate_classes(_p3_rows(spark, d), "row_idx", "prompt", "occ", width=3, threshold=0.5)


def p3_shared_passages(spark: SparkSession, d: str) -> DataFrame:
    """The classes at the stricter default of five words and 0.8."""
    return near_duplicates.near_duplicate_classes(_p3_rows(spark, d), "row_idx", "prompt", "occ")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return text_forms.look_alike_pairs(table(spark, d, "tasks"), "row_idx", "prompt")


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return text_forms.look_alike_classes(table(spark, d, "tasks"), "row_idx", "prompt")


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    return text_forms.consistent_forms(table(spark, d, "tasks"), "row_idx", "prompt")


# Problem 4 -----------------------------------------------------------------------------------------


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "results").select(
        "row_idx",
        F.coalesce("scored_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("scored_at"),
        "confidence",
        text_forms.occupation_key(F.col("occupation")).alias("occupation"),
        F.coalesce("calibration_stratum", F.lit("uncalibrated")).alias("calibration_stratum"),
    )
    latest = cutoffs.latest_records(
        results, "row_idx", "scored_at", {c: F.col(c) for c in ("confidence", "occupation", "calibration_stratum")}
    ).where("confidence between 0 and 1 and not isnan(confidence)")
    targets = table(spark, d, "keep_targets").select("occupation", F.col("target_pct").alias("pct"))
    records = materialize(latest.join(targets, "occupation"), "records")
    found = cutoffs.fraction_cutoffs(records, ["occupation", "calibration_stratum"], "confidence", "pct")
    return found.select(
        "occupation", "calibration_stratum", F.round(F.col("cutoff") * 10000).cast("bigint").alias("cutoff_e4"), F.col("kept").cast("bigint").alias("kept_rows")
    )


_P4_SQL = r"""
WITH r AS (SELECT row_idx, arg_max({'c': confidence, 'o': occupation, 's': calibration_stratum}, scored_at) AS x FROM results GROUP BY row_idx),
k AS (SELECT x.c AS c, coalesce(x.s, 'uncalibrated') AS calibration_stratum,
        coalesce(nullif(trim(regexp_replace(lower(x.o), '\s+', ' ', 'g')), ''), '(unknown)') AS occupation
      FROM r WHERE x.c BETWEEN 0 AND 1 AND NOT isnan(x.c)),
n AS (SELECT k.*, target_pct, count(*) OVER g AS n, count(*) OVER (g ORDER BY c DESC RANGE UNBOUNDED PRECEDING) AS at_or_above
      FROM k JOIN keep_targets USING (occupation) WINDOW g AS (PARTITION BY k.occupation, calibration_stratum))
SELECT occupation, calibration_stratum, CAST(round(max(c) * 10000) AS BIGINT) AS cutoff_e4, CAST(min(at_or_above) AS BIGINT) AS kept_rows
FROM n WHERE at_or_above * 100 >= target_pct * n GROUP BY ALL
"""


# Problem 6 -----------------------------------------------------------------------------------------


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "tasks").select("row_idx", "task_id", "prompt")
    batches = table(spark, d, "fingerprints").select("row_idx", "batch_id")
    return batch_dedup.batch_duplicates(tasks, batches, "row_idx", text_forms.task_key(F.col("task_id")), F.col("prompt"), "batch_id")


# Problem 7 -----------------------------------------------------------------------------------------


def _p7_detected(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tasks = table(spark, d, "tasks").select("row_idx", "prompt")
    labels = table(spark, d, "results").groupBy("row_idx").agg(F.max("lang_label").alias("lang_label"))
    model = language_id.train(language_id.labelled_sample(tasks, labels, "row_idx", "prompt", "lang_label"))
    return language_id.detect_languages(spread(tasks), "row_idx", "prompt", model), labels


def p7_segments(spark: SparkSession, d: str) -> DataFrame:
    found, _ = _p7_detected(spark, d)
    parts = found.select("row_idx", F.posexplode("segments").alias("segment", "s"))
    return parts.select("row_idx", "segment", *[F.col("s")[c].alias(c) for c in ("start", "end", "lang", "confidence", "ambiguous")])


def p7_languages(spark: SparkSession, d: str) -> DataFrame:
    found, _ = _p7_detected(spark, d)
    return language_id.languages_of(found, "row_idx")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found, labels = _p7_detected(spark, d)
    named = labels.select("row_idx", language_id.label_language(F.col("lang_label")).alias("label"))
    held = language_id.languages_of(found, "row_idx").select("row_idx", "langs").where("size(langs) > 0")
    wrong = (F.size("langs") > 1) | (F.coalesce("label", F.lit("")) != F.get("langs", F.lit(0)))
    return held.join(named, "row_idx", "left").where(wrong).select("row_idx", F.explode("langs").alias("lang"))


# Problems 8, 9 and 10 ------------------------------------------------------------------------------


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    documents = spread(table(spark, d, "documents").select("doc_id", "text"))
    return tokenization.encode_corpus(documents, "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    documents = spread(table(spark, d, "documents").select("doc_id", "text"))
    return eval_leaks.leaked_items(documents, "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p10_residue(spark: SparkSession, d: str) -> DataFrame:
    documents = spread(table(spark, d, "documents").select("doc_id", "text"))
    return residue.residue_documents(documents, "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_residue(spark, d).select("doc_id")


def queries() -> dict:
    return {name: fn for name, fn in globals().items() if name[:1] == "p" and name[1:2].isdigit() and callable(fn)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_term_frequencies": _P1_SQL,
        "p1_found": f"SELECT field_name, term, mark FROM ({_P1_SQL}) WHERE mark IS NOT NULL",
        "p4_found": _P4_SQL,
    }
