"""Queries of the memory, calibration report, channel and fusion operators over the recorded tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import lexicon, tables, text
from inkstone.operators import cohort, continuations, fusion, memory, models, pair_analysis, sequences, similarity
from inkstone import reports
from inkstone.functions import sql as names
from inkstone.queries import _F1, _FL, _LAB, _SHINGLES, _T, _labelled, _q, _scored, _shingled, _texts, _user_series, changepoint_sql, query
from inkstone.session import materialize, spread, table

_FEATURES = ["prompt_signature_composite", "instruction_density_idi", "voice_dissonance_vsd", "self_similarity_nssi_score"]
_LATEST = "SELECT * FROM results WHERE row_idx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY scored_at DESC NULLS LAST, result_id DESC) = 1"


def _latest_results(spark, d, columns: list[str]) -> DataFrame:
    rows = table(spark, d, "results").select("row_idx", *columns, "scored_at", "result_id")
    return cohort.latest(rows, "row_idx", ["scored_at", "result_id"])


# Authors -------------------------------------------------------------------------------------------


@query(f"""WITH f AS ({_LATEST}), p AS (SELECT trim(s.attempter) AS attempter, count(*) AS total, {', '.join(f"count(*) FILTER (s.determination = '{k}') AS n_{k.lower()}" for k in memory.KINDS)},
 array_to_string(list_sort(list_distinct(list(nullif(trim(s.occupation), '')) FILTER (trim(s.occupation) <> ''))), '; ') AS occupations, count(DISTINCT batch_id) AS batches, min(recorded_at) AS first_seen, max(recorded_at) AS last_seen,
 {', '.join(f"round(avg(CASE WHEN f.{x} IS NULL OR isnan(f.{x}) THEN 0 ELSE f.{x} END) + 1e-9, 3) AS mean_{x}" for x in _FEATURES)} FROM submissions s LEFT JOIN f USING (row_idx) WHERE trim(s.attempter) <> '' GROUP BY 1),
c AS (SELECT trim(attempter) AS attempter, count(*) FILTER (ground_truth = 'ai') AS ai, count(*) FILTER (ground_truth = 'human') AS human FROM confirmed WHERE trim(attempter) <> '' GROUP BY 1),
r AS (SELECT p.* REPLACE (coalesce(occupations, '') AS occupations), coalesce(ai, 0) AS confirmed_ai, coalesce(human, 0) AS confirmed_human, round((n_red + n_amber + n_mixed) / total, 3) AS flag_rate FROM p LEFT JOIN c USING (attempter))
SELECT *, CASE WHEN confirmed_ai > 0 AND flag_rate > .5 THEN 'CRITICAL' WHEN flag_rate > .3 OR confirmed_ai > 0 THEN 'HIGH' WHEN flag_rate > .15 THEN 'ELEVATED' ELSE 'NORMAL' END AS risk_tier FROM r""")
def author_memory(spark, d):
    rows = table(spark, d, "submissions").join(_latest_results(spark, d, _FEATURES).select("row_idx", *_FEATURES), "row_idx", "left")
    return memory.author_memory(rows, table(spark, d, "confirmed"), _FEATURES)


@query("""SELECT 'submissions' AS relation, sub_id AS key FROM submissions WHERE trim(attempter) = (SELECT min(trim(attempter)) FROM submissions WHERE trim(attempter) <> '')
UNION ALL SELECT 'confirmed', confirm_id FROM confirmed WHERE trim(attempter) = (SELECT min(trim(attempter)) FROM submissions WHERE trim(attempter) <> '')
UNION ALL SELECT 'fingerprints', fp_id FROM fingerprints WHERE trim(attempter) = (SELECT min(trim(attempter)) FROM submissions WHERE trim(attempter) <> '')""")
def author_history(spark, d):
    """Everything recorded under one name, here the first in the alphabet."""
    names = {"submissions": "sub_id", "confirmed": "confirm_id", "fingerprints": "fp_id"}
    first = table(spark, d, "submissions").agg(F.min(cohort.clean(F.col("attempter")))).first()[0] or ""
    return memory.history({n: table(spark, d, n) for n in names}, first, names)


@query("SELECT confirm_id, sub_id, ground_truth, determination FROM confirmed JOIN submissions USING (task_id) WHERE ground_truth IN ('ai', 'human')")
def training_rows(spark, d):
    """Confirmations with every submission of their task; repeated confirmations weigh as often as they stand."""
    c = table(spark, d, "confirmed").where("ground_truth in ('ai', 'human')").select("confirm_id", "task_id", "ground_truth")
    return c.join(table(spark, d, "submissions").select("task_id", "sub_id", "determination"), "task_id").select("confirm_id", "sub_id", "ground_truth", "determination")


@query("""SELECT (SELECT count(*) FROM results) AS n, (SELECT round(avg(confidence) FILTER (NOT isnan(confidence)), 4) FROM results) AS mean_confidence,
 (SELECT determination FROM results WHERE determination IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, min(result_id) LIMIT 1) AS mode""")
def dashboard_metrics(spark, d):
    return memory.overview(table(spark, d, "results"), "result_id")


# Calibration report --------------------------------------------------------------------------------


@query(f"""WITH {_LAB}, b AS (SELECT least(CAST(floor(confidence * 10) AS INT), 9) AS bin, confidence AS s, CASE WHEN ground_truth = 'ai' THEN 1.0::DOUBLE ELSE 0 END AS y FROM l WHERE ground_truth IN ('ai', 'human')),
g AS (SELECT bin, count(*) AS n, round(abs(avg(s) - avg(y)), 4) AS gap FROM b GROUP BY bin) SELECT CAST(sum(n) AS BIGINT) AS labelled, count(*) AS bins, round(avg(gap), 4) AS calibration_error FROM g""")
def calibration_error(spark, d):
    return memory.calibration_error(_labelled(spark, d))


@query(f"WITH {_LAB} SELECT determination, count(*) FILTER (ground_truth = 'ai') AS ai, count(*) FILTER (ground_truth = 'human') AS human FROM l WHERE ground_truth IN ('ai', 'human') GROUP BY 1")
def verdicts_by_truth(spark, d):
    return memory.verdicts_by_truth(_labelled(spark, d))


@query(f"""WITH {_LAB}, c AS (SELECT coalesce(nullif(task_domain, ''), 'unknown') || '_' || coalesce(nullif(length_bin, ''), 'unknown') AS stratum, count(*) AS n, count(*) FILTER (ground_truth = 'human') AS human,
 count(*) FILTER (ground_truth = 'human' AND {_FL}) AS false_positives, count(*) FILTER (ground_truth = 'ai') AS ai, count(*) FILTER (ground_truth = 'ai' AND determination IN ('GREEN', 'YELLOW')) AS false_negatives
 FROM l WHERE ground_truth IN ('ai', 'human') GROUP BY 1)
SELECT *, round(CASE WHEN human > 0 THEN false_positives / human ELSE 0 END, 4) AS fpr, round(CASE WHEN ai > 0 THEN false_negatives / ai ELSE 0 END, 4) AS fnr FROM c""")
def stratum_errors(spark, d):
    return memory.stratum_errors(_labelled(spark, d))


@query(f"""WITH {_LAB} SELECT lang_support_level, count(*) AS n, count(*) FILTER ({_FL}) AS flagged, count(*) FILTER ((lang_support_level = 'UNSUPPORTED' AND determination = 'YELLOW') OR (lang_support_level = 'REVIEW' AND determination = 'AMBER')) AS capped,
 round(count(*) FILTER ({_FL}) / count(*), 4) AS fpr FROM l WHERE ground_truth = 'human' GROUP BY 1""")
def fairness_rates(spark, d):
    return memory.capped_rates(_labelled(spark, d), "lang_support_level")


@query(f"""SELECT result_id, determination, confidence, CAST(coalesce(list_position([{', '.join(map(_q, memory.LABELLING_ORDER))}], determination) - 1, 6) AS INT) AS rank FROM results WHERE NOT coalesce(isnan(confidence), false)
ORDER BY rank, confidence DESC NULLS LAST, result_id LIMIT 100""")
def labelling_queue(spark, d):
    return memory.labelling_queue(table(spark, d, "results").where("not coalesce(isnan(confidence), false)"), "result_id")


@query("SELECT result_id, confidence FROM results WHERE determination = 'YELLOW' AND NOT isnan(confidence) ORDER BY confidence DESC, result_id LIMIT 10")
def top_yellow(spark, d):
    rows = table(spark, d, "results").where("determination = 'YELLOW' and not isnan(confidence) and confidence is not null")
    return rows.select("result_id", "confidence").orderBy(F.col("confidence").desc(), "result_id").limit(10)


_ALL_METRICS = ["confidence", "calibrated_confidence", "word_count", "norm_homoglyphs", "norm_invisible_chars", "lang_fw_coverage", "lang_non_latin_ratio", *_FEATURES]


@query(f"""WITH u AS (SELECT occupation, metric, v FROM (SELECT occupation, unnest([{', '.join(_q(m) for m in _ALL_METRICS)}]) AS metric, unnest([{', '.join(f'CAST({m} AS DOUBLE)' for m in _ALL_METRICS)}]) AS v FROM results)
 WHERE v IS NOT NULL AND NOT isnan(v)), k AS (SELECT occupation FROM results GROUP BY 1 HAVING count(*) >= 5)
SELECT occupation, metric, count(*) AS n, {', '.join(f"round(quantile_cont(v, {p}), 6) AS p{int(p * 100)}" for p in (.25, .5, .75, .9, .95, .99))}, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std
FROM u WHERE occupation IN (SELECT occupation FROM k) GROUP BY occupation, metric HAVING count(*) >= 3""")
def baseline_metrics(spark, d):
    """Every numeric measure that the results carry."""
    return cohort.percentiles(table(spark, d, "results"), "occupation", _ALL_METRICS)


# Channels and fusion over recorded features --------------------------------------------------------

# The recorded features name no voice marks: a dissonance of 21 stands for a gated voice; a self-similarity score for its verdict.
_NSSI = "CASE WHEN ns >= .70 THEN 'RED' WHEN ns >= .45 THEN 'AMBER' WHEN ns >= .25 THEN 'YELLOW' END"
_RECORDED = f"""f AS (SELECT result_id, row_idx, attempter, coalesce(word_count, 0) AS w, lang_support_level AS gate, coalesce(CASE WHEN NOT isnan(prompt_signature_composite) THEN prompt_signature_composite END, 0) AS comp, coalesce(CASE WHEN NOT isnan(instruction_density_idi) THEN instruction_density_idi END, 0) AS idi,
 coalesce(CASE WHEN NOT isnan(voice_dissonance_vsd) THEN voice_dissonance_vsd END, 0) AS vsd, coalesce(CASE WHEN NOT isnan(self_similarity_nssi_score) THEN self_similarity_nssi_score END, 0) AS ns, CASE WHEN norm_homoglyphs > 0 THEN 0.06 ELSE 0 END AS delta FROM results),
p AS (SELECT *, greatest(CASE WHEN comp >= .6 THEN 3 WHEN comp >= .4 THEN 2 WHEN comp >= .2 THEN 1 ELSE 0 END, CASE WHEN vsd >= 50 THEN 3 WHEN vsd >= 21 THEN 2 ELSE 0 END, CASE WHEN idi >= 12 THEN 3 WHEN idi >= 8 THEN 2 ELSE 0 END) AS pl,
 greatest(CASE WHEN comp >= .4 THEN comp WHEN comp >= .2 THEN comp * .7::DOUBLE ELSE 0 END, CASE WHEN vsd >= 50 THEN .9::DOUBLE WHEN vsd >= 21 THEN .7::DOUBLE ELSE 0 END, CASE WHEN idi >= 12 THEN .85::DOUBLE WHEN idi >= 8 THEN .65::DOUBLE ELSE 0 END) AS ps,
 CASE {_NSSI} WHEN 'RED' THEN 3 WHEN 'AMBER' THEN 2 WHEN 'YELLOW' THEN 1 ELSE 0 END AS sl, CASE {_NSSI} WHEN 'RED' THEN least(.85::DOUBLE, ns) WHEN 'AMBER' THEN least(.65::DOUBLE, ns) WHEN 'YELLOW' THEN least(.4::DOUBLE, ns) ELSE 0 END AS ss FROM f)"""


def _recorded_channels(spark, d) -> DataFrame:
    num = lambda c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0))
    vsd, ns = num("voice_dissonance_vsd"), num("self_similarity_nssi_score")
    voice = {"voice_gated": vsd >= 21, "vsd": vsd, "spec_score": F.lit(0.0), "voice_score": F.lit(1.0), "contractions": F.lit(1), "hedges": F.lit(1)}
    det = F.when(ns >= 0.70, "RED").when(ns >= 0.45, "AMBER").when(ns >= 0.25, "YELLOW")
    prompt = fusion.prompt_structure(F.lit(0.0), F.lit("NONE"), num("prompt_signature_composite"), voice, num("instruction_density_idi"), F.coalesce("word_count", F.lit(0)))
    style = fusion.stylistic(F.lit(0.0), {"determination": det, "confidence": ns})
    return table(spark, d, "results").withColumn("channels", F.array(prompt, style)).withColumn("composite", num("prompt_signature_composite")).withColumn("idi", num("instruction_density_idi"))


@query(f"WITH {_RECORDED} SELECT result_id, pl AS prompt_level, round(ps, 6) AS prompt_score, sl AS style_level, round(ss, 6) AS style_score FROM p")
def recorded_channels(spark, d):
    c = lambda i, name: F.get("channels", F.lit(i))[name]
    return _recorded_channels(spark, d).select(
        "result_id", c(0, "level").alias("prompt_level"), F.round(c(0, "score"), 6).alias("prompt_score"), c(1, "level").alias("style_level"), F.round(c(1, "score"), 6).alias("style_score")
    )


# The ladder as SQL: primary is what the mode lets count by itself; a style channel is primary in generic mode only.
_LADDER = f"""{_RECORDED}, m AS (SELECT *, CASE WHEN CASE WHEN w >= 400 THEN .2 ELSE 0 END > CASE WHEN comp >= .15 THEN comp ELSE 0 END + CASE WHEN idi >= 5 THEN .3 ELSE 0 END + .1 THEN 'generic_aigt' ELSE 'task_prompt' END AS mode FROM p),
n AS (SELECT *, mode = 'task_prompt' AS task, CAST(pl = 3 AS INT) + CAST(sl = 3 AS INT) AS red, CAST(pl > 0 AS INT) + CAST(sl > 0 AS INT) AS yel, CAST(pl = 3 AS INT) + CAST(sl = 3 AND mode <> 'task_prompt' AS INT) AS pred,
 CAST(pl >= 2 AS INT) + CAST(sl >= 2 AND mode <> 'task_prompt' AS INT) AS pamb, CAST(pl > 0 AS INT) + CAST(sl > 0 AND mode <> 'task_prompt' AS INT) AS pyel, CAST(sl > 0 AND mode = 'task_prompt' AS INT) AS sup, sl >= 2 AND mode = 'task_prompt' AS supamb,
 CAST(ps > 0 OR pl > 0 AS INT) + CAST(ss > 0 OR sl > 0 AS INT) AS act, ps > .05 OR ss > .05 AS weak, greatest(CASE WHEN pl > 0 THEN ps ELSE 0 END, CASE WHEN sl > 0 THEN ss ELSE 0 END) AS top FROM m),
r AS (SELECT *, CASE WHEN pred >= 1 AND yel >= 2 THEN 'primary_red_with_corroboration' WHEN w > 0 AND w < 100 AND act <= 2 AND pred >= 1 AND yel >= 1 THEN 'primary_red_short_text_relaxed' WHEN pamb >= 2 THEN 'two_primary_amber_channels'
 WHEN task AND pred >= 1 AND yel = 1 THEN 'primary_red_single_channel_demoted' WHEN NOT task AND red >= 1 THEN 'generic_aigt_red_single_channel' WHEN pamb >= 1 THEN 'primary_amber_single_channel'
 WHEN CASE WHEN task THEN pyel + least(sup, 1) ELSE yel END >= 2 THEN 'multi_channel_convergence' WHEN task AND supamb THEN 'supporting_channel_amber' WHEN yel >= 1 THEN 'yellow_signal' WHEN delta >= .05 THEN 'obfuscation_delta'
 WHEN weak THEN 'weak_signals_below_threshold' ELSE 'no_signal' END AS rule FROM n),
b AS (SELECT *, CASE WHEN rule IN ('primary_red_with_corroboration', 'primary_red_short_text_relaxed', 'two_primary_amber_channels', 'generic_aigt_red_single_channel') THEN 3 WHEN rule IN ('primary_red_single_channel_demoted', 'primary_amber_single_channel', 'multi_channel_convergence', 'supporting_channel_amber') THEN 2
 WHEN rule IN ('yellow_signal', 'obfuscation_delta') THEN 1 ELSE 0 END AS lv, CASE rule WHEN 'primary_red_with_corroboration' THEN top WHEN 'primary_red_short_text_relaxed' THEN least(top - .15::DOUBLE, .75::DOUBLE) WHEN 'two_primary_amber_channels' THEN least(top, .85::DOUBLE)
 WHEN 'primary_red_single_channel_demoted' THEN least(top, .75::DOUBLE) WHEN 'generic_aigt_red_single_channel' THEN least(top, .75::DOUBLE) WHEN 'primary_amber_single_channel' THEN least(top, .7::DOUBLE) WHEN 'multi_channel_convergence' THEN least(top, .6::DOUBLE) WHEN 'supporting_channel_amber' THEN .55::DOUBLE
 WHEN 'yellow_signal' THEN least(top, .45::DOUBLE) WHEN 'obfuscation_delta' THEN .35::DOUBLE WHEN 'weak_signals_below_threshold' THEN .1::DOUBLE ELSE 0 END AS conf, CASE gate WHEN 'UNSUPPORTED' THEN 1 WHEN 'REVIEW' THEN 2 ELSE 3 END AS cap FROM r)"""


@query(f"""WITH {_LADDER} SELECT result_id, mode, rule AS triggering_rule, CASE WHEN rule = 'weak_signals_below_threshold' THEN 'REVIEW' ELSE ['GREEN', 'YELLOW', 'AMBER', 'RED'][least(lv, cap) + 1] END AS determination,
 round(CASE WHEN lv > cap THEN least(conf, .4::DOUBLE) ELSE conf END, 6) AS confidence FROM b""")
def recorded_verdicts(spark, d):
    """The ladder over the recorded features of every result."""
    rows = _recorded_channels(spark, d)
    words = F.coalesce("word_count", F.lit(0))
    mode = fusion.mode(F.col("composite"), F.col("idi"), F.lit(0), F.lit(0), words)
    delta = F.when(F.col("norm_homoglyphs") > 0, 0.06).otherwise(0.0)
    # Written once: the ladder reads the channels many times.
    rows = materialize(rows.select("result_id", "channels", mode.alias("mode"), words.alias("words"), F.coalesce("lang_support_level", F.lit("SUPPORTED")).alias("gate"), delta.alias("delta")), "channels")
    v = fusion.determine([F.get("channels", F.lit(i)) for i in range(2)], F.col("mode"), F.col("words"), F.col("gate"), F.lit(False), F.lit(False), F.col("delta"))
    return rows.select("result_id", v.alias("v")).select("result_id", "v.mode", "v.triggering_rule", "v.determination", F.round("v.confidence", 6).alias("confidence"))


_SEV = "['GREEN', 'YELLOW', 'AMBER', 'RED']"


@query(f"WITH {_RECORDED}, c AS (SELECT 'prompt_structure' AS channel, {_SEV}[pl + 1] AS severity FROM p WHERE pl > 0 UNION ALL SELECT 'stylometry', {_SEV}[sl + 1] FROM p WHERE sl > 0) SELECT channel, severity, count(*) AS n FROM c GROUP BY ALL")
def recorded_channel_counts(spark, d):
    return memory.channel_counts(_recorded_channels(spark, d))


@query(f"""WITH {_RECORDED}, k AS (SELECT p.result_id, CASE WHEN pl = 0 AND sl = 0 THEN 'unknown' WHEN pl >= sl THEN 'prompt_structure' ELSE 'stylometry' END AS channel FROM p JOIN results USING (result_id) WHERE {_FL})
SELECT channel, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 2) AS pct, array_to_string(list_sort(list(result_id))[1:3], ' ') AS first_rows FROM k GROUP BY channel""")
def recorded_channel_patterns(spark, d):
    return memory.leading_channels(_recorded_channels(spark, d), "result_id")


@query(f"""WITH {_RECORDED}, c AS (SELECT p.attempter, result_id AS w, 0 AS nth, 'prompt_structure' AS channel FROM p JOIN results r USING (result_id) WHERE pl >= 2 AND {_FL} UNION ALL SELECT p.attempter, result_id, 1, 'stylometry' FROM p JOIN results r USING (result_id) WHERE sl >= 2 AND {_FL}),
k AS (SELECT attempter, channel, count(*) AS n, min({{'w': w, 'nth': nth}}) AS f FROM c GROUP BY ALL) SELECT attempter, channel, n FROM k QUALIFY row_number() OVER (PARTITION BY attempter ORDER BY n DESC, f) = 1""")
def author_channels(spark, d):
    return memory.primary_channels(_recorded_channels(spark, d), order="result_id")


# Similarity ----------------------------------------------------------------------------------------


_PAIRS = f"""{_SHINGLES}, x AS (SELECT row_idx, occupation, len(sh) AS n, unnest(sh) AS g FROM s),
o AS (SELECT a.row_idx AS row_idx_a, b.row_idx AS row_idx_b, a.occupation, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.occupation = b.occupation AND a.row_idx < b.row_idx GROUP BY ALL)"""


@query(f"WITH {_PAIRS}, j AS (SELECT round(k / (na + nb - k), 6) AS j FROM o WHERE k / (na + nb - k) >= 0.4) SELECT CASE WHEN j >= .7 THEN 'RED' WHEN j >= .5 THEN 'AMBER' ELSE 'YELLOW' END AS band, count(*) AS pairs FROM j GROUP BY 1")
def similarity_bands(spark, d):
    pairs = similarity.jaccard_pairs(_shingled(spark, d), "row_idx", "occupation", "s", 0.40)
    return pairs.groupBy(memory.similarity_band(F.round("jaccard", 6)).alias("band")).agg(F.count(F.lit(1)).alias("pairs"))


@query(f"""WITH {_PAIRS}, j AS (SELECT row_idx_a, row_idx_b, round(k / (na + nb - k), 6) AS j FROM o WHERE k / (na + nb - k) >= 0.4), e AS (SELECT row_idx_a AS row_idx, row_idx_b AS p, j FROM j UNION ALL SELECT row_idx_b, row_idx_a, j FROM j)
SELECT row_idx, count(*) AS partners, string_agg(p || ':' || printf('%.2f', j), ' ' ORDER BY j DESC, p) AS label FROM e GROUP BY row_idx""")
def similarity_labels(spark, d):
    pairs = similarity.jaccard_pairs(_shingled(spark, d), "row_idx", "occupation", "s", 0.40).withColumn("jaccard", F.round("jaccard", 6))
    return memory.pair_labels(pairs, "row_idx", "jaccard")


# Vocabulary, chunks, losses ------------------------------------------------------------------------


_KEYWORDS = sorted({k.lower() for p in lexicon.PACKS.values() for k in (*p.keywords, *p.uppercase)})


@query(f"""WITH k AS (SELECT task_id, ground_truth AS g FROM confirmed WHERE task_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY verified_at DESC NULLS LAST, confirm_id DESC) = 1),
x AS (SELECT task_id, arg_max(text, rec_id) AS text FROM corpus WHERE task_id IS NOT NULL AND text IS NOT NULL GROUP BY 1),
t AS (SELECT g, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '\\p{{L}}{{3,}}'))) AS token FROM x JOIN k USING (task_id) WHERE g IN ('ai', 'human')),
c AS (SELECT token, count(*) FILTER (g = 'ai') AS n_ai, count(*) FILTER (g = 'human') AS n_human FROM t GROUP BY 1), s AS (SELECT sum(n_ai) AS a, sum(n_human) AS h, count(*) AS v FROM c),
o AS (SELECT token, round(ln(((n_ai + .05) / (a + .05 * v)) / ((n_human + .05) / (h + .05 * v))), 4) AS log_odds FROM c, s WHERE n_ai >= 10 AND a >= 500 AND h >= 500)
SELECT token, log_odds, token IN ({', '.join(map(_q, tables.FINGERPRINT_WORDS))}) AS in_fingerprints, token IN ({', '.join(map(_q, _KEYWORDS))}) AS in_packs FROM o WHERE log_odds > 0 ORDER BY log_odds DESC, token LIMIT 15""")
def vocabulary_candidates(spark, d):
    """The fifteen tokens that set machine text apart most, with whether the tables know them."""
    truth = cohort.latest(table(spark, d, "confirmed").select("task_id", "ground_truth", "verified_at", "confirm_id"), "task_id", ["verified_at", "confirm_id"])
    texts = cohort.latest(table(spark, d, "corpus").where("text is not null").select("task_id", "text", "rec_id"), "task_id", ["rec_id"])
    found = cohort.log_odds(texts.join(truth, "task_id"), F.col("text"), "ground_truth", threshold=0.0).select("token", "log_odds")
    marked = memory.known_vocabulary(found, "token", {"in_fingerprints": list(tables.FINGERPRINT_WORDS), "in_packs": _KEYWORDS})
    return marked.orderBy(F.col("log_odds").desc(), "token").limit(15)


_BLANKS = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


@query(f"""WITH {_T}, w AS (SELECT row_idx, regexp_extract_all(t, '[^{_BLANKS}]+') AS w FROM t), c AS (SELECT row_idx, unnest(range(0, CAST(ceil(len(w) / 200) AS BIGINT))) AS chunk, w FROM w WHERE len(w) >= 30)
SELECT row_idx, CAST(chunk AS INT) AS chunk, CAST(len(w[chunk * 200 + 1:chunk * 200 + 200]) AS INT) AS words FROM c WHERE len(w[chunk * 200 + 1:chunk * 200 + 200]) >= 30""")
def word_chunks(spark, d):
    """Runs of 200 words, as they are embedded; runs of fewer than thirty are left out."""
    w = _texts(spark, d).select("row_idx", text.words(F.col("t")).alias("w")).where(F.size("w") >= 30)
    return w.select("row_idx", F.posexplode(sequences.chunks(F.col("w"))).alias("chunk", "c")).where(F.size("c") >= 30).select("row_idx", "chunk", F.size("c").alias("words"))


@query(changepoint_sql(0))
def shift_points(spark, d):
    """Where each series shifts most, whatever the size of the shift."""
    c = _user_series(spark, d).select("user_id", sequences.changepoint(F.col("xs"), 0.0).alias("c")).where("c is not null")
    return c.select("user_id", "c.*")


@query("""WITH x AS (SELECT user_id, value / 100 AS v FROM events WHERE value IS NOT NULL), p AS (SELECT user_id, exp(avg(v)) AS ppl, exp(avg(v * 1.2)) AS obs FROM x GROUP BY user_id)
SELECT user_id, round(ppl / greatest(obs, 1e-6), 4) AS score, CASE WHEN ppl / greatest(obs, 1e-6) < .70 THEN 'AMBER' WHEN ppl / greatest(obs, 1e-6) < .85 THEN 'YELLOW' END AS determination FROM p""")
def binoculars(spark, d):
    """Perplexity under two models; the second model's losses are a fifth higher here."""
    losses = table(spark, d, "events").where("value is not null").groupBy("user_id").agg(F.exp(F.avg(F.col("value") / 100)).alias("ppl"), F.exp(F.avg(F.col("value") / 100 * 1.2)).alias("obs"))
    return losses.select("user_id", sequences.binoculars(F.col("ppl"), F.col("obs")).alias("b")).select("user_id", "b.*")


@query("""WITH e AS (SELECT CASE WHEN label % 2 = 0 THEN 'ai' ELSE 'human' END AS side, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT side, i, avg(x) AS a FROM e GROUP BY ALL),
p AS (SELECT i, max(a) FILTER (side = 'ai') AS a, max(a) FILTER (side = 'human') AS h FROM m GROUP BY i) SELECT round(1 - sum(a * h) / (sqrt(sum(a * a)) * sqrt(sum(h * h))), 6) AS separation FROM p""")
def centroid_separation(spark, d):
    """One less the cosine of the mean vectors of the two sides."""
    rows = table(spark, d, "embeddings").withColumn("side", F.when(F.col("label") % 2 == 0, "ai").otherwise("human"))
    c = sequences.centroids(rows, "side", "embedding")
    both = c.agg(F.max(F.when(F.col("side") == "ai", F.col("centroid"))).alias("a"), F.max(F.when(F.col("side") == "human", F.col("centroid"))).alias("h"))
    return both.select(F.round(1 - sequences.cosine(F.col("a"), F.col("h")), 6).alias("separation"))


@query()
def centroid_clusters(spark, d):
    """Clusters of each side: at most five, and at least twenty vectors each."""
    rows = table(spark, d, "embeddings").select(F.when(F.col("label") % 2 == 0, "ai").otherwise("human").alias("side"), "embedding")
    sizes = {r["side"]: r["n"] for r in rows.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
    k = max(1, min(5, sizes.get("ai", 0) // 20, sizes.get("human", 0) // 20))
    found = [(side, i, c) for side in sizes for i, c in enumerate(models.cluster_centroids(rows.where(F.col("side") == side), "embedding", k))]
    return spark.createDataFrame(found, "side string, cluster int, centroid array<double>")


# Losses, continuations, reports --------------------------------------------------------------------


_V = lambda c: f"var_pop(v) FILTER ({c})"


@query(f"""WITH x AS (SELECT user_id, value / 50 AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
a AS (SELECT user_id, n, exp(avg(v)) AS ppl, CASE WHEN n >= 10 THEN var_pop(v) ELSE 0 END AS sv, CASE WHEN n // 2 > 1 THEN {_V('i < n // 2')} ELSE var_pop(v) END AS f, CASE WHEN n - n // 2 > 1 THEN {_V('i >= n // 2')} ELSE var_pop(v) END AS s FROM x GROUP BY user_id, n),
b AS (SELECT *, CASE WHEN n >= 10 THEN CASE WHEN s > 1e-6 THEN f / s ELSE 1 END ELSE 0 END AS dec, CASE WHEN ppl <= 15 THEN 'AMBER' WHEN ppl <= 25 THEN 'YELLOW' END AS d, CASE WHEN ppl <= 15 THEN least(.65::DOUBLE, (20 - ppl) / 20) WHEN ppl <= 25 THEN least(.35::DOUBLE, (30 - ppl) / 30) ELSE 0 END AS c FROM a),
e AS (SELECT *, sv < 2 AND n >= 30 AS ev, dec > 1.5 AND n >= 40 AS fa FROM b),
r AS (SELECT user_id, n, ppl, sv, dec, CASE WHEN ev AND fa AND d IS NULL THEN 'YELLOW' WHEN ev AND fa AND d = 'YELLOW' THEN 'AMBER' ELSE d END AS d, CASE WHEN ev AND fa AND d IS NULL THEN least(.4::DOUBLE, .2::DOUBLE + (2 - sv) * .05::DOUBLE + (dec - 1) * .05::DOUBLE) WHEN ev AND fa AND d = 'YELLOW' THEN least(.65::DOUBLE, c + .15::DOUBLE)
 WHEN ev AND fa THEN least(.8::DOUBLE, c + .1::DOUBLE) WHEN (ev OR fa) AND d IS NOT NULL THEN least(c + .05::DOUBLE, .7::DOUBLE) ELSE c END AS c FROM e)
SELECT user_id, round(ppl, 2) AS perplexity, CASE WHEN ppl * .4 < 8 AND n >= 30 AND d IS NULL THEN 'YELLOW' ELSE d END AS determination, round(CASE WHEN ppl * .4 < 8 AND n >= 30 THEN CASE WHEN d IS NULL THEN least(.35::DOUBLE, .15::DOUBLE + (8 - ppl * .4::DOUBLE) * .02::DOUBLE) ELSE least(c + .05::DOUBLE, .8::DOUBLE) END ELSE c END, 4) AS confidence,
 round(sv, 4) AS surprisal_variance, round(dec, 4) AS volatility_decay_ratio, round(ppl * .4::DOUBLE, 2) AS zlib_normalized_ppl, round(.4::DOUBLE / greatest(ppl / 100, .01), 4) AS comp_ppl_ratio FROM r""")
def perplexity_verdicts(spark, d):
    """Verdicts of given losses, here the values of each user's events over fifty, and a compression ratio of 0.4."""
    s = sequences.series(table(spark, d, "events").withColumn("loss", F.col("value") / 50), "user_id", ["ts", "event_id"], "loss")
    return s.select("user_id", sequences.perplexity(F.col("xs"), F.lit(0.4)).alias("p")).select("user_id", "p.*")


@query("""WITH x AS (SELECT user_id, abs(value) / 5000 AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE value IS NOT NULL), a AS (SELECT user_id, count(*) AS n, avg(v) AS m, coalesce(stddev_samp(v), 0) AS s FROM x WHERE i <= 10 GROUP BY user_id)
SELECT user_id, round(m, 6) AS cohesiveness, round(s, 6) AS cohesiveness_std, CAST(n AS INT) AS n_rounds, CASE WHEN m >= .02 AND s < .01 THEN 'AMBER' WHEN m >= .012 THEN 'YELLOW' END AS determination,
 round(CASE WHEN m >= .02 AND s < .01 THEN least(.6::DOUBLE, .3::DOUBLE + m * 10) WHEN m >= .012 THEN least(.35::DOUBLE, .15::DOUBLE + m * 8) ELSE 0 END, 4) AS confidence FROM a""")
def cohesiveness_verdicts(spark, d):
    """Verdicts of given distances, one per deletion round: here each user's first ten values, scaled."""
    s = sequences.series(table(spark, d, "events").withColumn("far", F.abs("value") / 5000), "user_id", ["ts", "event_id"], "far")
    return s.select("user_id", sequences.cohesiveness(F.slice("xs", 1, 10)).alias("c")).select("user_id", "c.*")


_CUT = f"WITH {_T}, w AS (SELECT row_idx, regexp_extract_all(t, '[^{_BLANKS}]+') AS w FROM t), q AS (SELECT row_idx, ratio, CAST(floor(len(w) * ratio) AS INT) AS cut, w FROM w, (VALUES (0.3::DOUBLE), (0.5), (0.7)) v(ratio) WHERE len(w) >= 150)"


@query(f"""{_CUT}, s AS (SELECT row_idx, ratio, list_transform(w[cut + 1:], lambda x: lower(x)) AS a, list_transform(w[:cut], lambda x: lower(x))[:CAST(floor((len(w) - cut) * 1.5) AS INT)] AS b FROM q WHERE len(w) - cut >= 30 AND cut >= 10),
b AS (SELECT row_idx, ratio, round(0.25 * {_F1(2)} + 0.5 * {_F1(3)} + 0.25 * {_F1(4)}, 4) AS m FROM s),
g AS (SELECT row_idx, arg_min(m, CASE WHEN ratio = .5 THEN 0 ELSE ratio END) AS m, count(*) AS cuts, avg(m) AS mean, CASE WHEN count(*) >= 2 THEN greatest(1 - var_samp(m) / .02, 0) ELSE 0 END AS st FROM b GROUP BY row_idx),
v AS (SELECT *, CASE WHEN m >= .22 THEN 'RED' WHEN m >= .12 THEN 'AMBER' WHEN m >= .08 THEN 'YELLOW' ELSE 'GREEN' END AS d FROM g),
c AS (SELECT *, round(CASE d WHEN 'RED' THEN least(.6::DOUBLE + m, .9::DOUBLE) WHEN 'AMBER' THEN least(.4::DOUBLE + m, .7::DOUBLE) WHEN 'YELLOW' THEN least(.2::DOUBLE + m, .4::DOUBLE) ELSE greatest(.1::DOUBLE - m, 0) END, 4) AS c FROM v)
SELECT row_idx, m AS bscore, m AS bscore_max, d AS determination, CASE WHEN st >= .75 AND mean >= .15 THEN round(least(c + .1::DOUBLE, 1), 4) ELSE c END AS confidence, round(st, 4) AS stability, cuts FROM c""")
def regeneration_scores(spark, d):
    """Batch continuation with responses given as a table: here each text's own beginning is what was answered."""
    asked = materialize(continuations.requests(spread(_texts(spark, d)), "row_idx", "t", samples=1), "requests")
    responses = asked.select("custom_id", F.col("prefix").alias("text"))
    return continuations.score_responses(asked, responses, "row_idx")


@query()
def report_pages(spark, d):
    """The HTML page of every scored row."""
    rows = table(spark, d, "tasks").select("row_idx", "prompt")
    return reports.single(_scored(spark, d).join(rows.withColumnRenamed("prompt", "raw"), "row_idx"), "row_idx", "raw")


@query()
def console_lines(spark, d):
    return reports.console(_scored(spark, d), "row_idx")


@query(f"""SELECT batch_id, count(*) AS n, count(*) FILTER ({_FL}) AS flagged FROM submissions GROUP BY 1""")
def sql_functions(spark, d):
    """The registered names used from SQL."""
    names.register(spark)
    table(spark, d, "submissions").createOrReplaceTempView("ink_submissions")
    return spark.sql("SELECT batch_id, count(*) AS n, count_if(ink_is_flagged(determination)) AS flagged FROM ink_submissions GROUP BY batch_id")


@query(f"""SELECT determination, ground_truth, count(*) AS n FROM (SELECT CASE WHEN calibrated_confidence >= .85 THEN 'RED' WHEN calibrated_confidence >= .65 THEN 'AMBER' WHEN calibrated_confidence >= .4 THEN 'YELLOW' WHEN calibrated_confidence >= .15 THEN 'REVIEW' ELSE 'GREEN' END AS determination,
 ground_truth FROM results JOIN confirmed USING (task_id) WHERE calibrated_confidence BETWEEN 0 AND 1) GROUP BY ALL""")
def model_verdicts(spark, d):
    """Verdicts that a probability gives by itself, against the confirmed truth."""
    p = table(spark, d, "results").where("calibrated_confidence between 0 and 1").select("task_id", models.ml_determination(F.col("calibrated_confidence")).alias("determination"))
    return p.join(table(spark, d, "confirmed").select("task_id", "ground_truth"), "task_id").groupBy("determination", "ground_truth").agg(F.count(F.lit(1)).alias("n"))
