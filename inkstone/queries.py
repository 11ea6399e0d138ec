"""Queries over the test tables, each with the SQL it is compared with where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone import signal_sql
from inkstone.functions import lexicon, tables, text
from inkstone.operators import cohort, continuations, models, pair_analysis, residue_python, sequences, signals, similarity
from inkstone.plans import pipeline
from inkstone.session import materialize, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tasks").select("row_idx", F.coalesce("prompt", F.lit("")).alias("t"))


_T = "t AS (SELECT row_idx, coalesce(prompt, '') AS t FROM tasks)"
_WC = r"len(regexp_extract_all(t, '[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'))"
_q = lambda s: "'" + s.replace("'", "''") + "'"
_n = lambda p, flags="", c="t": f"len(regexp_extract_all({c}, {_q((f'(?{flags})' if flags else '') + p)}))"
_FW = "[" + ", ".join(_q(w) for w in tables.FUNCTION_WORDS) + "]"
_SENT = r"list_filter(string_split(regexp_replace(t, '([.!?])[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]'))"


# Text preparation ----------------------------------------------------------------------------------


@query(f"WITH {_T} SELECT row_idx, {_WC} AS words, len({_SENT}) AS sentences, CASE WHEN {_WC} < 100 THEN 'short' WHEN {_WC} < 300 THEN 'medium' WHEN {_WC} < 800 THEN 'long' ELSE 'very_long' END AS length_bin FROM t")
def text_shape(spark, d):
    t = F.col("t")
    return _texts(spark, d).select("row_idx", text.word_count(t).alias("words"), F.size(text.sentences(t)).alias("sentences"), text.length_bin(text.word_count(t)).alias("length_bin"))


@query(rf"""WITH {_T}, w AS (SELECT row_idx, regexp_extract_all(lower(t), '[\p{{L}}\p{{M}}\p{{N}}_]+') AS ws FROM t)
SELECT row_idx, len(ws) AS tokens, CASE WHEN len(ws) > 0 THEN round(len(list_distinct(ws)) / len(ws), 6) ELSE 0.0 END AS ttr FROM w""")
def type_token_ratio(spark, d):
    w = _texts(spark, d).select("row_idx", text.word_tokens(F.col("t")).alias("w"))
    return w.select("row_idx", F.size("w").alias("tokens"), F.round(text.type_token_ratio(F.col("w")), 6).alias("ttr"))


@query(rf"""WITH {_T}, c AS (SELECT row_idx, {_WC} AS n, len(list_filter(regexp_extract_all(lower(t), '[^\s\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'), lambda w: list_contains({_FW}, w))) AS fw,
 {_n(r'\p{L}')} AS l, {_n(r'[A-Za-zªµºÀ-ÖØ-öø-ɏ]')} - {_n('[ªµº]')} AS la FROM t),
r AS (SELECT row_idx, n, fw / greatest(n, 1) AS f, (l - la) / greatest(l, 1) AS x FROM c)
SELECT row_idx, CASE WHEN n < 30 THEN 'REVIEW' WHEN x > .3 THEN 'UNSUPPORTED' WHEN f < .08 THEN 'UNSUPPORTED' WHEN f < .12 THEN 'REVIEW' WHEN x > .1 THEN 'REVIEW' ELSE 'SUPPORTED' END AS support_level,
 CASE WHEN n < 30 THEN 0.0 ELSE round(f, 4) END AS fw_coverage, CASE WHEN n < 30 THEN 0.0 ELSE round(x, 4) END AS non_latin_ratio FROM r""")
def language_gate(spark, d):
    return _texts(spark, d).select("row_idx", text.language_gate(F.col("t")).alias("g")).select("row_idx", "g.*")


@query(signal_sql.SQL["topic_mask"])
def topic_mask(spark, d):
    masked, n = text.mask_topics(F.col("t"))
    return _texts(spark, d).select("row_idx", n.alias("masks"), F.length(masked).alias("masked_length"))


@query()
def normalize_text(spark, d):
    return spread(_texts(spark, d)).select("row_idx", residue_python.normalized(F.col("t")).alias("n")).select("row_idx", "n.*")


@query(rf"""WITH {_T}, w AS (SELECT row_idx, regexp_extract_all(lower(t), '[\p{{L}}\p{{M}}\p{{N}}_]+') AS ws FROM t),
g AS (SELECT row_idx, CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3]) ELSE [] END AS gs FROM w)
SELECT row_idx, CASE WHEN len(gs) > 0 THEN round(1 - len(list_distinct(gs)) / len(gs), 6) ELSE 0.0 END AS repeat4 FROM g""")
def repeated_ngrams(spark, d):
    g = _texts(spark, d).select("row_idx", text.bound(text.word_tokens(F.col("t")), lambda w: text.ngrams(w, 4)).alias("g"))
    return g.select("row_idx", F.round(F.when(F.size("g") > 0, 1 - F.size(F.array_distinct("g")) / F.size("g")).otherwise(0.0), 6).alias("repeat4"))


# Signals -------------------------------------------------------------------------------------------


def _signal(spark, d, builder, cols: list[str] | None = None) -> DataFrame:
    s = spread(_texts(spark, d)).select("row_idx", builder(F.col("t")).alias("s"))
    return s.select("row_idx", *([f"s.{c}" for c in cols] if cols else ["s.*"]))


def _preamble_sql() -> str:
    on = [f"CASE WHEN regexp_matches({'substr(t, 1, 500)' if head else 't'}, {_q(p)}) THEN {_q(sev)} END" for _, sev, head, p in tables.PREAMBLE]
    return f"""WITH {_T}, h AS (SELECT row_idx, list_filter([{', '.join(on)}], lambda x: x IS NOT NULL) AS h FROM t)
SELECT row_idx, len(h) AS hits, CASE WHEN list_contains(h, 'CRITICAL') THEN 'CRITICAL' WHEN list_contains(h, 'HIGH') THEN 'HIGH' WHEN list_contains(h, 'MEDIUM') THEN 'MEDIUM' ELSE 'NONE' END AS severity FROM h"""


@query(_preamble_sql())
def preamble(spark, d):
    return _signal(spark, d, signals.preamble, ["hits", "severity"])


@query(f"WITH {_T}, h AS (SELECT row_idx, {_n(chr(92) + 'b(?:' + '|'.join(tables.FINGERPRINT_WORDS) + ')' + chr(92) + 'b', 'i')} AS hits, {_WC} AS n FROM t) SELECT row_idx, hits, round(least(hits / greatest(n / 1000, 1) / 5, 1), 6) AS score FROM h")
def fingerprint_words(spark, d):
    return _signal(spark, d, signals.fingerprint).select("row_idx", "hits", F.round("score", 6).alias("score"))


def _signature_sql() -> str:
    counts = ", ".join(_n(p, "i") for p in tables.CONSTRAINT_FRAMES)
    meta = " + ".join(f"CAST(regexp_matches(t, {_q('(?i)' + p)}) AS INT)" for p in tables.META_DESIGN)
    return f"""WITH {_T}, c AS (SELECT row_idx, [{counts}] AS f, greatest(len({_SENT}), 1) AS n, {meta} AS meta_design_hits, {_n(tables.NUMBERED, 'm')} AS numbered_criteria,
 {_n(chr(92) + 'bmust' + chr(92) + 'b', 'i')} AS must_count, {' + '.join(_n(p, 'i') for p in tables.CONDITIONS)} AS cond FROM t)
SELECT row_idx, round(list_sum(f) / n, 6) AS cfd, len(list_filter(f, lambda x: x > 0)) AS distinct_frames, meta_design_hits, must_count, numbered_criteria, round(cond / n, 6) AS conditional_density FROM c"""


@query(_signature_sql())
def prompt_signature(spark, d):
    s = _signal(spark, d, signals.prompt_signature)
    return s.select("row_idx", F.round("cfd", 6).alias("cfd"), "distinct_frames", "meta_design_hits", "must_count", "numbered_criteria", F.round("conditional_density", 6).alias("conditional_density"))


@query(signal_sql.SQL["voice_dissonance"])
def voice_dissonance(spark, d):
    return _rounded(_signal(spark, d, signals.voice_dissonance), vsd=4)


def _idi_sql() -> str:
    b = chr(92) + "b"
    among = lambda ws: f"len(list_filter(ws, lambda w: list_contains([{', '.join(map(_q, ws))}], w)))"
    return rf"""WITH {_T}, w AS (SELECT *, regexp_extract_all(lower(t), '[\p{{L}}\p{{M}}\p{{N}}_]+') AS ws FROM t),
c AS (SELECT row_idx, {among(tables.IMPERATIVES)} AS imperatives, {among(tables.CONDITIONALS)} AS conditionals,
 {_n(b + '(?:Yes|No)' + b)} AS binary_specs, {_n(b + 'MISSING' + b)} AS missing_refs, {_n(b + '[Ff]lag' + b)} AS flag_count, greatest({_WC} / 100, 1) AS per FROM w)
SELECT row_idx, imperatives, conditionals, binary_specs, missing_refs, flag_count, round((imperatives + 2 * conditionals + 1.5 * binary_specs + 3 * missing_refs + 2 * flag_count) / per, 6) AS idi FROM c"""


@query(_idi_sql())
def instruction_density(spark, d):
    s = _signal(spark, d, signals.instruction_density)
    return s.select("row_idx", "imperatives", "conditionals", "binary_specs", "missing_refs", "flag_count", F.round("idi", 6).alias("idi"))


@query(signal_sql.SQL["lexicon_packs"])
def lexicon_packs(spark, d):
    s = spread(_texts(spark, d)).select("row_idx", signals.lexicon_packs(F.col("t")).alias("s"))
    return s.select("row_idx", *[F.round(F.col(f"s.{n}.weighted"), 4).alias(n) for n in lexicon.PACKS])


def _rounded(rows: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    return rows.select(*[F.round(c, other.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


@query(signal_sql.SQL["expository_signals"])
def expository_signals(spark, d):
    return _rounded(_signal(spark, d, signals.expository))


@query()
def self_similarity(spark, d):
    df = spread(_texts(spark, d)).select("row_idx", signals.expository(F.col("t")).alias("e"), residue_python.compression(F.col("t")).alias("z"))
    return df.select("row_idx", signals.self_similarity(F.col("e"), F.col("z.comp_ratio"), F.col("z.shuffled_comp_ratio")).alias("s")).select("row_idx", "s.*")


@query(signal_sql.SQL["stylometry"])
def stylometry(spark, d):
    return _signal(spark, d, signals.stylometry)


@query(signal_sql.SQL["sentence_windows"])
def sentence_windows(spark, d):
    return _signal(spark, d, signals.windows, ["max_window_score", "mean_window_score", "window_variance", "hot_span_length", "n_windows", "mixed_signal", "fw_trajectory_cv"])


@query(rf"""WITH {_T}, w AS (SELECT row_idx, regexp_extract_all(lower(t), '[\p{{L}}\p{{M}}\p{{N}}_]+') AS ws FROM t WHERE t <> '')
SELECT row_idx, round(CASE WHEN len(ws) < 50 THEN len(list_distinct(ws)) / len(ws) ELSE list_avg(list_transform(range(1, len(ws) - 48), lambda i: len(list_distinct(ws[i:i+49])) / 50)) END, 6) AS mattr FROM w WHERE len(ws) > 0""")
def moving_vocabulary(spark, d):
    return sequences.mattr(_texts(spark, d).where("t != ''"), "row_idx", text.word_tokens(F.col("t")))


@query(rf"""WITH {_T}, w AS (SELECT row_idx, unnest(list_filter(list_transform(regexp_extract_all(t, '[^\s\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'), lambda x: lower(trim(x, '.,!?"''():;'))), lambda x: x <> '')) AS w FROM t),
c AS (SELECT row_idx, w, count(*) AS n FROM w GROUP BY ALL)
SELECT row_idx, count(*) FILTER (n = 1) AS hapax_count, count(*) AS unique_words FROM c GROUP BY row_idx""")
def hapax(spark, d):
    w = _texts(spark, d).select("row_idx", F.explode(F.transform(text.words(F.col("t")), lambda w: F.lower(F.btrim(w, F.lit(""".,!?"'():;"""))))).alias("w")).where("w != ''")
    c = w.groupBy("row_idx", "w").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("row_idx").agg(F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).cast("bigint").alias("hapax_count"), F.count(F.lit(1)).alias("unique_words"))


@query(rf"""WITH {_T}, g AS (SELECT unnest(list_transform(range(1, length(t) - 2), lambda i: lower(substr(t, i, 4)))) AS gram FROM t WHERE length(t) > 3),
c AS (SELECT gram, count(*) AS n FROM g WHERE gram[1] <> '_' GROUP BY gram)
SELECT gram, n FROM c ORDER BY n DESC, gram LIMIT 50""")
def char_4grams(spark, d):
    """The fifty most frequent runs of four characters of the whole table."""
    t = _texts(spark, d).where(F.length("t") > 3)
    g = t.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 3), lambda i: F.lower(F.substring(F.col("t"), i, F.lit(4))))).alias("gram"))
    return g.where(~F.startswith("gram", F.lit("_"))).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "gram").limit(50)


@query()
def char_profiles(spark, d):
    """Each text's fifty most frequent runs of four characters, masked, with their relative frequency."""
    return spread(_texts(spark, d)).select("row_idx", signals.char_profile(F.col("t")).alias("profile"))


@query()
def punctuation_profiles(spark, d):
    """Each text's twenty most frequent pairs of successive marks of any script."""
    return spread(_texts(spark, d)).select("row_idx", signals.punctuation_profile(F.col("t")).alias("profile"))


@query()
def continuation_local(spark, d):
    return spread(_texts(spark, d)).select("row_idx", residue_python.continuation(F.col("t")).alias("c")).select("row_idx", "c.*")


@query()
def signal_spans(spark, d):
    s = spread(_texts(spark, d)).select("row_idx", F.explode(residue_python.spans(F.col("t"))).alias("s"))
    return s.select("row_idx", "s.*")


def _halves(spark, d) -> DataFrame:
    w = _texts(spark, d).select("row_idx", text.word_tokens(F.col("t")).alias("w")).withColumn("h", F.floor(F.size("w") / 2).cast("int"))
    return w.select("row_idx", F.slice("w", 1, F.col("h")).alias("a"), F.expr("slice(w, h + 1, size(w))").alias("b"))


_F1 = lambda n: (
    f"CASE WHEN len(a) >= {n} AND len(b) >= {n} THEN 2.0 * len(list_intersect({{a{n}}}, {{b{n}}})) / (len(list_distinct({{a{n}}})) + len(list_distinct({{b{n}}}))) ELSE 0 END"
).format(**{f"{s}{n}": f"list_transform(range(1, len({s}) - {n - 2}), lambda i: array_to_string({s}[i:i+{n - 1}], ' '))" for s in "ab"})


@query(rf"""WITH {_T}, w AS (SELECT row_idx, regexp_extract_all(lower(t), '[\p{{L}}\p{{M}}\p{{N}}_]+') AS ws FROM t), h AS (SELECT row_idx, ws[:len(ws) // 2] AS a, ws[len(ws) // 2 + 1:] AS b FROM w),
s AS (SELECT row_idx, 0.25 * {_F1(2)} + 0.5 * {_F1(3)} + 0.25 * {_F1(4)} AS b FROM h)
SELECT row_idx, round(b, 6) AS bscore, CASE WHEN b >= .22 THEN 'RED' WHEN b >= .12 THEN 'AMBER' WHEN b >= .08 THEN 'YELLOW' ELSE 'GREEN' END AS determination FROM s""")
def half_overlap(spark, d):
    """How much of a text's second half repeats its first: the continuation score without a model."""
    b = spread(_halves(spark, d)).select("row_idx", continuations.overlap_score(F.col("a"), F.col("b")).alias("b"))
    return b.select("row_idx", F.round("b", 6).alias("bscore"), continuations.determination(F.col("b"), F.col("b")).alias("determination"))


@query(rf"""WITH {_T} SELECT row_idx, contains(t, chr(10) || chr(10)) AS paragraphs, regexp_matches(t, '(?m)^\d+[.)]\s') AS numbered, regexp_matches(t, '(?m)^[-•]\s') AS bullets, regexp_matches(t, '(?m)^#+\s') AS headings FROM t""")
def format_flags(spark, d):
    return _texts(spark, d).select("row_idx", continuations.format_flags(F.col("t")).alias("f")).select("row_idx", "f.*")


@query(rf"""WITH {_T}, p AS (SELECT regexp_extract_all(t, '[!-/:-@\[-^`{{-~]') AS p FROM t), b AS (SELECT unnest(list_transform(range(1, len(p)), lambda i: p[i] || p[i+1])) AS pair FROM p WHERE len(p) > 1)
SELECT pair, count(*) AS n FROM b GROUP BY pair ORDER BY n DESC, pair LIMIT 20""")
def punctuation_pairs(spark, d):
    """The twenty most frequent pairs of successive ASCII punctuation marks, whatever stands between."""
    p = _texts(spark, d).select(F.regexp_extract_all("t", F.lit(r"([!-/:-@\[-^`{-~])"), F.lit(1)).alias("p")).where(F.size("p") > 1)
    pairs = p.select(F.explode(text.bound(F.col("p"), lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.concat(F.get(p, i - 1), F.get(p, i))))).alias("pair"))
    return pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "pair").limit(20)


# Fusion --------------------------------------------------------------------------------------------


def _scored(spark, d, models: bool = True, disabled: tuple[str, ...] = ()) -> DataFrame:
    return pipeline.score(spread(table(spark, d, "tasks").select("row_idx", "occupation", "attempter", "prompt")), "prompt", models, disabled)


@query()
def verdicts(spark, d):
    return _scored(spark, d, True).select("row_idx", "occupation", "attempter", "verdict.*")


@query()
def verdicts_ablated(spark, d):
    return _scored(spark, d, disabled=("windowing",)).select("row_idx", "verdict.determination", "verdict.confidence", "verdict.triggering_rule")


@query()
def structural_vectors(spark, d):
    """The sixteen structural features of every submission, as a fingerprint keeps them."""
    v = pipeline.structural_vector(_scored(spark, d, True))
    return v.select("row_idx", F.transform("structural_vec", lambda x: F.round(x, 6)).alias("structural_vec"))


@query()
def channel_counts(spark, d):
    s = materialize(_scored(spark, d).select("channels"), "channels").select(F.explode("channels").alias("c"))
    return s.groupBy("c.channel", "c.severity").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c.score"), 4).alias("mean_score"))


@query()
def channel_patterns(spark, d):
    """Leading channel of the flagged rows: how many rows it leads, and the first of them."""
    s = materialize(_scored(spark, d).select("row_idx", F.col("verdict.determination").alias("determination"), "channels"), "verdicts")
    active = F.filter("channels", lambda c: c["level"] > 0)
    lead = F.array_sort(active, lambda a, b: F.sign(b["level"] - a["level"]).cast("int"))
    led = s.where(cohort.is_flagged(F.col("determination"))).select("row_idx", F.get(lead, F.lit(0))["channel"].alias("channel")).where("channel is not null")
    return led.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first_row"))


@query()
def api_reports(spark, d):
    return pipeline.report(_scored(spark, d)).select("row_idx", "report")


# Similarity ----------------------------------------------------------------------------------------


def _shingled(spark, d) -> DataFrame:
    tasks = table(spark, d, "tasks").where("prompt is not null")
    return tasks.select("row_idx", F.trim(F.coalesce("occupation", F.lit(""))).alias("occupation"), "attempter", text.shingle_set(F.col("prompt")).alias("s"))


_SHINGLES = r"""w AS (SELECT row_idx, trim(coalesce(occupation, '')) AS occupation, attempter, regexp_extract_all(lower(prompt), '[\p{L}\p{M}\p{N}_]+') AS ws FROM tasks WHERE prompt IS NOT NULL),
s AS (SELECT row_idx, occupation, attempter, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2])) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w)"""


@query(f"""WITH {_SHINGLES}, x AS (SELECT row_idx, occupation, len(sh) AS n, unnest(sh) AS g FROM s),
o AS (SELECT a.row_idx AS row_idx_a, b.row_idx AS row_idx_b, a.occupation, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.occupation = b.occupation AND a.row_idx < b.row_idx GROUP BY ALL)
SELECT row_idx_a, row_idx_b, occupation, round(k / (na + nb - k), 6) AS jaccard FROM o WHERE k / (na + nb - k) >= 0.4""")
def similarity_pairs(spark, d):
    return similarity.jaccard_pairs(_shingled(spark, d), "row_idx", "occupation", "s", 0.40).withColumn("jaccard", F.round("jaccard", 6))


_ALL_PAIRS = f"""{_SHINGLES}, x AS (SELECT row_idx, occupation, unnest(sh) AS g FROM s),
k AS (SELECT a.row_idx AS a, b.row_idx AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.occupation = b.occupation AND a.row_idx < b.row_idx GROUP BY ALL),
v AS (SELECT row_idx, arg_max(structural_vec, (batch_ts, fp_id)) AS v FROM fingerprints GROUP BY row_idx), r AS (SELECT s.*, lower(trim(coalesce(attempter, ''))) AS who, coalesce(v, list_transform(range(16), lambda i: 0.0::DOUBLE)) AS v FROM s LEFT JOIN v USING (row_idx)),
p AS (SELECT p.row_idx AS a, q.row_idx AS b, p.occupation, p.who AS wa, q.who AS wb, len(p.sh) AS na, len(q.sh) AS nb, 1 / (1 + list_distance(p.v, q.v)) AS st FROM r p JOIN r q ON p.occupation = q.occupation AND p.row_idx < q.row_idx),
j AS (SELECT p.*, coalesce(k / (na + nb - k), 0) AS jac FROM p LEFT JOIN k USING (a, b)),
m AS (SELECT occupation, count(*) AS pairs, median(jac) AS jm, stddev_samp(jac) AS js, median(st) AS sm, stddev_samp(st) AS ss FROM j GROUP BY occupation HAVING count(*) >= 3)"""


@query(f"WITH {_ALL_PAIRS} SELECT occupation, pairs, round(u.m, 6) AS median, round(u.s, 6) AS spread, round(u.m + 2 * greatest(u.s, .02::DOUBLE), 6) AS outlier_above FROM (SELECT occupation, pairs, {{'m': jm, 's': js}} AS u FROM m)")
def similarity_baseline(spark, d):
    """Over all pairs of an occupation."""
    sets = pair_analysis.prepared(_shingled(spark, d), "row_idx", "occupation", None, "s")
    out = pair_analysis.baseline(sets).withColumn("outlier_above", F.col("median") + 2 * F.greatest("spread", F.lit(pair_analysis.LEAST_SPREAD)))
    return out.select(F.col("g").alias("occupation"), "pairs", *[F.round(c, 6).alias(c) for c in ("median", "spread", "outlier_above")])


_salt = lambda i: rf"\x00\x00\x00\x{i:02x}"


@query(f"""WITH {_SHINGLES}, x AS (SELECT row_idx, unnest(sh) AS g FROM s)
SELECT row_idx, array_to_string([{', '.join(f"min(CAST('0x' || substr(md5('{_salt(i)}'::BLOB || encode(g)), 1, 8) AS BIGINT))" for i in range(128))}], ',') AS signature FROM x GROUP BY row_idx""")
def minhash_signatures(spark, d):
    """All 128 values of each row, and their digest."""
    m = similarity.minhashed(spread(_shingled(spark, d).where(F.size("s") > 0)), "row_idx", "s")
    return m.select("row_idx", F.concat_ws(",", F.col("m").cast("array<string>")).alias("signature"))


@query(f"""WITH {_SHINGLES}, x AS (SELECT row_idx, unnest(sh) AS g FROM s), b AS (SELECT row_idx, min(batch_id) AS batch FROM fingerprints GROUP BY row_idx),
m AS (SELECT row_idx, i, min(CAST('0x' || substr(md5(unhex(printf('%08x', i)) || encode(g)), 1, 8) AS BIGINT)) AS v FROM x, range(128) t(i) GROUP BY ALL),
n AS (SELECT m.*, batch, lower(trim(coalesce(attempter, ''))) AS who FROM m JOIN b USING (row_idx) JOIN s USING (row_idx) WHERE batch IS NOT NULL)
SELECT c.row_idx AS cur_key, o.row_idx AS old_key, count(*) / 128 AS similarity FROM n c JOIN n o ON c.i = o.i AND c.v = o.v AND o.batch < c.batch WHERE c.who = '' OR o.who = '' OR c.who <> o.who GROUP BY ALL HAVING count(*) >= 64""")
def cross_batch(spark, d):
    """Each row belongs to the earliest batch that names it, as in problem 6."""
    named = table(spark, d, "fingerprints").groupBy("row_idx").agg(F.min("batch_id").alias("batch"))
    rows = spread(_shingled(spark, d).where(F.size("s") > 0))
    return similarity.earlier_batches_by_items(rows, "row_idx", "attempter", "s", named, "batch")


@query(f"""WITH {_ALL_PAIRS}, f AS (SELECT a, b, jac >= .4 AS t, st >= .9 AS u, coalesce(jac >= jm + 2 * greatest(js, .02::DOUBLE) AND jac > jm + .05 AND jac < .4, false) AS ta, coalesce(st >= sm + 2 * greatest(ss, .02::DOUBLE) AND st > sm + .03 AND st < .9, false) AS ua
 FROM j LEFT JOIN m USING (occupation) WHERE wa = '' OR wb = '' OR wa <> wb), e AS (SELECT a AS row_idx, ta OR ua AS ad FROM f WHERE t OR u OR ta OR ua UNION ALL SELECT b, ta OR ua FROM f WHERE t OR u OR ta OR ua),
c AS (SELECT row_idx, count(*) AS partners, bool_or(ad) AS ad FROM e GROUP BY row_idx), l AS (SELECT row_idx, determination FROM results WHERE row_idx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY scored_at DESC NULLS LAST, result_id DESC) = 1)
SELECT row_idx, determination, CASE WHEN ad AND determination IN ('GREEN', 'REVIEW') THEN 'YELLOW' ELSE determination END AS adjusted, coalesce(partners, 0) AS partners FROM l LEFT JOIN c USING (row_idx)""")
def similarity_feedback(spark, d):
    """Flags by each occupation's own thresholds; the structural vector is that of the latest fingerprint."""
    vectors = cohort.latest(table(spark, d, "fingerprints").select("row_idx", "structural_vec", "batch_ts", "fp_id"), "row_idx", ["batch_ts", "fp_id"])
    rows = _shingled(spark, d).join(vectors.select("row_idx", "structural_vec"), "row_idx", "left")
    sets = materialize(pair_analysis.prepared(rows, "row_idx", "occupation", "attempter", "s", "structural_vec"), "blocks")
    seen = pair_analysis.flag_counts(sets, materialize(pair_analysis.baseline(sets), "baseline"))
    last = cohort.latest(table(spark, d, "results").select("row_idx", "determination", "scored_at", "result_id"), "row_idx", ["scored_at", "result_id"])
    return similarity.raised(last, seen, "row_idx")


# Cohorts -------------------------------------------------------------------------------------------

_FL = "determination IN ('RED', 'AMBER', 'MIXED')"


@query("SELECT determination, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM results GROUP BY determination")
def det_distribution(spark, d):
    return cohort.distribution(table(spark, d, "results"), "determination")


@query(f"""SELECT trim(attempter) AS attempter, count(*) AS total, {', '.join(f"count(*) FILTER (determination = '{k}') AS n_{k.lower()}" for k in ('RED', 'AMBER', 'MIXED', 'YELLOW', 'REVIEW', 'GREEN'))},
 count(*) FILTER ({_FL}) AS flagged, round(avg(confidence) FILTER ({_FL}), 6) AS mean_flagged_confidence, count(DISTINCT occupation) AS occupations, round(count(*) FILTER ({_FL}) / count(*), 4) AS flag_rate
FROM submissions WHERE trim(attempter) <> '' GROUP BY 1 HAVING count(*) >= 2""")
def author_profiles(spark, d):
    return cohort.author_profiles(table(spark, d, "submissions"))


@query(f"""WITH p AS (SELECT trim(attempter) AS attempter, count(*) AS total, count(*) FILTER ({_FL}) AS flagged FROM submissions WHERE trim(attempter) <> '' GROUP BY 1 HAVING count(*) >= 2),
c AS (SELECT trim(attempter) AS attempter, count(*) FILTER (ground_truth = 'ai') AS ai, count(*) FILTER (ground_truth = 'human') AS human FROM confirmed WHERE trim(attempter) <> '' GROUP BY 1)
SELECT attempter, total, flagged, round(flagged / total, 4) AS flag_rate, coalesce(ai, 0) AS confirmed_ai, coalesce(human, 0) AS confirmed_human,
 CASE WHEN coalesce(ai, 0) > 0 AND round(flagged / total, 4) > .5 THEN 'CRITICAL' WHEN round(flagged / total, 4) > .3 OR coalesce(ai, 0) > 0 THEN 'HIGH' WHEN round(flagged / total, 4) > .15 THEN 'ELEVATED' ELSE 'NORMAL' END AS risk_tier
FROM p LEFT JOIN c USING (attempter)""")
def risk_report(spark, d):
    return cohort.risk_report(table(spark, d, "submissions"), table(spark, d, "confirmed"))


@query(f"""WITH p AS (SELECT trim(attempter) AS a, count(*) FILTER ({_FL}) AS f FROM submissions WHERE trim(attempter) <> '' GROUP BY 1),
n AS (SELECT count(*) AS authors, greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT)) AS top_authors, CAST(sum(f) AS BIGINT) AS flags FROM p),
r AS (SELECT f, row_number() OVER (ORDER BY f DESC) AS k FROM p)
SELECT authors, top_authors, flags, round(CASE WHEN flags > 0 THEN (SELECT sum(f) FROM r WHERE k <= top_authors) / flags ELSE 0 END, 4) AS held_share FROM n""")
def flag_concentration(spark, d):
    return cohort.concentration(table(spark, d, "submissions"))


_LAB = """l AS (SELECT c.ground_truth, r.confidence, r.determination, r.occupation, r.task_domain, r.length_bin, r.lang_support_level FROM (SELECT task_id, ground_truth FROM confirmed WHERE task_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY verified_at DESC NULLS LAST, confirm_id DESC) = 1) c
 JOIN (SELECT * FROM results WHERE task_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY scored_at DESC NULLS LAST, result_id DESC) = 1) r USING (task_id) WHERE r.confidence BETWEEN 0 AND 1 AND NOT isnan(r.confidence))"""


def _labelled(spark, d) -> DataFrame:
    """Latest confirmation of each task with its latest result in range."""
    truth = cohort.latest(table(spark, d, "confirmed").select("task_id", "ground_truth", "verified_at", "confirm_id"), "task_id", ["verified_at", "confirm_id"])
    scored = table(spark, d, "results").select("task_id", "confidence", "determination", "occupation", "task_domain", "length_bin", "lang_support_level", "scored_at", "result_id")
    last = cohort.latest(scored, "task_id", ["scored_at", "result_id"])
    return truth.select("task_id", "ground_truth").join(last, "task_id").where("confidence between 0 and 1 and not isnan(confidence)")


def _quantile_sql(alpha: float) -> str:
    return f"round(list_sort(list(nc))[least(greatest(CAST(ceil({1 - alpha} * (count(*) + 1) - 1e-9) AS BIGINT), 1), count(*))], 6) AS q{int(alpha * 100):02d}"


_STRATA = "coalesce(nullif(task_domain, ''), 'unknown') AS task_domain, coalesce(nullif(length_bin, ''), 'unknown') AS length_bin"


@query(f"""WITH {_LAB}, h AS (SELECT {_STRATA}, 1 - confidence AS nc FROM l WHERE ground_truth = 'human')
SELECT task_domain, length_bin, false AS is_global, count(*) AS n, {', '.join(map(_quantile_sql, (0.01, 0.05, 0.10)))} FROM h WHERE (SELECT count(*) FROM h) >= 20 GROUP BY task_domain, length_bin HAVING count(*) >= 10
UNION ALL SELECT NULL, NULL, true, count(*), {', '.join(map(_quantile_sql, (0.01, 0.05, 0.10)))} FROM h HAVING count(*) >= 20""")
def conformal_table(spark, d):
    return cohort.conformal_table(_labelled(spark, d))


def _plain_quantile(alpha: float) -> str:
    return f"list_sort(list(nc))[least(greatest(CAST(ceil({1 - alpha} * (count(*) + 1) - 1e-9) AS BIGINT), 1), count(*))] AS q{int(alpha * 100):02d}"


_QUANTILES = ", ".join(map(_plain_quantile, (0.01, 0.05, 0.10)))


@query(f"""WITH {_LAB}, h AS (SELECT {_STRATA}, 1 - confidence AS nc FROM l WHERE ground_truth = 'human'),
s AS (SELECT task_domain AS dom, length_bin AS bin, {_QUANTILES} FROM h WHERE (SELECT count(*) FROM h) >= 20 GROUP BY 1, 2 HAVING count(*) >= 10), g AS (SELECT {_QUANTILES} FROM h HAVING count(*) >= 20),
r AS (SELECT result_id, confidence, 1 - confidence AS nc, task_domain, length_bin, dom, bin, g.q01 AS gq, coalesce(s.q01, g.q01) AS q01, coalesce(s.q05, g.q05) AS q05, coalesce(s.q10, g.q10) AS q10 FROM results
 LEFT JOIN s ON dom = coalesce(nullif(task_domain, ''), 'unknown') AND bin = coalesce(nullif(length_bin, ''), 'unknown') LEFT JOIN g ON true WHERE confidence BETWEEN 0 AND 1)
SELECT result_id, confidence, task_domain, length_bin, CASE WHEN q01 IS NULL THEN NULL WHEN nc <= q01 THEN 1.0::DOUBLE WHEN nc <= q05 THEN 0.1 WHEN nc <= q10 THEN 0.05 ELSE 0.01 END AS conformity_level,
 round(CASE WHEN nc > q05 THEN least(confidence * 1.15::DOUBLE, 0.99::DOUBLE) WHEN nc < q10 THEN confidence * 0.75::DOUBLE ELSE confidence END, 6) AS calibrated,
 CASE WHEN dom IS NOT NULL THEN dom || '_' || bin WHEN gq IS NOT NULL THEN 'global' ELSE 'uncalibrated' END AS stratum FROM r""")
def calibrated_results(spark, d):
    rows = table(spark, d, "results").select("result_id", "confidence", "task_domain", "length_bin").where("confidence between 0 and 1")
    return cohort.calibrate(rows, materialize(cohort.conformal_quantiles(_labelled(spark, d)), "conformal"))


_METRICS = ["confidence", "prompt_signature_composite", "instruction_density_idi", "voice_dissonance_vsd", "self_similarity_nssi_score"]


@query(f"""WITH u AS (SELECT occupation, metric, v FROM (SELECT occupation, unnest([{', '.join(_q(m) for m in _METRICS)}]) AS metric, unnest([{', '.join(_METRICS)}]) AS v FROM results)
 WHERE v IS NOT NULL AND NOT isnan(v)), k AS (SELECT occupation FROM results GROUP BY 1 HAVING count(*) >= 5)
SELECT occupation, metric, count(*) AS n, {', '.join(f"round(quantile_cont(v, {p}), 6) AS p{int(p * 100)}" for p in (.25, .5, .75, .9, .95, .99))}, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std
FROM u WHERE occupation IN (SELECT occupation FROM k) GROUP BY occupation, metric HAVING count(*) >= 3""")
def baseline_percentiles(spark, d):
    return cohort.percentiles(table(spark, d, "results"), "occupation", _METRICS)


@query(f"""WITH {_LAB}, t AS (SELECT confidence AS s, count(*) FILTER (ground_truth = 'ai') AS p, count(*) FILTER (ground_truth = 'human') AS n FROM l WHERE ground_truth IN ('ai', 'human') GROUP BY 1),
c AS (SELECT s, sum(p) OVER o / sum(p) OVER () AS tpr, sum(n) OVER o / sum(n) OVER () AS fpr, sum(p + n) OVER () AS k FROM t WINDOW o AS (ORDER BY s DESC)),
f AS (SELECT max_fpr, tpr, s FROM c, (VALUES (0.01::DOUBLE), (0.05), (0.10)) v(max_fpr) WHERE fpr <= max_fpr AND k >= 20)
SELECT max_fpr, round(arg_max(tpr, (tpr, s)), 6) AS tpr, arg_max(s, (tpr, s)) AS threshold FROM f GROUP BY max_fpr""")
def tpr_at_fpr(spark, d):
    return cohort.tpr_at_fpr(_labelled(spark, d), "confidence")


@query(f"WITH {_LAB} SELECT ground_truth, count(*) AS n, count(*) FILTER (determination IN ('RED', 'AMBER')) AS flagged, round(count(*) FILTER (determination IN ('RED', 'AMBER')) / count(*), 4) AS flag_rate FROM l GROUP BY 1")
def flag_rate_by_truth(spark, d):
    return cohort.flag_rates(_labelled(spark, d), ["ground_truth"])


@query(f"""WITH {_LAB}, r AS (SELECT lang_support_level, round(count(*) FILTER ({_FL}) / count(*), 4) AS flag_rate FROM l WHERE ground_truth = 'human' GROUP BY 1 HAVING count(*) >= 3)
SELECT max(flag_rate) AS highest, min(flag_rate) AS lowest, count(*) AS groups, round(max(flag_rate) - min(flag_rate), 4) AS gap, round(max(flag_rate) - min(flag_rate), 4) > 0.10 AS warning FROM r""")
def fairness_disparity(spark, d):
    human = _labelled(spark, d).where("ground_truth = 'human'")
    return cohort.disparity(cohort.flag_rates(human, ["lang_support_level"], cohort.FLAGGED, 3), 0.10)


@query(f"""WITH {_LAB}, b AS (SELECT least(CAST(floor(confidence * 10) AS INT), 9) AS bin, confidence AS s, CASE WHEN ground_truth = 'ai' THEN 1.0::DOUBLE ELSE 0 END AS y FROM l WHERE ground_truth IN ('ai', 'human'))
SELECT bin, count(*) AS n, round(avg(s), 4) AS mean_confidence, round(avg(y), 4) AS ai_rate, round(abs(avg(s) - avg(y)), 4) AS gap FROM b GROUP BY bin""")
def reliability(spark, d):
    return cohort.reliability(_labelled(spark, d))


@query(f"""WITH {_LAB}, c AS (SELECT count(*) FILTER ({_FL} AND ground_truth = 'ai') AS tp, count(*) FILTER ({_FL} AND ground_truth = 'human') AS fp, count(*) FILTER (NOT coalesce({_FL}, false) AND ground_truth = 'human') AS tn,
 count(*) FILTER (NOT coalesce({_FL}, false) AND ground_truth = 'ai') AS fn FROM l WHERE ground_truth IN ('ai', 'human'))
SELECT *, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round((tp + tn) / (tp + fp + tn + fn), 4) AS accuracy, round(fp / (fp + tn), 4) AS fpr FROM c""")
def confusion(spark, d):
    return cohort.confusion(_labelled(spark, d))


@query("""SELECT occupation, count(*) AS n, round(median(confidence), 6) AS confidence, round(median(word_count), 6) AS word_count FROM submissions WHERE NOT coalesce(isnan(confidence), false) GROUP BY 1 HAVING count(*) >= 5""")
def occupation_context(spark, d):
    rows = table(spark, d, "submissions").where("not coalesce(isnan(confidence), false)")
    return rows.groupBy("occupation").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("confidence"), 6).alias("confidence"), F.round(F.median("word_count"), 6).alias("word_count")).where("n >= 5")


@query("""SELECT count(*) FILTER (ground_truth IN ('ai', 'human')) AS labelled, count(*) FILTER (ground_truth = 'ai') AS ai, count(*) FILTER (ground_truth = 'human') AS human,
 count(*) FILTER (ground_truth IN ('ai', 'human')) >= 200 AND least(count(*) FILTER (ground_truth = 'ai'), count(*) FILTER (ground_truth = 'human')) >= 30 AS ready FROM confirmed""")
def training_readiness(spark, d):
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int")).cast("bigint")
    g = F.col("ground_truth")
    c = table(spark, d, "confirmed").agg(n(g.isin("ai", "human")).alias("labelled"), n(g == "ai").alias("ai"), n(g == "human").alias("human"))
    return c.withColumn("ready", (F.col("labelled") >= 200) & (F.least("ai", "human") >= 30))


@query("""SELECT (SELECT count(*) FROM submissions) AS submissions, (SELECT count(*) FROM fingerprints) AS fingerprints, (SELECT count(*) FROM confirmed) AS confirmed,
 (SELECT count(DISTINCT batch_id) FROM submissions) AS batches, (SELECT count(DISTINCT trim(attempter)) FILTER (trim(attempter) <> '') FROM submissions) AS attempters""")
def store_summary(spark, d):
    n = lambda t: table(spark, d, t).agg(F.count(F.lit(1)).alias(t))
    s = table(spark, d, "submissions").agg(F.count(F.lit(1)).alias("submissions"), F.countDistinct("batch_id").alias("batches"), F.countDistinct(cohort.clean(F.col("attempter"))).alias("attempters"))
    return s.join(n("fingerprints"), F.lit(True)).join(n("confirmed"), F.lit(True))  # three one-row tables


@query("""WITH k AS (SELECT task_id, ground_truth AS g FROM confirmed WHERE task_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY verified_at DESC NULLS LAST, confirm_id DESC) = 1),
x AS (SELECT task_id, arg_max(text, rec_id) AS text FROM corpus WHERE task_id IS NOT NULL AND text IS NOT NULL GROUP BY 1),
t AS (SELECT g, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '\\p{L}{3,}'))) AS token FROM x JOIN k USING (task_id) WHERE g IN ('ai', 'human')),
c AS (SELECT token, count(*) FILTER (g = 'ai') AS n_ai, count(*) FILTER (g = 'human') AS n_human FROM t GROUP BY 1), s AS (SELECT sum(n_ai) AS a, sum(n_human) AS h, count(*) AS v FROM c)
SELECT * FROM (SELECT token, n_ai, n_human, round(ln(((n_ai + .05) / (a + .05 * v)) / ((n_human + .05) / (h + .05 * v))), 4) AS log_odds FROM c, s WHERE n_ai >= 10 AND a >= 500 AND h >= 500) WHERE log_odds > 1.5""")
def lexicon_discovery(spark, d):
    truth = cohort.latest(table(spark, d, "confirmed").select("task_id", "ground_truth", "verified_at", "confirm_id"), "task_id", ["verified_at", "confirm_id"])
    texts = cohort.latest(table(spark, d, "corpus").where("text is not null").select("task_id", "text", "rec_id"), "task_id", ["rec_id"])
    return cohort.log_odds(texts.join(truth, "task_id"), F.col("text"), "ground_truth")


@query("""SELECT CASE WHEN norm_homoglyphs > 0 AND norm_invisible_chars > 0 THEN 'combined' WHEN norm_homoglyphs > 0 THEN 'homoglyph' WHEN norm_invisible_chars > 0 THEN 'zero_width' ELSE 'none' END AS attack_type, count(*) AS n FROM results GROUP BY 1""")
def attack_types(spark, d):
    return table(spark, d, "results").groupBy(cohort.attack_type(F.col("norm_homoglyphs"), F.col("norm_invisible_chars")).alias("attack_type")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT task_id, arg_min(struct_pack(sub_id, determination, confidence), sub_id) AS x FROM submissions WHERE task_id IS NOT NULL GROUP BY 1)
SELECT confirm_id, c.task_id, ground_truth, s.x.sub_id AS sub_id, s.x.determination AS determination FROM confirmed c LEFT JOIN s ON c.task_id = s.task_id""")
def confirmations_enriched(spark, d):
    first = table(spark, d, "submissions").where("task_id is not null").groupBy("task_id").agg(F.min_by(F.struct("sub_id", "determination"), "sub_id").alias("x"))
    return table(spark, d, "confirmed").join(first, "task_id", "left").select("confirm_id", "task_id", "ground_truth", "x.sub_id", "x.determination")


@query(f"""WITH s AS (SELECT task_id, determination AS det FROM submissions WHERE task_id <> '' QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY recorded_at DESC NULLS LAST, sub_id DESC) = 1),
k AS (SELECT task_id, ground_truth AS g FROM confirmed WHERE task_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY verified_at DESC NULLS LAST, confirm_id DESC) = 1)
SELECT task_id, det AS determination, g AS ground_truth, CASE WHEN det IN ('RED', 'AMBER', 'MIXED') AND g = 'human' THEN 'rule_only' WHEN NOT det IN ('RED', 'AMBER', 'MIXED') AND g = 'ai' THEN 'truth_only' END AS disagreement FROM s JOIN k USING (task_id)""")
def verdicts_against_truth(spark, d):
    subs = table(spark, d, "submissions").where("task_id != ''").select("task_id", "determination", "recorded_at", "sub_id")
    last = cohort.latest(subs, "task_id", ["recorded_at", "sub_id"])
    truth = cohort.latest(table(spark, d, "confirmed").select("task_id", "ground_truth", "verified_at", "confirm_id"), "task_id", ["verified_at", "confirm_id"])
    flag = F.col("determination").isin(*cohort.FLAGGED)
    kind = F.when(flag & (F.col("ground_truth") == "human"), "rule_only").when(~flag & (F.col("ground_truth") == "ai"), "truth_only")
    return last.join(truth, "task_id").select("task_id", "determination", "ground_truth", kind.alias("disagreement"))


@query(f"SELECT result_id, determination, confidence FROM results WHERE {_FL} AND NOT isnan(confidence) ORDER BY confidence DESC, result_id LIMIT 50")
def top_flagged(spark, d):
    rows = table(spark, d, "results").where(cohort.is_flagged(F.col("determination")) & ~F.isnan("confidence") & F.col("confidence").isNotNull())
    return rows.select("result_id", "determination", "confidence").orderBy(F.col("confidence").desc(), "result_id").limit(50)


@query("""SELECT batch_id, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM submissions WHERE confidence IS NOT NULL AND NOT isnan(confidence) GROUP BY batch_id""")
def batch_metrics(spark, d):
    rows = table(spark, d, "submissions").where("confidence is not null and not isnan(confidence)")
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query("""SELECT determination, string_agg(result_id::VARCHAR, ' ' ORDER BY result_id) AS first_three FROM (SELECT *, row_number() OVER (PARTITION BY determination ORDER BY result_id) AS k FROM results) WHERE k <= 3 GROUP BY determination""")
def first_examples(spark, d):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("determination").orderBy("result_id"))
    kept = table(spark, d, "results").select("determination", "result_id", k.alias("k")).where("k <= 3")  # a limit per group, pruned before the shuffle
    return kept.groupBy("determination").agg(F.concat_ws(" ", F.array_sort(F.collect_list("result_id")).cast("array<string>")).alias("first_three"))


@query("SELECT row_idx, attempter FROM tasks WHERE contains(lower(attempter), 'kukal')")
def author_filter(spark, d):
    return table(spark, d, "tasks").where(F.lower("attempter").contains("kukal")).select("row_idx", "attempter")


@query(f"""SELECT batch_id, occupation, count(*) AS n, count(*) FILTER ({_FL}) AS flagged FROM submissions GROUP BY GROUPING SETS ((batch_id, occupation), (batch_id), ())""")
def flag_cube(spark, d):
    """Flags per batch and occupation, per batch, and of all, in one pass."""
    flag = F.sum(cohort.is_flagged(F.col("determination")).cast("int")).cast("bigint")
    s = table(spark, d, "submissions")
    cols = [F.col("batch_id"), F.col("occupation")]
    return s.groupingSets([cols, cols[:1], []], *cols).agg(F.count(F.lit(1)).alias("n"), flag.alias("flagged"))


# Sequences and vectors -----------------------------------------------------------------------------


def _user_series(spark, d) -> DataFrame:
    return sequences.series(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")


def changepoint_sql(threshold: float) -> str:
    return f"""WITH x AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
c AS (SELECT user_id, i, n, v, avg(v) OVER (PARTITION BY user_id) AS m, stddev_samp(v) OVER (PARTITION BY user_id) AS s FROM x WHERE n >= 6), k AS (SELECT *, sum(v - m) OVER (PARTITION BY user_id ORDER BY i) AS cum FROM c),
b AS (SELECT user_id, n, any_value(s) AS s, arg_max(i + 1, round(abs(cum), 6) * 1000000 - i / n) AS pos FROM k WHERE i < n - 1 GROUP BY user_id, n),
e AS (SELECT b.user_id, pos, any_value(s) AS s, avg(v) FILTER (i < pos) AS p, avg(v) FILTER (i >= pos) AS q FROM b JOIN x USING (user_id) WHERE pos >= 2 AND pos <= b.n - 2 AND b.s >= 1e-6 GROUP BY b.user_id, pos)
SELECT user_id, CAST(pos AS INT) AS changepoint, round(abs(q - p) / s, 3) AS effect_size, round(p, 4) AS mean_before, round(q, 4) AS mean_after FROM e WHERE abs(q - p) / s >= {threshold}"""


@query(changepoint_sql(3.0))
def changepoints(spark, d):
    c = _user_series(spark, d).select("user_id", sequences.changepoint(F.col("xs")).alias("c"))
    return c.where("c is not null").select("user_id", "c.*")


@query("""WITH x AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
w AS (SELECT user_id, k, avg(v) AS m, stddev_samp(v) AS s FROM (SELECT user_id, v, unnest(range(greatest(0, CAST(ceil((i - 63) / 32) AS BIGINT)), CAST(floor(i / 32) AS BIGINT) + 1)) AS k, n FROM x) WHERE k * 32 + 64 <= n GROUP BY user_id, k),
a AS (SELECT user_id, count(*) AS windows, stddev_samp(m) / greatest(avg(m), 1e-6) AS cv, stddev_samp(s) / greatest(avg(s), 1e-6) AS vov FROM w GROUP BY user_id)
SELECT user_id, windows, round(CASE WHEN windows >= 3 THEN cv ELSE 0 END, 4) AS trajectory_cv, round(CASE WHEN windows >= 3 THEN vov ELSE 0 END, 4) AS var_of_var,
 round(CASE WHEN windows >= 3 THEN greatest(0, 1 - cv) * greatest(0, 1 - vov) ELSE 0 END, 4) AS stationarity FROM a""")
def surprisal_windows(spark, d):
    s = _user_series(spark, d).select("user_id", sequences.surprisal_windows(F.col("xs")).alias("s"))
    return s.where("s.windows > 0").select("user_id", "s.*")


@query("""WITH x AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL)
SELECT user_id, round(avg(v), 4) AS mean_loss, round(var_pop(v), 4) AS surprisal_variance, round(CASE WHEN coalesce(var_pop(v) FILTER (i >= n // 2), 0) > 1e-6 THEN var_pop(v) FILTER (i < n // 2) / var_pop(v) FILTER (i >= n // 2) ELSE 1 END, 4) AS volatility_decay_ratio
FROM x GROUP BY user_id HAVING count(*) > 1""")
def loss_profile(spark, d):
    s = _user_series(spark, d).where(F.size("xs") > 1)
    p = s.select("user_id", F.round(text.mean(F.col("xs")), 4).alias("mean_loss"), sequences.loss_profile(F.col("xs")).alias("p"))
    return p.select("user_id", "mean_loss", "p.surprisal_variance", "p.volatility_decay_ratio")


@query("""WITH x AS (SELECT label, embedding::DOUBLE[] AS v, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS u FROM embeddings),
c AS (SELECT label, list_cosine_similarity(u, v) AS c FROM x WHERE u IS NOT NULL)
SELECT label, count(*) AS n, round(avg(c), 4) AS flow_mean, round(var_samp(c), 6) AS flow_variance, CASE WHEN var_samp(c) < .008 AND avg(c) > .4 THEN 'AMBER' WHEN var_samp(c) < .015 AND avg(c) > .35 THEN 'YELLOW' END AS determination FROM c GROUP BY label""")
def semantic_flow(spark, d):
    return sequences.flow(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


@query("""WITH e AS (SELECT vec_id, CASE WHEN label % 2 = 0 THEN 'ai' ELSE 'human' END AS side, embedding::DOUBLE[] AS v FROM embeddings),
m AS (SELECT side, list(a ORDER BY i) AS c FROM (SELECT side, i, avg(x) AS a FROM (SELECT side, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY side, i) GROUP BY side),
r AS (SELECT e.vec_id, max(list_cosine_similarity(e.v, m.c)) FILTER (m.side = 'ai') AS a, max(list_cosine_similarity(e.v, m.c)) FILTER (m.side = 'human') AS h FROM e, m GROUP BY 1)
SELECT vec_id, round(a, 4) AS ai_score, round(h, 4) AS human_score, round(a - h, 4) AS delta, CASE WHEN a >= .65 AND a - h >= .15 THEN 'AMBER' WHEN a >= .5 AND a - h >= .08 THEN 'YELLOW' END AS determination FROM r""")
def semantic_resonance(spark, d):
    rows = table(spark, d, "embeddings").withColumn("side", F.when(F.col("label") % 2 == 0, "ai").otherwise("human"))
    return sequences.resonance(rows, "vec_id", "embedding", materialize(sequences.centroids(rows, "side", "embedding"), "centroids"), "side")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def windowed_events(spark, d):
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


# Models --------------------------------------------------------------------------------------------


@query(f"""SELECT result_id, determination, calibrated_confidence AS p_ai, CASE WHEN coalesce({_FL}, false) AND calibrated_confidence <= .8 THEN 'rule_flags_model_passes'
 WHEN NOT coalesce({_FL}, false) AND calibrated_confidence > .8 THEN 'model_flags_rule_passes' END AS disagreement FROM results WHERE calibrated_confidence BETWEEN 0 AND 1""")
def shadow_disagreement(spark, d):
    """Verdicts against a given probability of machine text, here the calibrated confidence of the table."""
    rows = table(spark, d, "results").where("calibrated_confidence between 0 and 1")
    p = F.col("calibrated_confidence")
    return rows.select("result_id", "determination", p.alias("p_ai"), models.shadow_disagreement(F.col("determination"), p).alias("disagreement"))


@query()
def shadow_scores(spark, d):
    """Probability of the shadow classifier for every result, trained on the latest result of each confirmed task."""
    features = ["prompt_signature_composite", "instruction_density_idi", "voice_dissonance_vsd", "self_similarity_nssi_score", "lang_fw_coverage"]
    results = table(spark, d, "results")
    truth = cohort.latest(table(spark, d, "confirmed").select("task_id", "ground_truth", "verified_at", "confirm_id"), "task_id", ["verified_at", "confirm_id"])
    last = cohort.latest(results.where("task_id != ''").select("task_id", *features, "scored_at", "result_id"), "task_id", ["scored_at", "result_id"])
    data, labels = models.labelled_features(last.join(truth, "task_id"), features)
    model = models.shadow_model(data, features, labels)
    filled = results.select("result_id", "determination", *[F.coalesce(F.when(~F.isnan(f), F.col(f)), F.lit(0.0)).alias(f) for f in features])
    scored = model.transform(filled.withColumn("label", F.lit(0.0)).withColumn("weight", F.lit(1.0)))
    p = models.probability(scored)
    return scored.select(
        "result_id", "determination", F.round(p, 6).alias("p_ai"), models.ml_determination(p).alias("ml_determination"), models.shadow_disagreement(F.col("determination"), p).alias("disagreement")
    )


@query()
def html_reports(spark, d):
    t = spread(_texts(spark, d).where("t != ''"))
    return t.select("row_idx", residue_python.highlighted(F.col("t")).alias("html"))
