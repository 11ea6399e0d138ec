"""SQL of the signals whose patterns look around, rewritten as differences of plain counts; built from the same tables."""

from __future__ import annotations

from inkstone.functions import lexicon, regex, tables

_BLANK = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# The SQL engine's word characters and blanks are ASCII: other letters and marks become underscores, digits zeros, blanks spaces.
_ASCII = (
    r"regexp_replace(regexp_replace(regexp_replace(raw, '[^\x00-\x7F\P{Nd}]', '0', 'g'), '[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{M}]', '_', 'g'), "
    r"'[\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]', ' ', 'g')"
)
_T = f"t AS (SELECT row_idx, raw, {_ASCII} AS t FROM (SELECT row_idx, coalesce(prompt, '') AS raw FROM tasks))"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def count(pattern: str, flags: str = "", column: str = "t") -> str:
    """Hits of a pattern; its own inline flags are kept."""
    return f"len(regexp_extract_all({column}, {quoted((f'(?{flags})' if flags else '') + pattern)}))"


def words(column: str = "t") -> str:
    return count(f"[^{_BLANK}]+", "", column)


def word_list(column: str = "t") -> str:
    return f"regexp_extract_all({column}, '[^{_BLANK}]+')"


def sentences(column: str = "t") -> str:
    return rf"list_filter(string_split(regexp_replace({column}, '([.!?])[{_BLANK}]+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '[^{_BLANK}]'))"


def function_words(words: str) -> str:
    return f"len(list_filter({words}, lambda w: list_contains([{', '.join(map(quoted, tables.FUNCTION_WORDS))}], w)))"


def _topic_mask() -> str:
    steps = [_T, "m0 AS (SELECT row_idx, t, 0 AS n FROM t)"]
    for i, (stand_in, pattern) in enumerate(tables.TOPIC_MASKS):
        steps.append(f"m{i + 1} AS (SELECT row_idx, regexp_replace(t, {quoted(pattern)}, {quoted(stand_in)}, 'g') AS t, n + {count(pattern)} AS n FROM m{i})")
    return f"WITH {', '.join(steps)} SELECT row_idx, CAST(n AS INT) AS masks, CAST(length(t) AS INT) AS masked_length FROM m{len(tables.TOPIC_MASKS)}"


def _masked_steps() -> tuple[list[str], str]:
    steps = ["m0 AS (SELECT row_idx, raw, t, 0 AS n FROM t)"]
    for i, (stand_in, pattern) in enumerate(tables.TOPIC_MASKS):
        steps.append(f"m{i + 1} AS (SELECT row_idx, raw, regexp_replace(t, {quoted(pattern)}, {quoted(stand_in)}, 'g') AS t, n + {count(pattern)} AS n FROM m{i})")
    return steps, f"m{len(tables.TOPIC_MASKS)}"


def _stylometry() -> str:
    steps, last = _masked_steps()
    return rf"""WITH {_T}, {', '.join(steps)}, c AS (SELECT row_idx, n, {word_list('lower(t)')} AS mw, list_transform({sentences('raw')}, lambda s: CAST({words('s')} AS DOUBLE)) AS ls,
 regexp_extract_all(lower(raw), '[\p{{L}}\p{{M}}\p{{N}}_]+') AS ws FROM {last})
SELECT row_idx, round({function_words('mw')} / greatest(len(mw), 1), 4) AS function_word_ratio, round(CASE WHEN len(ls) >= 2 THEN list_aggregate(ls, 'stddev_samp') / greatest(list_avg(ls), 1) ELSE 0 END, 4) AS sent_length_dispersion,
 round(CASE WHEN len(ws) > 0 THEN len(list_distinct(ws)) / len(ws) ELSE 0 END, 4) AS type_token_ratio, round(CASE WHEN len(ws) > 0 THEN list_avg(list_transform(ws, lambda w: length(w))) ELSE 0 END, 2) AS avg_word_length,
 round(len(list_filter(ws, lambda w: length(w) <= 3)) / greatest(len(ws), 1), 4) AS short_word_ratio, CAST(n AS INT) AS mask_count FROM c"""


def _voice() -> str:
    word = lambda ws: count(regex.any_word(ws), "i")
    phrases = f"{count(tables.CASUAL_PHRASES[0], 'i')} + {count(chr(92) + 'bok,', 'i')} - {count(chr(92) + 'bok,' + chr(92) + 'w', 'i')}"
    # A long dash counts unless a digit touches it on either side.
    dashes = f"len(list_filter(range(1, len(cs) + 1), lambda i: cs[i] IN ('—', '–') AND NOT regexp_matches(coalesce(cs[i-1], ''), '\\d') AND NOT regexp_matches(coalesce(cs[i+1], ''), '\\d'))) + {count(' - ')}"
    return rf"""WITH {_T}, k AS (SELECT *, regexp_extract_all(t, '(?s).') AS cs FROM t),
c AS (SELECT row_idx, {word(tables.CASUAL_WORDS)} + {phrases} AS casual_markers, {word(tables.TYPOS)} AS misspellings, {count(tables.CONTRACTIONS, 'i')} AS contractions, {dashes} AS em_dashes,
 len(list_filter(string_split(raw, chr(10)), lambda l: regexp_matches(l, '^[{_BLANK}]*\p{{Ll}}'))) AS low, {count(tables.CAMEL_COLUMNS)} AS camel_cols, len(list_distinct(regexp_extract_all(t, {quoted('(?i)' + tables.FILENAMES)}))) AS filenames,
 {count(tables.CALCULATIONS, 'i')} AS calcs, {count(tables.TABS, 'i')} AS tabs, {count(tables.COLUMN_LISTS, 'i')} AS col_listings, {count(tables.TECHNICAL_PARENS)} AS parens, {count(tables.HEDGES, 'i')} AS hedges, greatest({words()} / 100, 1) AS per FROM k),
s AS (SELECT *, (casual_markers * 5 + misspellings + contractions * 1.5::DOUBLE + em_dashes + low * 0.5::DOUBLE) / per AS v, (camel_cols * 1.5::DOUBLE + filenames * 2 + calcs * 2 + tabs * 3 + col_listings * 3 + parens) / per AS sp FROM c)
SELECT row_idx, round(v, 6) AS voice_score, round(sp, 6) AS spec_score, round(v * sp, 4) AS vsd, v > 2 AS voice_gated, casual_markers, misspellings, contractions, em_dashes, camel_cols, filenames, calcs, tabs, col_listings, hedges FROM s"""


def _causal() -> str:
    head, rest = tables.CAUSAL.split("(?:", 1)
    parts = rest.rsplit(")", 1)[0]
    plain = [p for p in _alternatives(parts) if not p.startswith(("so", "while"))]
    so, following = next(p for p in _alternatives(parts) if p.startswith("so")), next(p for p in _alternatives(parts) if p.startswith("while"))
    not_after = so[so.index("(?!") + 3 : -1]
    after = following[following.index("(?=") + 3 : -1]
    return f"{count(head + '(?:' + '|'.join(plain) + ')' + chr(92) + 'b', 'i')} + {count(chr(92) + 'bso' + chr(92) + 'b', 'i')} - {count(chr(92) + 'bso' + not_after, 'i')} + {count(chr(92) + 'bwhile' + after, 'i')}"


def _alternatives(pattern: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, ch in enumerate(pattern):
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and not depth:
            out.append(pattern[at:i])
            at = i + 1
    return [*out, pattern[at:]]


def _expository() -> str:
    formulaic = " + ".join(count(p, "i") for _, p in tables.FORMULAIC)
    weighted = " + ".join(f"{w}::DOUBLE * {count(p, 'i')}" for w, p in tables.FORMULAIC)
    split = rf"string_split(regexp_replace(t, '([.!?])[{_BLANK}]+([A-Z\x22\x27])', '\1' || chr(1) || '\2', 'g'), chr(1))"
    return rf"""WITH {_T}, p AS (SELECT row_idx, t, list_filter(list_transform({split}, lambda s: regexp_replace(s, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g')), lambda s: length(s) > 10) AS ss,
 list_filter(list_transform({word_list('raw')}, lambda w: lower(trim(w, '.,!?"''():;'))), lambda w: w <> '') AS cl FROM t),
c AS (SELECT row_idx, {words()} AS word_count, greatest(len(ss), 1) AS n, {formulaic} AS fo, {weighted} AS fw, {count(regex.any_word(tables.POWER_ADJECTIVES), 'i')} AS po, {count(tables.SCARE_QUOTES)} AS sc, {count(tables.LONG_DASH)} AS da,
 {count(tables.PARENTHESES)} AS pa, {count(tables.COLON_EXPLAINS)} AS co, {count(tables.DEMONSTRATIVE, 'i')} AS de, {count(regex.any_word(tables.TRANSITIONS), 'i')} AS tr, {_causal()} AS ca,
 coalesce(list_max(list_transform(regexp_extract_all(t, '(?m)^(\d+(?:\.\d+)*)\s+', 1), lambda h: length(h) - length(replace(h, '.', '')) + 1)), 0) AS depth,
 list_transform(ss, lambda s: lower(regexp_extract(s, '[^{_BLANK}]+'))) AS st, list_transform(ss, lambda s: CAST({words('s')} AS DOUBLE)) AS ls, cl FROM p),
h AS (SELECT row_idx, count(*) FILTER (k = 1) AS hapax, count(*) AS uniq FROM (SELECT row_idx, w, count(*) AS k FROM (SELECT row_idx, unnest(cl) AS w FROM p) GROUP BY ALL) GROUP BY row_idx)
SELECT c.row_idx, word_count, n AS sentence_count, tr AS transition_hits, ca AS causal_hits, round(fo / n, 6) AS formulaic_density, round(fw / n, 6) AS formulaic_weighted, round(po / n, 6) AS power_adj_density, round(sc / n, 6) AS scare_quote_density,
 round(da / n, 6) AS emdash_density, round(pa / n, 6) AS parenthetical_density, round(co / n, 6) AS colon_density, round(de / n, 6) AS demonstrative_density, round(tr / n, 6) AS transition_density, round(ca / n, 6) AS causal_density,
 round((tr + 1) / (ca + 1), 6) AS causal_ratio, round(len(list_filter(st, lambda s: s IN ('this', 'the', 'these', 'those'))) / n, 6) AS this_the_start_rate, CAST(depth AS INT) AS section_depth,
 round(CASE WHEN len(ls) > 2 THEN list_aggregate(ls, 'stddev_samp') / greatest(list_avg(ls), 1) ELSE 0.5 END, 6) AS sent_length_cv, CAST(coalesce(hapax, 0) AS INT) AS hapax_count, CAST(coalesce(uniq, 0) AS INT) AS unique_words,
 round(CASE WHEN uniq > 0 THEN hapax / uniq ELSE 0 END, 6) AS hapax_ratio FROM c LEFT JOIN h USING (row_idx)"""


def _windows() -> str:
    formulaic = " + ".join(count(p, "i", "j") for _, p in tables.FORMULAIC)
    return rf"""WITH {_T}, s AS (SELECT row_idx, {sentences()} AS ss FROM t),
w AS (SELECT row_idx, i, ss[i+1:i+5] AS ws, array_to_string(ss[i+1:i+5], ' ') AS j FROM (SELECT row_idx, ss, unnest(range(0, len(ss) - 4, 2)) AS i FROM s WHERE len(ss) >= 5)),
m AS (SELECT row_idx, i, greatest({words('j')}, 1) / 100 AS c, {formulaic} AS f, {count(regex.any_word(tables.TRANSITIONS), 'i', 'j')} AS tr, {count(regex.any_word(tables.POWER_ADJECTIVES), 'i', 'j')} AS p,
 {function_words(word_list('lower(j)'))} / greatest({words('j')}, 1) AS fw, list_transform(ws, lambda x: CAST({words('x')} AS DOUBLE)) AS ls FROM w),
v AS (SELECT row_idx, i, fw, round(least(CASE WHEN f / c > 2 THEN least(f / c / 5, 0.3::DOUBLE) ELSE 0 END + CASE WHEN tr / c > 3 THEN least(tr / c / 8, 0.2::DOUBLE) ELSE 0 END + CASE WHEN p / c > 1.5 THEN least(p / c / 4, 0.2::DOUBLE) ELSE 0 END
 + CASE WHEN list_aggregate(ls, 'stddev_samp') / greatest(list_avg(ls), 1) < .25 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN fw < .12 THEN 0.15::DOUBLE ELSE 0 END, 1), 3) AS score FROM m),
o AS (SELECT row_idx, score, i // 2 - row_number() OVER (PARTITION BY row_idx, score >= .3 ORDER BY i) AS g FROM v), r AS (SELECT row_idx, max(k) AS hot FROM (SELECT row_idx, g, count(*) AS k FROM o WHERE score >= .3 GROUP BY ALL) GROUP BY row_idx),
a AS (SELECT row_idx, count(*) AS n, max(score) AS mx, avg(score) AS av, coalesce(var_samp(score), 0) AS va, stddev_samp(fw) / greatest(avg(fw), .01) AS cv FROM v GROUP BY row_idx)
SELECT s.row_idx, round(coalesce(mx, 0), 3) AS max_window_score, round(coalesce(av, 0), 3) AS mean_window_score, round(coalesce(va, 0) + 1e-9, 4) AS window_variance, CAST(coalesce(hot, 0) AS INT) AS hot_span_length, CAST(coalesce(n, 0) AS INT) AS n_windows,
 coalesce(va >= .02 AND mx >= .3 AND av < .5, false) AS mixed_signal, round(CASE WHEN n >= 3 THEN cv ELSE 0 END, 4) AS fw_trajectory_cv FROM s LEFT JOIN a USING (row_idx) LEFT JOIN r USING (row_idx)"""


def _pack(name: str) -> str:
    """Weighted hits of a pack; patterns that look ahead are rewritten."""
    pack = lexicon.PACKS[name]
    parts = []
    for weight, p in pack.patterns:
        if "(?!" in p:
            base, rest = p.split("(?!", 1)
            hits = f"({count(base, 'im')} - {count(base + rest[:-1], 'im')})"
        else:
            hits = count(p.replace("(?=", "(?:"), "im")
        parts.append(f"{weight} * {hits}")
    if pack.uppercase:
        parts.append("2 * " + count("|".join(rf"\b{k}\b" for k in sorted(pack.uppercase, key=len, reverse=True))))
    return f"round({' + '.join(parts)}, 4) AS {name}"


def packs() -> str:
    return f"WITH {_T} SELECT row_idx, {', '.join(map(_pack, lexicon.PACKS))} FROM t"


SQL = {"topic_mask": _topic_mask(), "stylometry": _stylometry(), "voice_dissonance": _voice(), "expository_signals": _expository(), "sentence_windows": _windows(), "lexicon_packs": packs()}
