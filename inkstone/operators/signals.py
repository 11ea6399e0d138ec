"""Row-wise signals of a text, each one struct column, so that unselected signals are pruned.

Every builder takes a column of text and gives a struct. Null text counts as empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import lexicon, regex, tables, text
from inkstone.functions.regex import count, count_all, has, ladder

# A mark is neither a word character nor a space.
MARK = r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]"


def _per100(t: Column) -> Column:
    return F.greatest(text.word_count(t) / 100, F.lit(1.0))


def preamble(t: Column) -> Column:
    """Artifacts of a model's answer: hits, worst severity and its score."""
    hits = F.filter(
        F.array(
            *[
                F.when(has(F.substring(t, 1, 500) if head else t, p), F.struct(F.lit(name).alias("name"), F.lit(severity).alias("severity")))
                for name, severity, head, p in tables.PREAMBLE
            ]
        ),
        lambda h: h.isNotNull(),
    )

    def of(h: Column) -> Column:
        worst = lambda s: F.exists(h, lambda x: x["severity"] == s)
        severity = F.when(worst("CRITICAL"), "CRITICAL").when(worst("HIGH"), "HIGH").when(worst("MEDIUM"), "MEDIUM").otherwise("NONE")
        score = F.when(worst("CRITICAL"), 0.99).when(worst("HIGH"), 0.75).when(worst("MEDIUM"), 0.50).otherwise(0.0)
        return F.struct(score.alias("score"), severity.alias("severity"), F.size(h).alias("hits"), F.transform(h, lambda x: x["name"]).alias("names"))

    return text.bound(hits, of)


def fingerprint(t: Column) -> Column:
    """Words that models favour: hits, rate per 1000 words (at least one), score."""
    hits = count(t, regex.any_word(tables.FINGERPRINT_WORDS), True)
    rate = hits / F.greatest(text.word_count(t) / 1000, F.lit(1.0))
    return F.struct(F.least(rate / 5.0, F.lit(1.0)).alias("score"), hits.alias("hits"), rate.alias("rate"))


def prompt_signature(t: Column) -> Column:
    """Constraint frames, framing, conditions, task-design traces and their composite."""
    frames = [count(t, p, True) for p in tables.CONSTRAINT_FRAMES]
    raw = F.struct(
        text.sentences(t).alias("sentences"),
        F.array(*frames).alias("frames"),
        (
            has(F.substring(t, 1, 600), tables.ROLE, True).cast("int")
            + has(t, tables.DELIVERABLE, True).cast("int")
            + has(F.substring(t, -300, 300), tables.CLOSING, True).cast("int")
        ).alias("fc"),
        count_all(t, tables.CONDITIONS).alias("conditions"),
        regex.total([has(t, p, True).cast("int") for p in tables.META_DESIGN]).alias("meta"),
        count(t, tables.CONTRACTIONS, True).alias("contractions"),
        count(t, r"\bmust\b", True).alias("must"),
        count(t, tables.NUMBERED, False, True).alias("numbered"),
        text.word_count(t).alias("words"),
    )

    def of(r: Column) -> Column:
        n = F.greatest(F.size(r["sentences"]), F.lit(1))
        total = F.aggregate(r["frames"], F.lit(0), lambda a, x: a + x)
        distinct = F.size(F.filter(r["frames"], lambda x: x > 0))
        framed = F.size(
            F.filter(r["sentences"], lambda s: regex.total([has(s, p, True).cast("int") for p in tables.CONSTRAINT_FRAMES]) >= 2)
        )
        cfd = total / n
        composite = (
            ladder(cfd, [(0.50, 0.40), (0.30, 0.25), (0.15, 0.10)])
            + ladder(distinct, [(8, 0.20), (5, 0.12), (3, 0.05)])
            + ladder(r["meta"], [(3, 0.20), (1, 0.08)])
            + F.when(r["fc"] == 3, 0.10).otherwise(0.0)
            + F.when((r["fc"] >= 2) & (distinct >= 8), 0.15).otherwise(0.0)
            + ladder(r["numbered"], [(15, 0.15), (10, 0.08)])
            + F.when((r["contractions"] == 0) & (r["words"] > 500), 0.05).otherwise(0.0)
        )
        return F.struct(
            cfd.alias("cfd"),
            distinct.alias("distinct_frames"),
            (framed / n).alias("mfsr"),
            r["fc"].alias("framing_completeness"),
            (r["conditions"] / n).alias("conditional_density"),
            r["meta"].alias("meta_design_hits"),
            r["contractions"].alias("contractions"),
            r["must"].alias("must_count"),
            (r["must"] / n).alias("must_rate"),
            r["numbered"].alias("numbered_criteria"),
            F.least(F.round(composite, 6), F.lit(1.0)).alias("composite"),
        )

    return text.bound(raw, of)


def voice_dissonance(t: Column) -> Column:
    """Casual voice against technical specification."""
    starts = F.filter(F.split(t, "\n"), lambda line: F.regexp_replace(line, r"(?U)^\s+", "").rlike(r"^\p{Ll}"))
    raw = F.struct(
        (count(t, regex.any_word(tables.CASUAL_WORDS), True) + count_all(t, tables.CASUAL_PHRASES)).alias("casual"),
        count(t, regex.any_word(tables.TYPOS), True).alias("typos"),
        count(t, tables.CONTRACTIONS, True).alias("contractions"),
        count(t, tables.SPACED_DASH).alias("dashes"),
        F.size(starts).alias("low_starts"),
        count(t, tables.CAMEL_COLUMNS).alias("camel"),
        F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(regex.java(tables.FILENAMES, True)), F.lit(0)))).alias("files"),
        count(t, tables.CALCULATIONS, True).alias("calcs"),
        count(t, tables.TABS, True).alias("tabs"),
        count(t, tables.COLUMN_LISTS, True).alias("columns"),
        count(t, tables.TECHNICAL_PARENS).alias("parens"),
        count(t, tables.HEDGES, True).alias("hedges"),
        _per100(t).alias("per100"),
    )

    def of(r: Column) -> Column:
        voice = (r["casual"] * 5 + r["typos"] + r["contractions"] * 1.5 + r["dashes"] + r["low_starts"] * 0.5) / r["per100"]
        spec = (r["camel"] * 1.5 + r["files"] * 2 + r["calcs"] * 2 + r["tabs"] * 3 + r["columns"] * 3 + r["parens"]) / r["per100"]
        return F.struct(
            voice.alias("voice_score"), spec.alias("spec_score"), (voice * spec).alias("vsd"), (voice > 2.0).alias("voice_gated"),
            r["casual"].alias("casual_markers"), r["typos"].alias("misspellings"), r["contractions"], r["dashes"].alias("em_dashes"),
            r["camel"].alias("camel_cols"), r["files"].alias("filenames"), r["calcs"], r["tabs"], r["columns"].alias("col_listings"), r["hedges"],
        )

    return text.bound(raw, of)


def instruction_density(t: Column) -> Column:
    raw = F.struct(
        text.words_in(t, tables.IMPERATIVES).alias("imperatives"),
        text.words_in(t, tables.CONDITIONALS).alias("conditionals"),
        count(t, r"\b(?:Yes|No)\b").alias("binary_specs"),
        count(t, r"\bMISSING\b").alias("missing_refs"),
        count(t, r"\b[Ff]lag\b").alias("flag_count"),
        _per100(t).alias("per100"),
    )

    def of(r: Column) -> Column:
        idi = (r["imperatives"] + r["conditionals"] * 2.0 + r["binary_specs"] * 1.5 + r["missing_refs"] * 3.0 + r["flag_count"] * 2.0) / r["per100"]
        return F.struct(
            idi.alias("idi"), r["imperatives"], (r["imperatives"] / r["per100"]).alias("imp_rate"), r["conditionals"],
            (r["conditionals"] / r["per100"]).alias("cond_rate"), r["binary_specs"], r["missing_refs"], r["flag_count"],
        )

    return text.bound(raw, of)


def lexicon_packs(t: Column) -> Column:
    """One struct per pack: raw, upper-case and weighted hits."""
    return regex.searched(t, lambda s: F.struct(*[lexicon.pack_struct(s, n) for n in lexicon.PACKS]))


def enhanced(signature: Column, voice: Column, density: Column, packs: Column, sentence_count: Column, words: Column) -> Column:
    """The three prompt signals raised by the lexicon packs."""
    one = F.lit(1)
    per100 = F.greatest(words / 100, F.lit(1.0))
    sums = lambda names, part: regex.total([packs[n][part] for n in names])
    cap = lambda names, n_s: regex.total([lexicon.capped(packs[n]["weighted"], n, n_s) for n in names])
    constraint, spec = lexicon.packs_of("constraint"), lexicon.packs_of("exec_spec")
    schema, form = lexicon.packs_of("schema"), lexicon.packs_of("format")
    raw = F.struct(
        cap(constraint, sentence_count).alias("constraint"),
        cap(spec, sentence_count).alias("spec"),
        regex.total([(packs[n]["raw_hits"] > 0).cast("int") for n in constraint + spec]).alias("families"),
        sums(constraint + spec, "uppercase_hits").alias("upper"),
        cap(schema, one).alias("schema"),
        cap(form, one).alias("format"),
        (sums(schema, "weighted") / per100).alias("schema100"),
        (sums(form, "weighted") / per100).alias("format100"),
        (packs["task_verbs"]["weighted"] / per100).alias("tv100"),
        (packs["value_domain"]["weighted"] / per100).alias("vd100"),
        signature.alias("sig"), voice.alias("voice"), density.alias("density"), words.alias("words"),
    )

    def of(r: Column) -> Column:
        boost = (
            ladder(r["constraint"], [(0.40, 0.20), (0.20, 0.12), (0.08, 0.05)])
            + ladder(r["spec"], [(0.30, 0.15), (0.15, 0.08), (0.05, 0.03)])
            + ladder(r["families"], [(6, 0.15), (4, 0.08), (2, 0.03)])
            + ladder(r["upper"], [(3, 0.10), (1, 0.04)])
        )
        spec_score = r["voice"]["spec_score"] + r["schema100"] * 2.0 + r["format100"]
        sterile = F.when(r["voice"]["contractions"] == 0, 5.0).otherwise(7.0)
        paired = (F.round(r["constraint"], 4) > 0.08) | (F.round(r["schema"], 4) > 0.05)
        idi_boost = r["tv100"] * F.when(paired, 1.0).otherwise(0.5) + r["vd100"] * 2.0
        return F.struct(
            F.least(F.round(r["sig"]["composite"] + boost, 6), F.lit(1.0)).alias("composite"),
            F.round(boost, 4).alias("pack_boost"),
            F.round(r["constraint"], 4).alias("pack_constraint_score"),
            F.round(r["spec"], 4).alias("pack_exec_spec_score"),
            r["families"].alias("pack_active_families"),
            r["upper"].alias("pack_uc_hits"),
            F.round(r["schema"], 4).alias("pack_schema_score"),
            F.round(r["format"], 4).alias("pack_format_score"),
            F.round(spec_score, 2).alias("spec_score"),
            F.round(r["voice"]["voice_score"] * spec_score, 1).alias("vsd"),
            ((spec_score >= sterile) & (r["voice"]["voice_score"] < 0.5) & (r["voice"]["hedges"] == 0) & (r["words"] >= 150)).alias("ssi"),
            F.round(r["density"]["idi"] + idi_boost, 1).alias("idi"),
            F.round(idi_boost, 2).alias("pack_idi_boost"),
        )

    return text.bound(raw, of)


def stylometry(t: Column) -> Column:
    """Topic-scrubbed style: function words of the masked text, spread of sentence lengths, vocabulary."""
    masked, masks = text.mask_topics(t)
    raw = F.struct(
        text.words(F.lower(masked)).alias("masked"),
        masks.alias("masks"),
        F.transform(text.sentences(t), lambda s: text.word_count(s).cast("double")).alias("lengths"),
        text.word_tokens(t).alias("tokens"),
    )

    def of(r: Column) -> Column:
        n = F.size(r["tokens"])
        sizes = F.transform(r["tokens"], lambda w: F.length(w).cast("double"))
        spread = F.when(F.size(r["lengths"]) >= 2, text.stdev(r["lengths"]) / F.greatest(text.mean(r["lengths"]), F.lit(1.0))).otherwise(0.0)
        return F.struct(
            F.round(text.function_words_in(r["masked"]) / F.greatest(F.size(r["masked"]), F.lit(1)), 4).alias("function_word_ratio"),
            F.round(spread, 4).alias("sent_length_dispersion"),
            F.round(text.type_token_ratio(r["tokens"]), 4).alias("type_token_ratio"),
            F.round(F.when(n > 0, text.mean(sizes)).otherwise(0.0), 2).alias("avg_word_length"),
            F.round(F.size(F.filter(r["tokens"], lambda w: F.length(w) <= 3)) / F.greatest(n, F.lit(1)), 4).alias("short_word_ratio"),
            r["masks"].alias("mask_count"),
        )

    return text.bound(raw, of)


def top_shares(items: Column, most: int, relative: bool) -> Column:
    """The ``most`` frequent items of an array as (item, n or share of all items), ties by first occurrence."""

    def of(xs: Column) -> Column:
        # Sorted by item, equal ones are neighbours: one pass counts them and keeps the first place of each.
        placed = F.array_sort(F.transform(xs, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def counted(p: Column) -> Column:
            heads = F.filter(F.transform(p, lambda e, k: F.struct(e["x"].alias("x"), e["i"].alias("i"), k.alias("k"), ((k == 0) | (F.get(p, k - 1)["x"] != e["x"])).alias("head"))), lambda e: e["head"])
            ends = lambda h, j: F.coalesce(F.get(h, j + 1)["k"], F.size(p))
            runs = text.bound(heads, lambda h: F.transform(h, lambda e, j: F.struct((e["k"] - ends(h, j)).alias("less"), e["i"].alias("i"), e["x"].alias("x"))))
            best = F.slice(F.array_sort(runs), 1, most)
            value = (lambda e: -e["less"] / F.size(p)) if relative else (lambda e: (-e["less"]).cast("bigint"))
            return F.transform(best, lambda e: F.struct(e["x"].alias("item"), value(e).alias("n")))

        return text.bound(placed, counted)

    return text.bound(items, of)


def char_profile(t: Column, most: int = 50) -> Column:
    """Most frequent runs of four characters of the masked text with their relative frequency; none that begin with '_'."""

    def grams(m: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.length(m) - 3), lambda i: F.substring(m, i, F.lit(4)))
        return F.filter(F.when(F.length(m) > 3, runs).otherwise(F.array().cast("array<string>")), lambda g: ~g.startswith("_"))

    return top_shares(text.bound(F.lower(text.mask_topics(t)[0]), grams), most, True)


def punctuation_profile(t: Column, most: int = 20) -> Column:
    """Most frequent pairs of successive marks, neither word characters nor spaces, whatever stands between."""

    def pairs(p: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.concat(F.get(p, i - 1), F.get(p, i)))
        return F.when(F.size(p) > 1, runs).otherwise(F.array().cast("array<string>"))

    return top_shares(text.bound(F.regexp_extract_all(t, F.lit(MARK), F.lit(0)), pairs), most, False)


def windows(t: Column, size: int = 5, stride: int = 2) -> Column:
    """Scores of overlapping sentence windows and what they add up to (without compression)."""
    formulaic = [p for _, p in tables.FORMULAIC]
    transitions, power = regex.any_word(tables.TRANSITIONS), regex.any_word(tables.POWER_ADJECTIVES)

    def window(sentences: Column) -> Column:
        joined = F.array_join(sentences, " ")
        lengths = F.transform(sentences, lambda s: text.word_count(s).cast("double"))
        n = F.greatest(text.word_count(joined), F.lit(1))
        per = lambda hits: hits / (n / 100)
        raw = F.struct(
            per(count_all(joined, formulaic)).alias("f"), per(count(joined, transitions, True)).alias("t"), per(count(joined, power, True)).alias("p"),
            (text.function_words_in(text.words(F.lower(joined))) / n).alias("fw"),
            (text.stdev(lengths) / F.greatest(text.mean(lengths), F.lit(1.0))).alias("cv"),
        )

        def of(r: Column) -> Column:
            score = (
                F.when(r["f"] > 2.0, F.least(r["f"] / 5.0, F.lit(0.3))).otherwise(0.0)
                + F.when(r["t"] > 3.0, F.least(r["t"] / 8.0, F.lit(0.2))).otherwise(0.0)
                + F.when(r["p"] > 1.5, F.least(r["p"] / 4.0, F.lit(0.2))).otherwise(0.0)
                + F.when(r["cv"] < 0.25, 0.15).otherwise(0.0)
                + F.when(r["fw"] < 0.12, 0.15).otherwise(0.0)
            )
            return F.struct(F.round(F.least(score, F.lit(1.0)), 3).alias("score"), r["fw"].alias("fw"))

        return text.bound(raw, of)

    def all_windows(sentences: Column) -> Column:
        last = F.size(sentences) - size
        starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: window(F.slice(sentences, i + 1, size)))

    def summary(w: Column) -> Column:
        scores = F.transform(w, lambda x: x["score"])
        fw = F.transform(w, lambda x: x["fw"])
        n = F.size(w)
        top, mean = F.coalesce(F.array_max(scores), F.lit(0.0)), F.when(n > 0, text.mean(scores)).otherwise(0.0)
        variance = F.when(n >= 2, F.pow(text.stdev(scores), 2)).otherwise(0.0)
        run = F.aggregate(
            scores,
            F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")),
            lambda a, s: F.when(s >= 0.30, F.struct((a["now"] + 1).alias("now"), F.greatest(a["best"], a["now"] + 1).alias("best"))).otherwise(
                F.struct(F.lit(0).alias("now"), a["best"].alias("best"))
            ),
            lambda a: a["best"],
        )
        return F.struct(
            F.round(top, 3).alias("max_window_score"),
            F.round(mean, 3).alias("mean_window_score"),
            # The scores are thousandths, so their variance may lie on a tie; ties go up.
            F.round(variance + F.lit(1e-9), 4).alias("window_variance"),
            run.alias("hot_span_length"),
            n.alias("n_windows"),
            ((variance >= 0.02) & (top >= 0.30) & (mean < 0.50)).alias("mixed_signal"),
            F.round(F.when(n >= 3, text.stdev(fw) / F.greatest(text.mean(fw), F.lit(0.01))).otherwise(0.0), 4).alias("fw_trajectory_cv"),
            scores.alias("scores"),
        )

    return text.bound(text.bound(text.sentences(t), all_windows), summary)


def expository(t: Column) -> Column:
    """Counts behind the self-similarity index that expressions can give (all but compression)."""
    words = text.words(t)
    clean = F.filter(F.transform(words, lambda w: F.lower(F.btrim(w, F.lit(""".,!?"'():;""")))), lambda w: w != "")
    raw = F.struct(
        text.long_sentences(t).alias("sentences"),
        F.size(words).alias("words"),
        regex.total([count(t, p, True) for _, p in tables.FORMULAIC]).alias("formulaic"),
        regex.total([count(t, p, True) * F.lit(w) for w, p in tables.FORMULAIC]).alias("formulaic_weighted"),
        count(t, regex.any_word(tables.POWER_ADJECTIVES), True).alias("power"),
        count(t, tables.SCARE_QUOTES).alias("scare"),
        count(t, tables.LONG_DASH).alias("dashes"),
        count(t, tables.PARENTHESES).alias("parens"),
        count(t, tables.COLON_EXPLAINS).alias("colons"),
        count(t, tables.DEMONSTRATIVE, True).alias("demonstratives"),
        count(t, regex.any_word(tables.TRANSITIONS), True).alias("transitions"),
        count(t, tables.CAUSAL, True).alias("causal"),
        F.array_max(
            F.transform(F.regexp_extract_all(t, F.lit(regex.java(r"^(\d+(?:\.\d+)*)\s+", False, True)), F.lit(1)), lambda h: F.length(h) - F.length(F.replace(h, F.lit("."))) + 1)
        ).alias("depth"),
        F.array_sort(clean).alias("clean"),
    )

    def of(r: Column) -> Column:
        n = F.greatest(F.size(r["sentences"]), F.lit(1))
        starts = F.transform(r["sentences"], lambda s: F.lower(F.regexp_extract(s, r"(?U)(\S+)", 1)))
        lengths = F.transform(r["sentences"], lambda s: text.word_count(s).cast("double"))
        # In sorted order a word that stands alone differs from both neighbours.
        alone = F.filter(
            F.transform(r["clean"], lambda w, i: (F.coalesce(F.get(r["clean"], i - 1), F.lit("")) != w) & (F.coalesce(F.get(r["clean"], i + 1), F.lit("")) != w)),
            lambda x: x,
        )
        unique = F.size(F.array_distinct(r["clean"]))
        return F.struct(
            r["words"].alias("word_count"), n.alias("sentence_count"), r["transitions"].alias("transition_hits"), r["causal"].alias("causal_hits"),
            (r["formulaic"] / n).alias("formulaic_density"), (r["formulaic_weighted"] / n).alias("formulaic_weighted"),
            (r["power"] / n).alias("power_adj_density"), (r["scare"] / n).alias("scare_quote_density"), (r["dashes"] / n).alias("emdash_density"),
            (r["parens"] / n).alias("parenthetical_density"), (r["colons"] / n).alias("colon_density"), (r["demonstratives"] / n).alias("demonstrative_density"),
            (r["transitions"] / n).alias("transition_density"), (r["causal"] / n).alias("causal_density"), ((r["transitions"] + 1) / (r["causal"] + 1)).alias("causal_ratio"),
            (F.size(F.filter(starts, lambda s: s.isin("this", "the", "these", "those"))) / n).alias("this_the_start_rate"),
            F.coalesce(r["depth"], F.lit(0)).alias("section_depth"),
            F.when(F.size(lengths) > 2, text.stdev(lengths) / F.greatest(text.mean(lengths), F.lit(1.0))).otherwise(0.5).alias("sent_length_cv"),
            F.size(alone).alias("hapax_count"), unique.alias("unique_words"), F.when(unique > 0, F.size(alone) / unique).otherwise(0.0).alias("hapax_ratio"),
        )

    return text.bound(raw, of)


def self_similarity(e: Column, comp_ratio: Column, shuffled_ratio: Column) -> Column:
    """Convergence of the expository signals; ``e`` is ``expository``, the ratios come from compression."""
    lin = lambda v, least, full: F.when(v >= least, F.least(v / full, F.lit(1.0))).otherwise(0.0)
    down = lambda v, top, span: F.when(v <= top, F.least((F.lit(top) - v) / span, F.lit(1.0))).otherwise(0.0)
    scaffold = e["emdash_density"] + e["parenthetical_density"] + e["colon_density"]
    delta = shuffled_ratio - comp_ratio
    strengths = [
        lin(e["formulaic_weighted"], 0.04, 0.25), lin(e["power_adj_density"], 0.08, 0.30), lin(e["scare_quote_density"], 0.08, 0.40),
        lin(e["demonstrative_density"], 0.03, 0.12), lin(e["transition_density"], 0.05, 0.20), lin(scaffold, 0.15, 0.60),
        lin(e["this_the_start_rate"], 0.20, 0.35), lin(e["section_depth"], 3, 4.0),
        F.when((e["transition_hits"] >= 2) & (e["causal_ratio"] >= 1.5), F.least((e["causal_ratio"] - 1.0) / 3.0, F.lit(1.0)) * 0.5).otherwise(0.0),
        F.when(e["sentence_count"] >= 4, down(e["sent_length_cv"], 0.35, 0.15)).otherwise(0.0),
        down(comp_ratio, 0.42, 0.08), down(e["hapax_ratio"], 0.45, 0.15),
        F.when(delta < 0.03, F.least((F.lit(0.03) - delta) / 0.02, F.lit(1.0))).otherwise(0.0),
    ]

    def of(s: Column) -> Column:
        active = F.filter(s, lambda x: x > 0)
        n = F.size(active)
        base = F.when(n > 0, text.mean(active) * F.least(n / 5.5, F.lit(1.0))).otherwise(0.0)
        return F.struct(F.when(n >= 8, F.least(base * 1.3, F.lit(1.0))).otherwise(base).alias("score"), n.alias("n"))

    def labelled(x: Column) -> Column:
        det = F.when((x["score"] >= 0.70) & (x["n"] >= 7), "RED").when((x["score"] >= 0.45) & (x["n"] >= 5), "AMBER").when((x["score"] >= 0.25) & (x["n"] >= 4), "YELLOW")
        cap = F.when(det == "RED", 0.85).when(det == "AMBER", 0.65).when(det == "YELLOW", 0.40)
        return F.struct(
            F.round(x["score"], 4).alias("nssi_score"), x["n"].alias("nssi_signals"), det.alias("determination"),
            F.coalesce(F.round(F.least(cap, x["score"]), 4), F.lit(0.0)).alias("confidence"),
        )

    none = F.struct(F.lit(0.0).alias("nssi_score"), F.lit(0).alias("nssi_signals"), F.lit(None).cast("string").alias("determination"), F.lit(0.0).alias("confidence"))
    return F.when(e["word_count"] < 200, none).otherwise(text.bound(text.bound(F.array(*strengths), of), labelled))


def with_signal(df: DataFrame, name: str, builder, text_col: str = "text") -> DataFrame:
    return df.withColumn(name, builder(F.coalesce(F.col(text_col), F.lit(""))))
