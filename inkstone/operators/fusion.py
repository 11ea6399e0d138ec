"""Channels and their fusion into one determination per row, as expressions over signal structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions import text

# Severities in ascending order.
SEVERITIES = ("GREEN", "YELLOW", "AMBER", "RED")
CHANNELS = ("prompt_structure", "stylometry", "continuation", "windowing")
REASONS_SHOWN, WEAK_SHOWN = 3, 2


def level(severity: Column) -> Column:
    return F.when(severity == "RED", 3).when(severity == "AMBER", 2).when(severity == "YELLOW", 1).otherwise(0)


def severity_of(lv: Column) -> Column:
    return F.when(lv >= 3, "RED").when(lv == 2, "AMBER").when(lv == 1, "YELLOW").otherwise("GREEN")


def _channel(name: str, score: Column, lv: Column, sufficient: Column, generic_only: bool) -> Column:
    return F.struct(
        F.lit(name).alias("channel"),
        score.cast("double").alias("score"),
        severity_of(lv).alias("severity"),
        lv.cast("int").alias("level"),
        sufficient.alias("data_sufficient"),
        F.lit(generic_only).alias("generic_only"),
    )


def prompt_structure(pre_score: Column, pre_severity: Column, composite: Column, v: dict[str, Column], idi: Column, words: Column) -> Column:
    """``v``: voice_gated, vsd, spec_score, voice_score, contractions, hedges."""
    off = F.lit(0.0)
    sig = F.when(composite >= 0.40, composite).when(composite >= 0.20, composite * 0.7).otherwise(off)
    sig_lv = F.when(composite >= 0.60, 3).when(composite >= 0.40, 2).when(composite >= 0.20, 1).otherwise(0)
    gated = v["voice_gated"]
    vsd = F.when(gated & (v["vsd"] >= 50), 0.90).when(gated & (v["vsd"] >= 21), 0.70).when(~gated & (v["vsd"] >= 100), 0.60).when(~gated & (v["vsd"] >= 21), 0.30).otherwise(off)
    vsd_lv = F.when(gated & (v["vsd"] >= 50), 3).when(gated & (v["vsd"] >= 21), 2).when(~gated & (v["vsd"] >= 100), 2).when(~gated & (v["vsd"] >= 21), 1).otherwise(0)
    den = F.when(idi >= 12, 0.85).when(idi >= 8, 0.65).otherwise(off)
    den_lv = F.when(idi >= 12, 3).when(idi >= 8, 2).otherwise(0)
    sterile = (v["spec_score"] >= F.when(v["contractions"] == 0, 5.0).otherwise(7.0)) & (v["voice_score"] < 0.5) & (v["hedges"] == 0) & (words >= 150)
    ssi = F.when(sterile & (v["spec_score"] >= 8.0), 0.70).when(sterile, 0.45).otherwise(off)
    ssi_lv = F.when(sterile & (v["spec_score"] >= 8.0), 2).when(sterile, 1).otherwise(0)
    critical = pre_severity == "CRITICAL"
    pre = F.when(pre_score >= 0.50, pre_score).otherwise(off)
    score = F.when(critical, 0.99).otherwise(F.greatest(pre, sig, vsd, den, ssi))
    return _channel("prompt_structure", score, F.when(critical, 3).otherwise(F.greatest(sig_lv, vsd_lv, den_lv, ssi_lv)), F.lit(True), False)


def stylistic(fingerprint: Column, nssi: dict[str, Column], support: list[dict[str, object]] = (), tempo: dict[str, Column] | None = None) -> Column:
    """``nssi``: determination, confidence. ``support``: determination, confidence, alone (whether YELLOW may stand alone),
    or variance and decay of the surprisal. ``tempo``: burstiness, sentences.

    An ordered fold: each supporting signal raises what stands before it, or starts the channel.
    """
    det = nssi["determination"]
    score = F.when(det.isNotNull(), F.least(F.when(det == "RED", 0.85).when(det == "AMBER", 0.65).otherwise(0.40), nssi["confidence"])).otherwise(F.lit(0.0))
    lv = level(det)
    state = F.struct(score.alias("s"), lv.alias("l"))
    for x in support:
        if "variance" in x:
            state = text.bound(state, lambda st, x=x: F.struct(_steady(st, x["variance"], x["decay"]).alias("s"), st["l"].alias("l")))
            continue
        d, conf, alone = x["determination"], x["confidence"], x.get("alone", True)

        def step(st: Column, d=d, conf=conf, alone=alone) -> Column:
            boosted = lambda by: F.least(st["s"] + by, F.lit(1.0))
            s = (
                F.when((d == "AMBER") & (st["l"] >= 2), boosted(0.10))
                .when(d == "AMBER", F.greatest(st["s"], conf))
                .when((d == "YELLOW") & (st["l"] > 0), boosted(0.05))
                .when((d == "YELLOW") & F.lit(alone), F.greatest(st["s"], conf))
                .otherwise(st["s"])
            )
            lv_ = F.when(d == "AMBER", F.greatest(st["l"], F.lit(2))).when((d == "YELLOW") & (st["l"] == 0) & F.lit(alone), 1).otherwise(st["l"])
            return F.struct(s.alias("s"), lv_.alias("l"))

        state = text.bound(state, step)

    def finish(st: Column) -> Column:
        s = st["s"]
        if tempo:
            burst, n = tempo["burstiness"], tempo["sentences"]
            s = F.when((st["l"] > 0) & (burst > 0) & (burst < 0.5) & (n >= 3), F.least(s + 0.06, F.lit(1.0))).otherwise(s)
        s = F.when((fingerprint >= 0.30) & (st["l"] > 0), F.least(s + 0.10, F.lit(1.0))).otherwise(s)
        sufficient = (fingerprint > 0) | det.isNotNull()
        for x in support:
            sufficient = sufficient | ((x["variance"] > 0) if "variance" in x else x["determination"].isNotNull())
        return _channel("stylometry", s, st["l"], F.coalesce(sufficient, F.lit(False)), True)

    return text.bound(state, finish)


def _steady(st: Column, variance: Column, decay: Column) -> Column:
    """Uniform surprisal raises an active channel."""
    active = (st["l"] > 0) & (variance > 0)
    return (
        F.when(active & (variance < 2.0) & (decay > 1.5), F.least(st["s"] + 0.08, F.lit(1.0)))
        .when(active & (variance < 3.0) & (decay > 1.2), F.least(st["s"] + 0.04, F.lit(1.0)))
        .otherwise(st["s"])
    )


def continuation(det: Column, confidence: Column, present: Column) -> Column:
    cap = F.when(det == "RED", 0.95).when(det == "AMBER", 0.70).when(det == "YELLOW", 0.40)
    return _channel("continuation", F.coalesce(F.least(cap, confidence), F.lit(0.0)), level(det), present, False)


def windowing(w: Column) -> Column:
    top, hot = w["max_window_score"], w["hot_span_length"]
    lv = F.when((top >= 0.60) & (hot >= 3), 3).when((top >= 0.45) & (hot >= 2), 2).when(top >= 0.30, 1).otherwise(0)
    score = F.when(lv == 3, 0.75).when(lv == 2, 0.55).when(lv == 1, 0.30).otherwise(0.0)
    enough = w["n_windows"] > 0
    return _channel("windowing", F.when(enough, score).otherwise(0.0), F.when(enough, lv).otherwise(0), enough, True)


def mode(composite: Column, idi: Column, framing: Column, nssi_signals: Column, words: Column) -> Column:
    prompt = F.when(composite >= 0.15, composite).otherwise(0.0) + F.when(idi >= 5, 0.3).otherwise(0.0) + F.when(framing >= 2, 0.2).otherwise(0.0)
    generic = F.when(nssi_signals >= 3, 0.4).otherwise(0.0) + F.when(words >= 400, 0.2).otherwise(0.0)
    return F.when(generic > prompt + 0.1, "generic_aigt").otherwise("task_prompt")


def _named(channels: Column, among, most: int, strongest: bool) -> Column:
    """Names and severities of the first ``most`` channels that qualify, the strongest first if asked."""
    placed = F.transform(channels, lambda c, i: F.struct((-c["level"] if strongest else F.lit(0)).alias("l"), i.alias("i"), c.alias("c")))
    return F.array_join(F.transform(F.slice(F.array_sort(F.filter(placed, lambda e: among(e["c"]))), 1, most), lambda e: F.concat_ws(" ", e["c"]["channel"], e["c"]["severity"])), " + ")


def determine(
    channels: list[Column], mode_: Column, words: Column, support_level: Column, critical: Column, mixed: Column, obfuscation: Column, disabled: tuple[str, ...] = ()
) -> Column:
    """determination, confidence, the rule and the reason that gave them, with the counts they rest on.

    The reason names the strongest channels, in channel order among equals, and what moved the verdict from theirs.
    """
    unknown = set(disabled) - set(CHANNELS)
    if unknown:
        raise ValueError(f"no channels {sorted(unknown)}; there are {CHANNELS}")
    packed = F.struct(F.array(*channels).alias("c"), mode_.alias("mode"), words.alias("words"), support_level.alias("gate"), critical.alias("critical"), mixed.alias("mixed"), obfuscation.alias("delta"))

    def counted(x: Column) -> Column:
        kept = F.filter(x["c"], lambda c: ~c["channel"].isin(*disabled)) if disabled else x["c"]
        on = lambda c: c["data_sufficient"] & (c["level"] > 0)
        primary = lambda c: (x["mode"] != "task_prompt") | ~c["generic_only"]
        n = lambda p: F.size(F.filter(kept, p))
        return F.struct(
            x["mode"].alias("mode"), x["words"].alias("words"), x["gate"].alias("gate"), x["critical"].alias("critical"), x["delta"].alias("delta"),
            n(lambda c: on(c) & (c["level"] == 3)).alias("n_red"),
            n(lambda c: on(c) & (c["level"] >= 2)).alias("n_amber_plus"),
            n(on).alias("n_yellow_plus"),
            n(lambda c: on(c) & primary(c) & (c["level"] == 3)).alias("n_primary_red"),
            n(lambda c: on(c) & primary(c) & (c["level"] >= 2)).alias("n_primary_amber"),
            n(lambda c: on(c) & primary(c)).alias("n_primary_yellow_plus"),
            n(lambda c: on(c) & ~primary(c)).alias("n_support"),
            n(lambda c: on(c) & ~primary(c) & (c["level"] >= 2)).alias("n_support_amber"),
            n(lambda c: (c["score"] > 0) | (c["level"] > 0)).alias("active_channels"),
            n(lambda c: c["score"] > 0.05).alias("n_weak"),
            _named(kept, on, REASONS_SHOWN, True).alias("why"), _named(kept, lambda c: c["score"] > 0.05, WEAK_SHOWN, False).alias("why_weak"),
            _named(kept, lambda c: on(c) & ~primary(c) & (c["level"] >= 2), REASONS_SHOWN, True).alias("why_support"),
            F.coalesce(F.array_max(F.transform(F.filter(kept, on), lambda c: c["score"])), F.lit(0.0)).alias("top"),
            (x["mixed"] & F.exists(x["c"], lambda c: (c["channel"] == "windowing") & (c["level"] > 0))).alias("mixed"),
        )

    def ruled(x: Column) -> Column:
        task, top = x["mode"] == "task_prompt", x["top"]
        short = (x["words"] > 0) & (x["words"] < 100) & (x["active_channels"] <= 2)
        converging = F.when(task, x["n_primary_yellow_plus"] + F.least(x["n_support"], F.lit(1))).otherwise(x["n_yellow_plus"])
        rule = (
            F.when(x["critical"], "L0_critical_preamble")
            .when((x["n_primary_red"] >= 1) & (x["n_yellow_plus"] >= 2), "primary_red_with_corroboration")
            .when(short & (x["n_primary_red"] >= 1) & (x["n_yellow_plus"] >= 1), "primary_red_short_text_relaxed")
            .when(x["n_primary_amber"] >= 2, "two_primary_amber_channels")
            .when(task & (x["n_primary_red"] >= 1) & (x["n_yellow_plus"] == 1), "primary_red_single_channel_demoted")
            .when(~task & (x["n_red"] >= 1), "generic_aigt_red_single_channel")
            .when((x["n_primary_amber"] >= 1) & x["mixed"], "primary_amber_mixed_windowing")
            .when(x["n_primary_amber"] >= 1, "primary_amber_single_channel")
            .when((converging >= 2) & x["mixed"], "multi_channel_convergence_mixed")
            .when(converging >= 2, "multi_channel_convergence")
            .when(task & (x["n_support_amber"] >= 1), "supporting_channel_amber")
            .when((x["n_yellow_plus"] >= 1) & x["mixed"], "yellow_signal_mixed_windowing")
            .when(x["n_yellow_plus"] >= 1, "yellow_signal")
            .when(x["delta"] >= 0.05, "obfuscation_delta")
            .when(x["n_weak"] >= 1, "weak_signals_below_threshold")
            .otherwise("no_signal")
        )

        def final(r: Column) -> Column:
            base = (
                F.when(r.isin("L0_critical_preamble", "primary_red_with_corroboration", "primary_red_short_text_relaxed", "two_primary_amber_channels", "generic_aigt_red_single_channel"), "RED")
                .when(r.isin("primary_red_single_channel_demoted", "supporting_channel_amber") | r.startswith("primary_amber") | r.startswith("multi_channel"), "AMBER")
                .when(r.startswith("yellow_signal") | (r == "obfuscation_delta"), "YELLOW")
                .when(r == "weak_signals_below_threshold", "REVIEW")
                .otherwise("GREEN")
            )
            conf = (
                F.when(r == "L0_critical_preamble", 0.99)
                .when(r == "primary_red_with_corroboration", top)
                .when(r == "primary_red_short_text_relaxed", F.least(top - 0.15, F.lit(0.75)))
                .when(r == "two_primary_amber_channels", F.least(top, F.lit(0.85)))
                .when(r.isin("primary_red_single_channel_demoted", "generic_aigt_red_single_channel"), F.least(top, F.lit(0.75)))
                .when(r.startswith("primary_amber"), F.least(top, F.lit(0.70)))
                .when(r.startswith("multi_channel"), F.least(top, F.lit(0.60)))
                .when(r == "supporting_channel_amber", 0.55)
                .when(r.startswith("yellow_signal"), F.least(top, F.lit(0.45)))
                .when(r == "obfuscation_delta", 0.35)
                .when(r == "weak_signals_below_threshold", 0.10)
                .otherwise(0.0)
            )
            ceiling = F.when(x["gate"] == "UNSUPPORTED", 1).when(x["gate"] == "REVIEW", 2).otherwise(3)
            over = (r != "weak_signals_below_threshold") & (level(base) > ceiling)
            capped, conf = F.when(over, severity_of(ceiling)).otherwise(base), F.when(over, F.least(conf, F.lit(0.40))).otherwise(conf)
            hybrid = r.endswith("_mixed") | r.endswith("_mixed_windowing")
            why = (
                F.when(r == "L0_critical_preamble", "prompt_structure: critical preamble")
                .when(r == "supporting_channel_amber", F.concat(x["why_support"], F.lit(" [supporting channel]")))
                .when(r == "obfuscation_delta", F.format_string("normalisation changed %.1f%% of the text", x["delta"] * 100))
                .when(r == "weak_signals_below_threshold", F.concat(F.lit("weak signals: "), x["why_weak"]))
                .when(r == "no_signal", "no significant signals")
                .when(r == "primary_red_short_text_relaxed", F.concat(x["why"], F.lit(" [short text]")))
                .when(r == "primary_red_single_channel_demoted", F.concat(x["why"], F.lit(" [single channel, demoted from RED]")))
                .when(r == "generic_aigt_red_single_channel", F.concat(x["why"], F.lit(" [single channel]")))
                .when(r.startswith("multi_channel"), F.concat(x["why"], F.lit(" [convergence]")))
                .otherwise(x["why"])
            )
            why = F.when(over, F.concat(why, F.lit(" [capped from "), base, F.lit(": language support "), F.coalesce(x["gate"], F.lit("")), F.lit("]"))).otherwise(why)
            why = F.when(hybrid, F.concat(why, F.lit(" [windows vary as in hybrid text]"))).otherwise(why)
            limit = F.when(r.startswith("primary_amber"), 0.60).when(r.startswith("multi_channel"), 0.55).otherwise(0.50)
            return F.struct(
                F.when(hybrid, "MIXED").otherwise(capped).alias("determination"),
                F.when(hybrid, F.least(conf, limit)).otherwise(conf).alias("confidence"),
                r.alias("triggering_rule"), why.alias("reason"), x["mode"].alias("mode"), short.alias("short_text_adjustment"),
                *[x[c].alias(c) for c in ("n_primary_red", "n_primary_amber", "n_primary_yellow_plus", "n_yellow_plus", "n_red", "n_amber_plus", "active_channels")],
            )

        return text.bound(rule, final)

    return text.bound(text.bound(packed, counted), ruled)
