"""From a table of submissions to scored rows: normalise, signals, channels, fusion, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.functions import text
from inkstone.operators import fusion, residue_python, signals
from inkstone.session import materialize


def signalled(rows: DataFrame, text_col: str, normalize: bool = True) -> DataFrame:
    """Adds one struct per signal. Columns not asked for later are pruned by the optimizer."""
    raw = F.coalesce(F.col(text_col), F.lit(""))
    df = rows.withColumn("norm", residue_python.normalized(raw)) if normalize else rows.withColumn("norm", F.struct(raw.alias("text"), F.lit(0.0).alias("obfuscation_delta")))
    t = F.col("norm.text")
    df = (
        df.withColumn("word_count", text.word_count(t))
        .withColumn("gate", text.language_gate(t))
        .withColumn("preamble", signals.preamble(t))
        .withColumn("fingerprint", signals.fingerprint(t))
        .withColumn("signature", signals.prompt_signature(t))
        .withColumn("voice", signals.voice_dissonance(t))
        .withColumn("density", signals.instruction_density(t))
        .withColumn("packs", signals.lexicon_packs(t))
        .withColumn("windows", signals.windows(t))
        .withColumn("expository", signals.expository(t))
    )
    return df.withColumn("sentence_count", F.size(text.sentences(t)))


def modelled(df: DataFrame) -> DataFrame:
    """Adds what needs Python: compression ratios and the local continuation model."""
    t = F.col("norm.text")
    return df.withColumn("zip", residue_python.compression(t)).withColumn("cont", residue_python.continuation(t))


def score(rows: DataFrame, text_col: str, with_models: bool = True, disabled: tuple[str, ...] = ()) -> DataFrame:
    """Scored rows. The signals are written once, since fusion reads them many times and an optimizer
    that inlined them would evaluate every pattern again for every use."""
    df = signalled(rows, text_col)
    return determined(materialize(modelled(df) if with_models else df, "signals"), with_models, disabled)


def determined(df: DataFrame, with_models: bool = True, disabled: tuple[str, ...] = (), mode: str = "auto") -> DataFrame:
    """Adds ``raised``, ``nssi``, ``channels`` and ``verdict`` to signals; models need ``modelled`` first."""
    df = df.withColumn("raised", signals.enhanced(F.col("signature"), F.col("voice"), F.col("density"), F.col("packs"), F.col("sentence_count"), F.col("word_count")))
    if with_models:
        df = df.withColumn("nssi", signals.self_similarity(F.col("expository"), F.col("zip.comp_ratio"), F.col("zip.shuffled_comp_ratio")))
    else:
        none = F.struct(F.lit(None).cast("string").alias("determination"), F.lit(0.0).alias("confidence"))
        df = df.withColumn("nssi", signals.self_similarity(F.col("expository"), F.lit(1.0), F.lit(2.0))).withColumn("cont", none)
    c = lambda name: F.col(name)
    voice = {n: c(f"voice.{n}") for n in ("voice_gated", "voice_score", "contractions", "hedges")} | {"vsd": c("raised.vsd"), "spec_score": c("raised.spec_score")}
    channels = [
        fusion.prompt_structure(c("preamble.score"), c("preamble.severity"), c("raised.composite"), voice, c("raised.idi"), c("word_count")),
        fusion.stylistic(c("fingerprint.score"), {"determination": c("nssi.determination"), "confidence": c("nssi.confidence")}),
        fusion.continuation(c("cont.determination"), c("cont.confidence"), F.lit(with_models)),
        fusion.windowing(c("windows")),
    ]
    auto = fusion.mode(c("raised.composite"), c("raised.idi"), c("signature.framing_completeness"), c("nssi.nssi_signals"), c("word_count"))
    df = df.withColumn("channels", F.array(*channels))
    verdict = fusion.determine(
        [F.get(c("channels"), F.lit(k)) for k in range(4)], auto if mode == "auto" else F.lit(mode), c("word_count"), c("gate.support_level"),
        c("preamble.severity") == "CRITICAL", c("windows.mixed_signal"), c("norm.obfuscation_delta"), disabled,
    )
    return df.withColumn("verdict", verdict)


def structural_vector(df: DataFrame) -> DataFrame:
    """Adds ``structural_vec``, the sixteen features a fingerprint keeps, in their fixed order."""
    style = signals.stylometry(F.col("norm.text"))
    df = df.withColumn("style", style)
    cols = (
        "raised.composite signature.cfd signature.mfsr signature.must_rate raised.idi raised.spec_score voice.voice_score nssi.nssi_score zip.comp_ratio "
        "expository.hapax_ratio expository.sent_length_cv windows.max_window_score windows.mean_window_score style.function_word_ratio "
        "style.type_token_ratio style.sent_length_dispersion"
    ).split()
    return df.withColumn("structural_vec", F.array(*[F.col(x).cast("double") for x in cols]))


def report(df: DataFrame) -> DataFrame:
    """One JSON report per scored row: verdict, probability with its half width, leading signals."""
    det, conf = F.col("verdict.determination"), F.col("verdict.confidence")
    middle = F.when(det == "RED", 0.90).when(det.isin("AMBER", "MIXED"), 0.70).when(det == "YELLOW", 0.50).when(det == "REVIEW", 0.35).otherwise(0.10)
    half = F.lit(0.12) * (1 - 0.5 * F.when(conf > 0, conf).otherwise(0.5))
    leading = F.filter("channels", lambda x: x["level"] > 0)
    return df.withColumn(
        "report",
        F.to_json(
            F.struct(
                F.when(det == "REVIEW", "UNCERTAIN").otherwise(det).alias("determination"), middle.alias("p_llm"),
                F.greatest(middle - half, F.lit(0.0)).alias("low"), F.least(middle + half, F.lit(1.0)).alias("high"),
                F.transform(leading, lambda x: x["channel"]).alias("signals"), F.col("verdict.triggering_rule").alias("rule"),
            )
        ),
    )
