from pyspark.sql import functions as F

from inkstone.functions import text
from inkstone.operators import residue_python, signals


def one(spark, builder, value):
    return spark.createDataFrame([(value,)], "t string").select(builder(F.coalesce("t", F.lit(""))).alias("s")).first()["s"]


def test_preamble_takes_the_worst_severity(spark):
    s = one(spark, signals.preamble, "Sure thing! Step 1: copy-paste this.")
    assert (s["severity"], s["score"], set(s["names"])) == ("CRITICAL", 0.99, {"assistant_ack", "copy_paste_instruction", "cot_step_numbering"})
    assert one(spark, signals.preamble, "x" * 600 + "<think>")["severity"] == "NONE"


def test_preamble_of_null_and_empty(spark):
    assert one(spark, signals.preamble, None)["severity"] == one(spark, signals.preamble, "")["severity"] == "NONE"


def test_fingerprint_rate(spark):
    s = one(spark, signals.fingerprint, "We delve into the cutting-edge realm. Delve!")
    assert s["hits"] == 4 and abs(s["score"] - 0.8) < 1e-9


def test_prompt_signature_ladder(spark):
    t = "You are a manager. The report must include a table. It must address risk, no more than 3 pages. Submit your final deliverable."
    s = one(spark, signals.prompt_signature, t)
    assert s["framing_completeness"] == 3 and s["distinct_frames"] >= 3 and s["cfd"] > 0.5
    assert abs(s["composite"] - (0.40 + 0.05 + 0.10)) < 1e-6 or s["composite"] > 0.5


def test_voice_and_density(spark):
    v = one(spark, signals.voice_dissonance, "hey, dont use data.csv or data.csv\nok so we gonna compute the ratio")
    assert v["casual_markers"] == 4 and v["filenames"] == 1 and v["voice_gated"]
    d = one(spark, signals.instruction_density, "You must include it if MISSING. Yes or No. Flag it, unless set.")
    assert (d["imperatives"], d["conditionals"], d["binary_specs"], d["missing_refs"], d["flag_count"]) == (3, 2, 2, 1, 1)


def test_windows_need_five_sentences(spark):
    assert one(spark, signals.windows, "One. Two. Three.")["n_windows"] == 0
    s = one(spark, signals.windows, " ".join(f"Furthermore, item {i} is comprehensive and robust." for i in range(9)))
    assert s["n_windows"] == 3 and s["max_window_score"] > 0.3 and s["hot_span_length"] == 3


def test_language_gate(spark):
    english = "the cat is on the mat and it was not in the house " * 4
    assert one(spark, text.language_gate, english)["support_level"] == "SUPPORTED"
    assert one(spark, text.language_gate, "слово " * 40)["support_level"] == "UNSUPPORTED"
    assert one(spark, text.language_gate, "too short")["support_level"] == "REVIEW"


def test_normalize_reports_evasion():
    out, delta, invisible, glyphs, spaced, ws, kinds = residue_python.normalize("p​asswоrd   and “quotes”")
    assert out == 'password and "quotes"' and invisible == 1 and glyphs == 3 and ws and delta > 0
    assert kinds == ["invisible_char", "homoglyph", "whitespace"]
    assert residue_python.normalize("l i k e this")[0] == "like this"
    assert residue_python.normalize("")[0] == ""


def test_self_similarity_needs_200_words(spark):
    df = spark.createDataFrame([("word " * 50,), ("Furthermore, this analysis provides a comprehensive view. " * 40,)], "t string")
    got = df.select(signals.self_similarity(signals.expository(F.col("t")), F.lit(0.1), F.lit(0.1)).alias("s")).collect()
    assert got[0]["s"]["determination"] is None and got[0]["s"]["nssi_score"] == 0.0
    assert got[1]["s"]["determination"] == "RED" and got[1]["s"]["nssi_signals"] >= 7


def test_continuation_of_short_and_repetitive_text():
    assert residue_python.continue_locally("short")[-2:] == (None, 0.0)
    got = residue_python.continue_locally("The same plain sentence comes again and again here. " * 40)
    assert got[-2] in ("RED", "AMBER") and got == residue_python.continue_locally("The same plain sentence comes again and again here. " * 40)


def test_spans_are_code_points():
    spans = residue_python.find_spans("😀 we delve MUST")
    assert [(s["start"], s["end"]) for s in spans if s["source"] == "fingerprint"] == [(5, 10)]


def test_draws_are_those_of_one_generator_per_cut():
    """The draws with what must follow taken at once, against one draw for each token."""
    import bisect
    import itertools
    import random

    words = "a b a b c a b d the end of a b c the end . a a a a b".split() * 3
    model, rng, dice = residue_python.BackoffModel(words, 5), random.Random(42), residue_python._dice(16 * 50)
    used = 0
    for _ in range(16):
        want, key = [], model._context(words[-5:])
        for _ in range(50):
            counts = model.next[key]
            sums = list(itertools.accumulate(counts.values()))
            want.append(list(counts)[bisect.bisect_right(sums, rng.random() * sums[-1])])
            key = model._after(key, want[-1])
        got = model.sample(words, 50, dice, used)
        used += len(got)
        assert got == want
    empty = residue_python.BackoffModel([], 5)
    assert empty.sample([], 10, dice) == [] and residue_python._dice(1 << 17)[:99].tolist() == dice[:99]
