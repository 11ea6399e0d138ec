"""Guards of patterns: a pattern runs where one of the strings it needs is there, so none may be missed."""

import re

from pyspark.sql import functions as F

from inkstone.functions import lexicon, regex, tables


def _patterns():
    return [p for pack in lexicon.PACKS.values() for _, p in pack.patterns] + [p for _, p in tables.FORMULAIC] + tables.CONSTRAINT_FRAMES + tables.META_DESIGN


def test_needles_are_what_a_match_needs():
    assert regex.needles(r"\bmust\s+(?:ensure|verify)\b") == ("ensure", "verify")
    assert regex.needles(r"colou?r") == ("color", "colour")
    assert regex.needles(r"(?:cat|\d+)x") == () and regex.needles(r"(?:long)?ab\s") == () and regex.needles(r"\p{L}") == ()
    assert regex.needles(r"(?:very)*\s*(?!never)plain") == ("plain",)
    assert sum(bool(regex.needles(p)) for p in _patterns()) > 0.9 * len(_patterns())


def test_guarded_counts_are_those_of_the_pattern(spark):
    texts = ["", "MUST ALWAYS be", "muſt alwayſ be", "the ıs required to", "İS REQUIRED TO", "maſK aſK", "It is mandatory, nonnegotiable; NON-NEGOTIABLE. ſhall not", "éİ mandatory", "Σ must  ensure\nmust ensure"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    patterns = [p for pack in lexicon.PACKS.values() for _, p in pack.patterns] + [r"\bmask\b", r"\bask\b"]
    plain = F.array(*[regex.count(F.col("t"), p, True, True) for p in patterns])
    guarded = regex.searched(F.col("t"), lambda s: F.array(*[regex.count(s, p, True, True) for p in patterns]))
    rows = df.select("i", plain.alias("a"), guarded.alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and sum(map(sum, (r["a"] for r in rows))) > 10


def test_guards_hold_in_texts_made_of_the_patterns_words():
    words = sorted({w for p in _patterns() for w in re.findall(r"[A-Za-z]{2,}", p)})
    text = " ".join(words + words[::-1] + words[::2] + words[1::3])
    assert all(not regex.needles(p) or any(n in text.lower() for n in regex.needles(p)) for p in _patterns() if re.search(p, text, re.I))
