import re
from collections import Counter

from pyspark.sql import functions as F

from inkstone import queries
from inkstone.functions import text
from inkstone.operators import signals

TEXTS = [
    "Mail ann@site.org the 2500 ROWS, then mail them again: \u201cdone\u201d \u2014 really\u3002\u3001 (ok)?! \u201cdone\u201d",
    "abcabcabc", "abc", "", "...!?...!?", "__init__ __main__ x_y", "na\u00efve caf\u00e9 \u2013 10 \u20ac, \u4f60\u597d\uff0c\u4e16\u754c\u3002",
]


def test_profiles_match_counters(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string")
    t = F.col("t")
    for r in df.select("t", text.mask_topics(t)[0].alias("m"), signals.char_profile(t).alias("c"), signals.punctuation_profile(t).alias("p")).collect():
        low = r["m"].lower()
        grams = Counter(g for g in (low[i : i + 4] for i in range(len(low) - 3)) if not g.startswith("_"))
        assert [(x["item"], x["n"]) for x in r["c"]] == [(g, n / sum(grams.values())) for g, n in grams.most_common(50)]
        marks = re.findall(r"[^\w\s]", r["t"])
        assert [(x["item"], x["n"]) for x in r["p"]] == Counter(a + b for a, b in zip(marks, marks[1:])).most_common(20)


def test_every_row_has_profiles(spark, tmp_path):
    spark.createDataFrame(list(enumerate([*TEXTS, None])), "row_idx bigint, prompt string").write.parquet(str(tmp_path / "tasks.parquet"))
    for name in ("char_profiles", "punctuation_profiles"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == len(TEXTS) + 1
