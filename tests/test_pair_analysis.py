import itertools
import math
import random
import statistics

from pyspark.sql import functions as F

from inkstone import queries
from inkstone.operators import pair_analysis


def _rows(n: int) -> list[tuple]:
    rng = random.Random(7)
    base = [f"x{i}" for i in range(12)]
    out = []
    for k in range(n):
        s = [w for w in base if rng.random() < 0.4] if k % 3 else []
        out.append((k, "g" if k < n - 3 else "h", ("Ann", " ann ", None, "", "Bob")[k % 5], s, [round(rng.random() * (0.2 if k % 2 else 3), 2) for _ in range(16)]))
    return out + [(n, "one", None, ["q"], [0.0] * 16)]


def _expected(rows):
    stats, flagged = {}, {}
    for g in {r[1] for r in rows}:
        pairs = []
        for x, y in itertools.combinations([r for r in rows if r[1] == g], 2):
            a, b = set(x[3]), set(y[3])
            pairs.append((x, y, len(a & b) / len(a | b) if a and b else 0.0, 1 / (1 + math.dist(x[4], y[4]))))
        for m, at, absolute, margin in (("text", 2, 0.4, 0.05), ("structural", 3, 0.9, 0.03)):
            v = [p[at] for p in pairs]
            median, spread, limit = 0.0, 0.0, absolute
            if len(v) >= 3:
                median, spread = statistics.median(v), statistics.stdev(v)
                limit = median + 2 * max(spread, 0.02)
                stats[g, m] = (len(v), median, spread)
            for p in pairs:
                who = [(r[2] or "").strip().lower() for r in p[:2]]
                if who[0] and who[0] == who[1]:
                    continue
                kind = m if p[at] >= absolute else f"{m}_adaptive" if p[at] >= limit and p[at] > median + margin else None
                if kind:
                    flagged.setdefault((p[0][0], p[1][0]), []).append(kind)
    return stats, flagged


def test_baseline_and_flags_match_all_pairs(spark):
    rows = _rows(60)
    df = spark.createDataFrame(rows, "k int, g string, author string, s array<string>, v array<double>")
    stats, flagged = _expected(rows)
    for block_rows in (1000, 13):
        sets = pair_analysis.prepared(df, "k", "g", "author", "s", "v", block_rows=block_rows)
        base = pair_analysis.baseline(sets)
        got = {(r["g"], r["measure"]): (r["pairs"], r["median"], r["spread"]) for r in base.collect()}
        assert got.keys() == stats.keys()
        assert all(got[k][0] == stats[k][0] and math.dist(got[k][1:], stats[k][1:]) < 1e-9 for k in stats)
        assert {(r["k_a"], r["k_b"]): r["flags"] for r in pair_analysis.flagged_pairs(sets, base).collect()} == flagged
        seen = {r["k"]: (r["partners"], r["adaptive"]) for r in pair_analysis.flag_counts(sets, base).collect()}
        want = {k: (sum(k in p for p in flagged), int(any(k in p and any("adaptive" in f for f in fs) for p, fs in flagged.items()))) for p in flagged for k in p}
        assert seen == want and {0, 1} == {x[1] for x in want.values()}


def test_shared_instructions_are_factored_out(spark):
    df = spark.createDataFrame([(1, "g", "A", ["i", "a"], None), (2, "g", "B", ["i", "b"], None)], "k int, g string, author string, s array<string>, v array<double>")
    sets = pair_analysis.prepared(df, "k", "g", "author", "s", factor_out=F.array(F.lit("i")))
    assert pair_analysis.flagged_pairs(sets, pair_analysis.baseline(sets)).count() == 0
    df = df.withColumn("s", F.array(F.lit("i")))
    sets = pair_analysis.prepared(df, "k", "g", "author", "s")
    assert pair_analysis.flagged_pairs(sets, pair_analysis.baseline(sets)).count() == 1


def test_small_groups_keep_all_their_pairs(spark, tmp_path):
    rows = [(i, "mark each crate and " + ("weigh it twice" if i < 4 else f"note {i}"), "o", None) for i in range(10)]
    spark.createDataFrame(rows, "row_idx bigint, prompt string, occupation string, attempter string").write.parquet(str(tmp_path / "tasks.parquet"))
    assert [(r["occupation"], r["pairs"]) for r in queries.QUERIES["similarity_baseline"](spark, str(tmp_path)).collect()] == [("o", 45)]
