import itertools

from inkstone import queries
from inkstone.operators import similarity


def test_earlier_batches_match_brute_force(spark):
    sig, half, other = list(range(128)), list(range(64)) + [-1] * 64, list(range(500, 628))
    rows = [(1, "Ann", sig, "b1"), (3, "Bob", sig, "b2"), (5, None, half, "b2"), (7, " ann ", sig, "b3"), (9, "Cid", other, "b3"), (11, "Dee", sig, "b3"), (13, "Eve", sig, None), (2, "Fay", half, "b1")]
    df = spark.createDataFrame(rows, "id int, author string, m array<bigint>, b string")
    name = lambda a: (a or "").strip().lower()
    want = {}
    for x, y in itertools.permutations([r for r in rows if r[3]], 2):
        alike = sum(p == q for p, q in zip(x[2], y[2])) / 128
        if y[3] < x[3] and alike >= 0.5 and not (name(x[1]) and name(x[1]) == name(y[1])):
            want[x[0], y[0]] = alike
    got = {(r[0], r[1]): r[2] for r in similarity.earlier_batches(df, "id", "author", "m", "b").collect()}
    assert got == want and (3, 1) in got and (3, 2) in got


def test_cross_batch_takes_batches_from_the_table(spark, tmp_path):
    prompt = "write a short note on how the crane is checked before each lift"
    tasks = [(1, prompt, "o", "Ann"), (3, prompt, "o", "Bob"), (2, prompt, "o", "Cid"), (4, prompt, "o", "Dee")]
    spark.createDataFrame(tasks, "row_idx bigint, prompt string, occupation string, attempter string").write.parquet(str(tmp_path / "tasks.parquet"))
    named = [(1, "b1"), (3, "b2"), (3, "b1x"), (2, "b2"), (4, "b2")]
    spark.createDataFrame(named, "row_idx bigint, batch_id string").write.parquet(str(tmp_path / "fingerprints.parquet"))
    got = {(r[0], r[1]) for r in queries.QUERIES["cross_batch"](spark, str(tmp_path)).collect()}
    assert got == {(3, 1), (2, 1), (4, 1), (2, 3), (4, 3)}


def test_bitmaps_leave_every_pair_that_reaches_the_threshold(spark):
    import random

    from pyspark.sql import functions as F

    from inkstone.functions import text

    rng = random.Random(3)
    items = [rng.getrandbits(64) - (1 << 63) for _ in range(400)]
    sets = [[], items[:1], items, items[:300]] + [rng.sample(items[:n], n * 2 // 3) for n in (6, 60, 90, 150)] + [rng.sample(items[:60], 40) for _ in range(6)] + [items[380:]]
    rows = [(a, b) for a in sets for b in sets]
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>").select("*", F.size("a").alias("n"), F.size("b").alias("m"))
    both = df.select("a", "b", *[text.may_share(text.item_bits(F.col("a"), w), text.item_bits(F.col("b"), w), F.col("n"), F.col("m"), 0.5).alias(f"w{w}") for w in (1, 8)]).collect()
    close = lambda r: len({*r["a"]} & {*r["b"]}) >= 0.5 * len({*r["a"]} | {*r["b"]})
    assert all(r["w1"] and r["w8"] for r in both if close(r)) and sum(not r["w8"] for r in both) > len(both) // 4


def test_prefixes_in_array_code_are_those_of_md5():
    import struct
    from hashlib import md5

    shingles = ["", "a b c", "é" * 25 + "x", "x" * 51, "x" * 52, "y" * 200, "one two three", "字 母 表"]
    got = similarity._prefixes([x.encode() for x in shingles])
    for x, row in zip(shingles, got.tolist()):
        assert row == [int.from_bytes(md5(struct.pack(">I", k) + x.encode()).digest()[:4], "big") for k in range(similarity.HASHES)]
