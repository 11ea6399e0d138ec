import random

from pyspark.sql import functions as F

from inkstone.llm.history_index import History


def test_batches_added_one_by_one_follow_the_sequential_rule(spark, tmp_path):
    rng = random.Random(11)
    rows, texts = [], []
    for i in range(120):
        if texts and rng.random() < 0.5:
            w = rng.choice(texts).split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice("uvwxyz") + str(rng.randrange(50))
        else:
            w = [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(25)]
        texts.append(" ".join(w))
        rows.append((i, rng.choice([None, None, f"k{rng.randrange(50)}"]), texts[-1] if rng.random() < 0.95 else None, f"b{i * 6 // 120}"))
    sh = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} if t else set() for i, _, t, _ in rows}
    near = lambda a, b: bool(sh[a] and sh[b]) and len(sh[a] & sh[b]) / len(sh[a] | sh[b]) >= 0.5
    key = {i: k for i, k, _, _ in rows}
    df = spark.createDataFrame(rows, "row_idx long, k string, t string, b string")
    history, accepted = History(spark, f"file://{tmp_path}/history"), []
    for b in range(6):
        part = df.where(F.col("b") == f"b{b}")
        add = lambda part=part, b=b: {tuple(r) for r in history.add_batch(f"b{b}", part, "row_idx", F.col("k"), F.col("t")).collect()}
        got = add()
        new = [i for i, _, _, x in rows if x == f"b{b}"]
        want = {(j, i) for i in new for j in accepted if (key[i] and key[i] == key[j]) or near(i, j)}
        assert got == want
        if b == 2:
            assert add() == want
        accepted += [i for i in new if not any(p[1] == i for p in want)]
        if b == 3:
            assert history.compact() == ["1~b0~b3"] and history.compact() == []
    assert history.add_batch("b9", df.limit(0), "row_idx", F.col("k"), F.col("t")).count() == 0
