import itertools

import pytest
from pyspark.sql import functions as F

from inkstone.functions import text
from inkstone.operators import cohort, sequences, similarity
from inkstone.sources import files
from inkstone.sources.store import Store


def test_jaccard_pairs_match_brute_force(spark):
    texts = ["a b c d e f g", "a b c d e f g", "a b c d e x y", "q r s t", "", None, "a b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", F.lit("g").alias("g"), text.shingle_set(F.coalesce("t", F.lit(""))).alias("s"))
    sets = {r["id"]: set(r["s"]) for r in rows.collect()}
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.4}
    got = {(r[0], r[1]) for r in similarity.jaccard_pairs(rows, "id", "g", "s", 0.4).collect()}
    assert got == want and (0, 1) in got


def test_minhash_equals_hashlib(spark):
    import hashlib
    import struct

    row = spark.createDataFrame([(["a b c", "b c d"],)], "s array<string>").select(similarity.minhash(F.col("s")).alias("m")).first()["m"]
    want = [min(int.from_bytes(hashlib.md5(struct.pack(">I", i) + s.encode()).digest()[:4], "big") for s in ("a b c", "b c d")) for i in range(128)]
    assert row == want


def test_cross_batch_skips_same_author(spark):
    sig = list(range(128))
    cur = spark.createDataFrame([(1, "Ann", sig), (2, "Bob", sig[:60] + [0] * 68)], "id int, author string, m array<bigint>")
    old = spark.createDataFrame([(11, " ann ", sig), (12, None, sig)], "id int, author string, m array<bigint>")
    assert {(r[0], r[1]) for r in similarity.cross_batch(cur, old, "id", "author", "m").collect()} == {(1, 12)}


def test_feedback_raises_only(spark):
    rows = spark.createDataFrame([(1, "GREEN"), (2, "RED"), (3, "GREEN"), (4, "GREEN")], "k int, determination string")
    pairs = spark.createDataFrame([(1, 2, "adaptive"), (3, 4, "text")], "k_a int, k_b int, kind string")
    got = {r["k"]: r["adjusted"] for r in similarity.feedback(rows, pairs, "k").collect()}
    assert got == {1: "YELLOW", 2: "RED", 3: "GREEN", 4: "GREEN"}


def test_order_statistics_with_ties(spark):
    rows = spark.createDataFrame([("a", v) for v in (1.0, 1.0, 2.0, 3.0)] + [("b", 5.0)], "g string, v double")
    got = {r["g"]: r["m"] for r in cohort.nth_smallest(rows, ["g"], "v", {"m": F.ceil(F.col("n") / 2)}).collect()}
    assert got == {"a": 1.0, "b": 5.0}


def test_latest_takes_nulls_along_and_empty_tables(spark):
    rows = spark.createDataFrame([("x", 1, "old"), ("x", 2, None), (None, 3, "z")], "k string, at int, v string")
    assert [tuple(r) for r in cohort.latest(rows, "k", ["at"]).select("k", "v").collect()] == [("x", None)]
    assert cohort.latest(rows.limit(0), "k", ["at"]).count() == 0


def test_changepoint(spark):
    jump = [0.1] * 10 + [0.9] * 10
    df = spark.createDataFrame([(jump,), ([1.0] * 20,), ([1.0, 2.0],)], "xs array<double>")
    got = [r["c"] for r in df.select(sequences.changepoint(F.col("xs"), 1.0).alias("c")).collect()]
    assert got[0]["changepoint"] == 10 and got[1] is None and got[2] is None


def test_moving_vocabulary_matches_definition(spark):
    words = [f"w{i * i % 17}" for i in range(120)]
    want = sum(len(set(words[i : i + 50])) / 50 for i in range(71)) / 71
    got = sequences.mattr(spark.createDataFrame([(1, words)], "k int, w array<string>"), "k", F.col("w")).first()["mattr"]
    assert abs(got - want) < 1e-6


@pytest.mark.parametrize("spec,at", [("A", 0), ("ab", 27), ("3", 2), ("prompt", None), ("", None)])
def test_column_letters(spec, at):
    assert files.letter_index(spec) == at


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('Task_ID,The Prompt,Attempter_Name\n001,"' + "long text, with a\nline break and ""quotes"" " * 3 + '",Ann\n2,short,Bob\n')
    rows = files.read_csv(spark, str(path)).collect()
    assert len(rows) == 1 and rows[0]["task_id"] == "001" and rows[0]["attempter"] == "Ann" and "\n" in rows[0]["prompt"]


def test_jsonl_drops_malformed_lines(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"task_id": "a", "text": "x"}\nnot json\n{"task_id": "b", "prompt": "y"}\n{"task_id": "", "text": "z"}\n')
    assert {tuple(r) for r in files.read_corpus(spark, str(path)).collect()} == {("a", "x"), ("b", "y")}


def test_store_batches_are_idempotent(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, "t1", "RED", 0.9), (2, "t1", "GREEN", 0.1)], "sub_id int, task_id string, determination string, confidence double")
    store.record_batch("submissions", rows, "b1")
    store.record_batch("submissions", rows, "b1")
    store.record_batch("submissions", rows, "b2")
    assert store.read("submissions").count() == 4
    store.confirm(spark.createDataFrame([("t1", "ai"), ("t9", "human")], "task_id string, ground_truth string"))
    got = {r["task_id"]: r["pipeline_determination"] for r in store.read("confirmed").collect()}
    assert got == {"t1": "RED", "t9": None}


def test_streamed_flag_rates(spark, tmp_path):
    from inkstone.streaming import batches

    src = tmp_path / "src"
    spark.createDataFrame([("2026-01-01 00:10:00", "RED"), ("2026-01-01 00:20:00", "GREEN")], "at string, determination string").select(F.to_timestamp("at").alias("at"), "determination").write.parquet(str(src))
    stream = spark.readStream.schema("at timestamp, determination string").parquet(str(src))
    q = batches.flag_rates(stream, "at").writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["n"], r["flagged"]) for r in spark.table("rates").collect()] == [(2, 1)]
