import json

import pytest
from pyspark.sql import functions as F

from inkstone import reports
from inkstone.functions import sql as names
from inkstone.operators import continuations, fusion, models, sequences
from inkstone.plans import pipeline
from inkstone.sources import files
from inkstone.sources.store import Store
from inkstone.streaming import batches

TASK = "You are a data analyst. You must always include the totals. If the sum exceeds 10, flag the row. " * 12


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(1, TASK, "Ann"), (2, None, "Bob"), (3, "hey <b>pls</b> & thx, kinda short", None)]
    return pipeline.score(spark.createDataFrame(rows, "row_idx long, prompt string, attempter string"), "prompt", with_models=False).cache()


def test_every_verdict_has_a_reason(scored):
    got = {r["row_idx"]: r["verdict"] for r in scored.select("row_idx", "verdict").collect()}
    assert got[2]["determination"] == "GREEN" and got[2]["reason"] == "no significant signals"
    assert all(v["reason"] for v in got.values()) and "prompt_structure" in got[1]["reason"]


def test_pages_escape_what_they_quote(scored, tmp_path):
    pages = {r["row_idx"]: r["html"] for r in reports.single(scored, "row_idx", "prompt").collect()}
    assert len(pages) == 3 and "<b>pls" not in pages[3] and "&lt;b&gt;" in pages[3] and pages[1].count("<tr>") == 5
    assert "Prompt structure" in pages[1] and "supporting" in pages[1]
    summary = reports.summary(scored)
    assert "GREEN" in summary.first()["html"]
    reports.write_html(summary, str(tmp_path / "html"))
    assert reports.console(scored, "row_idx").count() == 3


def test_unknown_channels_are_refused(spark):
    none = F.lit(0)
    with pytest.raises(ValueError, match="no channels"):
        fusion.determine([], F.lit("task_prompt"), none, F.lit(None), F.lit(False), F.lit(False), F.lit(0.0), ("window",))


def test_model_replaces_the_rules_only_where_it_can(spark, scored):
    assert models.fused(scored, None, ["x"]) is scored and models.fused(scored, object(), ["absent"]) is scored
    data = spark.createDataFrame([(float(i), float(i > 5), 1.0) for i in range(12)], "x double, label double, weight double")
    model = models.shadow_model(data, ["x"], 12)
    rows = scored.withColumn("x", F.when(F.col("row_idx") == 1, 100.0))
    got = {r["row_idx"]: r for r in models.fused(rows, model, ["x"]).select("row_idx", "x", "verdict").collect()}
    assert got[1]["verdict"]["determination"] == "RED" and got[1]["verdict"]["triggering_rule"] == "ml_fusion" and got[2]["x"] is None


def test_names_in_sql(spark):
    assert "ink_jaccard" in names.register(spark)
    row = spark.sql("SELECT ink_words('a b  c') AS w, ink_length_bin('a') AS b, ink_jaccard(array('a', 'b'), array('b', 'c')) AS j, ink_risk_tier(1, 0.6D) AS r, ink_is_flagged(NULL) AS f, ink_cosine(array(1D, 0D), array(1D, 0D)) AS c").first()
    assert (row["w"], row["b"], round(row["j"], 4), row["r"], row["f"], row["c"]) == (3, "short", 0.3333, "CRITICAL", False, 1.0)
    assert [tuple(r) for r in spark.sql("SELECT * FROM ink_word_chunks('a b c d e', 2)").collect()] == [(0, 2, "a b"), (1, 2, "c d"), (2, 1, "e")]
    assert spark.sql("SELECT * FROM ink_pdf_pages(NULL)").count() == 0


def test_sinks_and_run_directory(spark, tmp_path):
    df = spark.createDataFrame([(1, "RED"), (2, "GREEN")], "row_idx long, determination string")
    pairs = spark.createDataFrame([(1, 2, ["text"])], "row_idx_a long, row_idx_b long, flags array<string>")
    files.write_flagged_results(df, pairs, "row_idx", str(tmp_path / "csv"))
    got = spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()
    assert {(r["row_idx"], r["similarity_flags"]) for r in got} == {("1", "2:text"), ("2", "1:text")}
    for _ in range(2):
        files.append_baselines(df, str(tmp_path / "base"), "b1")
    assert spark.read.json(str(tmp_path / "base")).count() == 2
    files.write_candidates(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "token string, log_odds double"), str(tmp_path / "cand"))
    assert [r["token"] for r in spark.read.option("header", True).csv(str(tmp_path / "cand")).collect()] == ["b", "a"]
    (tmp_path / "fair.jsonl").write_text('{"text": "a", "ground_truth": "human", "proficiency_level": null}\n{"text": ""}\nnot json\n')
    assert files.read_fairness_corpus(spark, str(tmp_path / "fair.jsonl")).count() == 1
    paths = files.run_directory(str(tmp_path), "run", "20240101")
    files.write_parameters(spark, paths, {"mode": "auto"})
    assert spark.read.json(paths["parameters"]).first()["value"] == "auto"


def test_rolling_profiles_survive_a_repeated_batch(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, "Ann", "RED", 0.9, "Nurse"), (2, "Ann", "GREEN", 0.1, "Nurse")], "sub_id long, attempter string, determination string, confidence double, occupation string").withColumn("recorded_at", F.current_timestamp())
    run = batches.rolling_profiles(store)
    for number in (0, 0, 1):
        run(rows.where(F.col("sub_id") == number + 1), number)
    profile = store.read("profiles").collect()
    assert len(profile) == 1 and (profile[0]["total"], profile[0]["batches"], profile[0]["flag_rate"]) == (2, 2, 0.5)
    assert {tuple(r) for r in store.everything_of("Ann").collect()} == {("submissions", 1), ("submissions", 2)}
    assert store.snapshot("calibration", "x") is None


def test_perplexity_bands_and_chunks(spark):
    losses = [0.5] * 60
    row = spark.createDataFrame([(losses, [["a"] * 450, []][0])], "x array<double>, w array<string>").select(
        sequences.perplexity(F.col("x"), F.lit(0.3)).alias("p"), F.transform(sequences.chunks(F.col("w")), F.size).alias("c"), sequences.chunks(F.array().cast("array<string>")).alias("none"),
        sequences.burstiness(F.array(F.array(F.lit(1.0)), F.array(F.lit(2.0)), F.array(F.lit(3.0)))).alias("b"),
    ).first()
    assert row["p"]["determination"] == "AMBER" and row["c"] == [200, 200, 50] and row["none"] == [] and row["b"] == 1.0


def test_responses_under_unknown_ids_are_dropped(spark):
    words = " ".join(f"w{i}" for i in range(200))
    asked = continuations.requests(spark.createDataFrame([(1, words), (2, "too short"), (3, None)], "k long, t string"), "k", "t", samples=1)
    assert asked.count() == 3 and {r["k"] for r in asked.collect()} == {1}
    answers = asked.select("custom_id", F.col("rest").alias("text")).unionByName(spark.createDataFrame([("nobody", words)], "custom_id string, text string"))
    got = continuations.score_responses(asked, answers, "k").collect()
    assert len(got) == 1 and got[0]["bscore"] == 1.0 and got[0]["determination"] == "RED" and got[0]["confidence"] == 1.0 and json.dumps(got[0]["cuts"]) == "3"
