import datetime as dt

import pytest
from pyspark.sql import functions as F

from inkstone import session
from inkstone.operators import cohort, memory, models


def _rows(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, " Ann ", "RED", 0.9, "Nurse", "b1", t, 1.0), (2, "Ann", "GREEN", 0.1, None, "b2", t, float("nan")), (3, "Ann", None, None, " ", "b2", None, None), (4, None, "RED", 0.5, "Cook", "b1", t, 2.0), (5, "  ", "RED", 0.5, "Cook", "b1", t, 2.0)]
    return spark.createDataFrame(rows, "sub_id long, attempter string, determination string, confidence double, occupation string, batch_id string, recorded_at timestamp, f double")


def test_author_memory_counts_nulls_as_nothing(spark):
    confirmed = spark.createDataFrame([("Ann", "ai"), (None, "ai"), ("Bob", "human")], "attempter string, ground_truth string")
    got = memory.author_memory(_rows(spark), confirmed, ["f"]).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["attempter"], r["total"], r["n_red"], r["batches"], r["occupations"], r["mean_f"], r["flag_rate"], r["confirmed_ai"], r["risk_tier"]) == ("Ann", 3, 1, 2, "Nurse", 0.333, 0.333, 1, "HIGH")
    assert memory.author_memory(_rows(spark).limit(0), confirmed, ["f"]).count() == 0


def test_primary_channel_takes_the_first_of_equals(spark):
    rows = spark.sql("""select * from values (1, 'Ann', 'RED', array(named_struct('channel', 'p', 'severity', 'RED', 'level', 3), named_struct('channel', 's', 'severity', 'AMBER', 'level', 2))),
      (2, 'Ann', 'GREEN', array(named_struct('channel', 's', 'severity', 'RED', 'level', 3))), (3, 'Bob', null, null) as t(row_idx, attempter, determination, channels)""")
    assert [tuple(r) for r in memory.primary_channels(rows).collect()] == [("Ann", "p", 1)]
    assert {tuple(r) for r in memory.channel_counts(rows).collect()} == {("p", "RED", 1), ("s", "AMBER", 1), ("s", "RED", 1)}
    assert [tuple(r) for r in memory.leading_channels(rows, "row_idx").collect()] == [("p", 1, 100.0, "1")]


def test_queue_and_overview(spark):
    rows = _rows(spark)
    assert [r["sub_id"] for r in memory.labelling_queue(rows, "sub_id", 3).collect()] == [1, 4, 5]
    assert tuple(memory.overview(rows, "sub_id").select("n", "mode").first()) == (5, "RED")


@pytest.mark.parametrize("nc,want", [(0.05, 1.0), (0.2, 0.10), (0.35, 0.05), (0.5, 0.01)])
def test_conformity_level_follows_the_quantiles_in_order(spark, nc, want):
    # Quantiles fall as the share grows; the first that holds the score gives the level.
    table = spark.createDataFrame([(None, None, True, 30, 0.1, 0.3, 0.4)], "task_domain string, length_bin string, is_global boolean, n long, q01 double, q05 double, q10 double")
    row = spark.createDataFrame([(1, 1 - nc, None, None)], "result_id long, confidence double, task_domain string, length_bin string")
    assert cohort.calibrate(row, table).first()["conformity_level"] == want


def test_null_strata_are_unknown_and_need_twenty_rows_in_all(spark):
    rows = lambda n: spark.createDataFrame([("human", i / 100, None, "") for i in range(n)], "ground_truth string, confidence double, task_domain string, length_bin string")
    assert cohort.conformal_table(rows(19)).count() == 0
    table = cohort.conformal_quantiles(rows(20))
    assert {r["task_domain"] for r in table.collect()} == {None, "unknown"}
    row = spark.createDataFrame([(1, 0.5, None, None)], "result_id long, confidence double, task_domain string, length_bin string")
    assert cohort.calibrate(row, table).first()["stratum"] == "unknown_unknown"


def test_disagreement_has_one_threshold(spark):
    df = spark.createDataFrame([("RED", 0.79), ("RED", 0.81), ("GREEN", 0.81), (None, 0.9), ("GREEN", 0.5)], "d string, p double")
    got = [r[0] for r in df.select(models.shadow_disagreement(F.col("d"), F.col("p"))).collect()]
    assert got == ["rule_flags_model_passes", None, "model_flags_rule_passes", "model_flags_rule_passes", None]


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster())
