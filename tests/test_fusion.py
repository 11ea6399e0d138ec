import itertools

from pyspark.sql import functions as F

from inkstone.operators import fusion


def verdict(spark, levels, mode="task_prompt", words=200, gate="SUPPORTED", critical=False, mixed=False, delta=0.0, disabled=()):
    names = ("prompt_structure", "stylometry", "continuation", "windowing")
    scores = (0.0, 0.3, 0.6, 0.9)
    channels = [fusion._channel(n, F.lit(scores[lv]), F.lit(lv), F.lit(True), n in ("stylometry", "windowing")) for n, lv in zip(names, levels)]
    d = fusion.determine(channels, F.lit(mode), F.lit(words), F.lit(gate), F.lit(critical), F.lit(mixed), F.lit(delta), disabled)
    return spark.range(1).select(d.alias("v")).first()["v"]


def test_ladder(spark):
    assert verdict(spark, (0, 0, 0, 0), critical=True)["triggering_rule"] == "L0_critical_preamble"
    assert verdict(spark, (3, 1, 0, 0))["determination"] == "RED"
    assert verdict(spark, (3, 0, 0, 0))["triggering_rule"] == "primary_red_single_channel_demoted"
    assert verdict(spark, (3, 0, 0, 0), words=50)["triggering_rule"] == "primary_red_short_text_relaxed"
    assert verdict(spark, (2, 0, 2, 0))["triggering_rule"] == "two_primary_amber_channels"
    assert verdict(spark, (0, 3, 0, 0), mode="generic_aigt")["determination"] == "RED"
    assert verdict(spark, (0, 2, 0, 0))["triggering_rule"] == "supporting_channel_amber"
    assert verdict(spark, (2, 0, 0, 1), mixed=True)["determination"] == "MIXED"
    assert verdict(spark, (1, 0, 0, 0))["determination"] == "YELLOW"
    assert verdict(spark, (0, 0, 0, 0), delta=0.06)["triggering_rule"] == "obfuscation_delta"
    assert verdict(spark, (0, 0, 0, 0))["determination"] == "GREEN"


def test_fairness_cap(spark):
    capped = verdict(spark, (3, 1, 0, 0), gate="UNSUPPORTED")
    assert capped["determination"] == "YELLOW" and capped["confidence"] == 0.40
    assert verdict(spark, (3, 1, 0, 0), gate="REVIEW")["determination"] == "AMBER"


def test_ablation_removes_a_channel(spark):
    assert verdict(spark, (0, 0, 0, 2), mode="generic_aigt", disabled=("windowing",))["determination"] == "GREEN"


def test_every_case_has_a_rule_and_cap_never_raises(spark):
    order = {"GREEN": 0, "YELLOW": 1, "REVIEW": 1, "AMBER": 2, "MIXED": 2, "RED": 3}
    for levels in itertools.islice(itertools.product((0, 1, 3), repeat=4), 0, None, 9):
        free, capped = verdict(spark, levels), verdict(spark, levels, gate="UNSUPPORTED")
        assert free["triggering_rule"] and order[capped["determination"]] <= order[free["determination"]]
