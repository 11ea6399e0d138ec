"""What is remembered of authors and occupations across batches, and what a new result is compared with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.operators import cohort

KINDS = ("RED", "AMBER", "YELLOW", "GREEN", "MIXED", "REVIEW")
# Order in which verdicts are labelled, and in which tiers are listed.
LABELLING_ORDER = ("YELLOW", "MIXED", "AMBER", "RED", "REVIEW", "GREEN")
TIERS = ("CRITICAL", "HIGH", "ELEVATED", "NORMAL")


def _n(condition: Column) -> Column:
    return F.sum(F.coalesce(condition, F.lit(False)).cast("int")).cast("bigint")


def place(value: Column, order: tuple[str, ...]) -> Column:
    """Position of a value in an order; values outside it come last."""
    return reduce(lambda out, x: out.when(value == x[1], x[0]), enumerate(order[1:], 1), F.when(value == order[0], 0)).otherwise(len(order))


def author_memory(rows: DataFrame, confirmed: DataFrame, features: list[str]) -> DataFrame:
    """One profile per author over all recorded batches: totals, verdicts, occupations, batches, mean features, tier.

    The profile is an aggregate of the recorded rows, so recording a batch twice under its name changes nothing.
    Missing and NaN features count as zero, and ties of their means are rounded up; null and blank authors have no profile; a null verdict counts as none.
    """
    named = rows.withColumn("attempter", cohort.clean(F.col("attempter"))).where("attempter is not null")
    filled = lambda f: F.coalesce(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), F.lit(0.0))
    per = named.groupBy("attempter").agg(
        F.count(F.lit(1)).alias("total"),
        *[_n(F.col("determination") == k).alias(f"n_{k.lower()}") for k in KINDS],
        # Occupations and batches of one author: as many as there are kinds of work and runs, not rows.
        F.array_join(F.array_sort(F.collect_set(cohort.clean(F.col("occupation")))), "; ").alias("occupations"),
        F.countDistinct("batch_id").alias("batches"),
        F.min("recorded_at").alias("first_seen"),
        F.max("recorded_at").alias("last_seen"),
        *[F.round(F.avg(filled(f)) + F.lit(1e-9), 3).alias(f"mean_{f}") for f in features],
    )
    truth = confirmed.withColumn("attempter", cohort.clean(F.col("attempter"))).where("attempter is not null").groupBy("attempter").agg(
        _n(F.col("ground_truth") == "ai").alias("confirmed_ai"), _n(F.col("ground_truth") == "human").alias("confirmed_human")
    )
    rate = F.round((F.col("n_red") + F.col("n_amber") + F.col("n_mixed")) / F.col("total"), 3)
    out = per.join(truth, "attempter", "left").na.fill(0, ["confirmed_ai", "confirmed_human"]).withColumn("flag_rate", rate)
    return out.withColumn("risk_tier", cohort.risk_tier(F.col("confirmed_ai"), F.col("flag_rate")))


def primary_channels(rows: DataFrame, author: str = "attempter", channels: str = "channels", order: str = "row_idx") -> DataFrame:
    """(author, channel, n): the channel most often at AMBER or RED among an author's flagged rows; ties go to the first met."""
    hot = rows.where(cohort.is_flagged(F.col("determination"))).select(F.col(author).alias(author), F.col(order).alias("at"), F.posexplode(channels).alias("nth", "c")).where("c.level >= 2")
    counts = hot.groupBy(author, F.col("c.channel").alias("channel")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "nth")).alias("first"))
    return counts.groupBy(author).agg(F.min_by(F.struct("channel", "n"), F.struct((-F.col("n")).alias("less"), "first")).alias("b")).select(author, "b.channel", "b.n")


def channel_counts(rows: DataFrame, channels: str = "channels") -> DataFrame:
    """(channel, severity, n) of every channel that is not GREEN."""
    return rows.select(F.explode(channels).alias("c")).where("c.level > 0").groupBy("c.channel", "c.severity").agg(F.count(F.lit(1)).alias("n"))


def leading_channels(rows: DataFrame, key: str, channels: str = "channels", examples: int = 3) -> DataFrame:
    """(channel, n, pct, first rows): the strongest channel of each flagged row, the first of equals."""
    lead = F.array_max(F.transform(F.filter(F.col(channels), lambda c: c["level"] > 0), lambda c, i: F.struct(c["level"].alias("l"), (-i).alias("i"), c["channel"].alias("channel"))))["channel"]
    led = rows.where(cohort.is_flagged(F.col("determination"))).select(F.col(key).alias("k"), F.coalesce(lead, F.lit("unknown")).alias("channel"))
    # The least keys are merged a few at a time, so no list grows with the group.
    firsts = lambda c: F.slice(F.array_sort(F.collect_list(c)), 1, examples)
    from pyspark.sql import Window

    ranked = led.withColumn("nth", F.row_number().over(Window.partitionBy("channel").orderBy("k"))).where(F.col("nth") <= examples)
    first = ranked.groupBy("channel").agg(firsts("k").alias("ks"))
    counts = led.groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", F.round(100 * F.col("n") / total, 2)).join(first, "channel").select("channel", "n", "pct", F.array_join(F.col("ks").cast("array<string>"), " ").alias("first_rows"))


def calibration_error(labelled: DataFrame, score: str = "confidence", bins: int = 10) -> DataFrame:
    """One row: labelled rows, bins in use, and the unweighted mean gap of the bins."""
    table = cohort.reliability(labelled, score, bins)
    return table.agg(F.sum("n").cast("bigint").alias("labelled"), F.count(F.lit(1)).alias("bins"), F.round(F.avg("gap"), 4).alias("calibration_error"))


def verdicts_by_truth(labelled: DataFrame) -> DataFrame:
    """(determination, ai, human) counts."""
    t = F.col("ground_truth")
    return labelled.where(t.isin("ai", "human")).groupBy("determination").agg(_n(t == "ai").alias("ai"), _n(t == "human").alias("human"))


def stratum_errors(labelled: DataFrame) -> DataFrame:
    """False positive and negative rates of each stratum; only GREEN and YELLOW verdicts are missed machine texts."""
    d, t = F.col("determination"), F.col("ground_truth")
    rows = labelled.where(t.isin("ai", "human")).select(F.concat_ws("_", cohort.stratum("task_domain"), cohort.stratum("length_bin")).alias("stratum"), "determination", "ground_truth")
    counts = rows.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), _n(t == "human").alias("human"), _n((t == "human") & d.isin(*cohort.FLAGGED)).alias("false_positives"), _n(t == "ai").alias("ai"), _n((t == "ai") & d.isin("GREEN", "YELLOW")).alias("false_negatives")
    )
    ratio = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 4)
    return counts.withColumn("fpr", ratio("false_positives", "human")).withColumn("fnr", ratio("false_negatives", "ai"))


def labelling_queue(rows: DataFrame, key: str, most: int = 100) -> DataFrame:
    """The rows most worth a human label: by kind of verdict, surest first; ``most`` is the length of the queue."""
    ranked = rows.withColumn("rank", place(F.col("determination"), LABELLING_ORDER))
    return ranked.orderBy("rank", F.col("confidence").desc_nulls_last(), key).limit(most).select(key, "determination", "confidence", "rank")


def capped_rates(labelled: DataFrame, by: str) -> DataFrame:
    """(by, n, flagged, fpr, capped) over human rows; capped are verdicts at the ceiling that the language gate sets."""
    d, level = F.col("determination"), F.col("lang_support_level")
    capped = ((level == "UNSUPPORTED") & (d == "YELLOW")) | ((level == "REVIEW") & (d == "AMBER"))
    counts = labelled.where("ground_truth = 'human'").groupBy(by).agg(F.count(F.lit(1)).alias("n"), _n(d.isin(*cohort.FLAGGED)).alias("flagged"), _n(capped).alias("capped"))
    return counts.withColumn("fpr", F.round(F.col("flagged") / F.col("n"), 4))


def known_vocabulary(found: DataFrame, token: str, known: dict[str, list[str]]) -> DataFrame:
    """Adds a mark for each list of known words; the lists are fixed tables."""
    return found.select("*", *[F.lower(token).isin(ws).alias(name) for name, ws in known.items()])


def history(relations: dict[str, DataFrame], author: str, keys: dict[str, str]) -> DataFrame:
    """(relation, key) of everything recorded under an author's name, trimmed, in any of the relations."""
    parts = [df.where(F.trim("attempter") == author.strip()).select(F.lit(name).alias("relation"), F.col(keys[name]).cast("bigint").alias("key")) for name, df in relations.items()]
    return reduce(DataFrame.unionByName, parts)


def overview(rows: DataFrame, order: str) -> DataFrame:
    """One row: number of rows, most frequent verdict (the first met of equals), mean confidence."""
    kinds = rows.groupBy("determination").agg(F.count(F.lit(1)).alias("k"), F.min(order).alias("first"))
    mode = kinds.where("determination is not null").agg(F.min_by("determination", F.struct((-F.col("k")).alias("less"), "first")).alias("mode"))
    valid = F.when(~F.isnan("confidence"), F.col("confidence"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(valid), 4).alias("mean_confidence")).join(mode, F.lit(True))  # two one-row tables


def similarity_band(score: Column) -> Column:
    return F.when(score >= 0.70, "RED").when(score >= 0.50, "AMBER").otherwise("YELLOW")


def pair_labels(pairs: DataFrame, key: str, score: str) -> DataFrame:
    """(key, partners, label): each row's partners with their score, most alike first.

    A label is text for a reader; its length is the number of partners a row has.
    """
    a, b = f"{key}_a", f"{key}_b"
    ways = F.array(F.struct(F.col(a).alias("k"), F.col(b).alias("o"), F.col(score).alias("s")), F.struct(F.col(b).alias("k"), F.col(a).alias("o"), F.col(score).alias("s")))
    sides = pairs.select(F.explode(ways).alias("x")).select("x.*")
    listed = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("less"), "o")))
    label = F.array_join(F.transform(listed, lambda x: F.format_string("%d:%.2f", x["o"], -x["less"])), " ")
    return sides.groupBy(F.col("k").alias(key)).agg(F.count(F.lit(1)).alias("partners"), label.alias("label"))
