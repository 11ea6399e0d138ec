"""Cohort analytics over scored rows: distributions, author risk, calibration, cut-offs, baselines, vocabulary.

Group sizes are never assumed small: order statistics work on values pre-aggregated by count, so a hot
group costs one row per distinct value, and ranks over groups work on histograms.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLAGGED = ("RED", "AMBER", "MIXED")


def is_flagged(determination: Column, kinds: tuple[str, ...] = FLAGGED) -> Column:
    return F.coalesce(determination.isin(*kinds), F.lit(False))


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(part / whole, digits)


def clean(column: Column) -> Column:
    """Trimmed text, null when blank."""
    flat = F.trim(column)
    return F.when(flat != "", flat)


def distribution(rows: DataFrame, by: str) -> DataFrame:
    """(value, n, pct): counts of each value and their share of all rows."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of the greatest ``order`` per key; partial aggregation instead of a sort per key."""
    rest = [c for c in rows.columns if c != key]
    packed = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(packed.alias("r")).select(key, "r.*")


def author_profiles(rows: DataFrame, least: int = 2) -> DataFrame:
    """Totals, verdict counts, flag rate, mean flagged confidence and occupations of each author."""
    flag = is_flagged(F.col("determination"))
    count = lambda c: F.sum(c.cast("int")).cast("bigint")
    kinds = [count(F.coalesce(F.col("determination") == k, F.lit(False))).alias(f"n_{k.lower()}") for k in ("RED", "AMBER", "MIXED", "YELLOW", "REVIEW", "GREEN")]
    named = rows.withColumn("attempter", clean(F.col("attempter"))).where("attempter is not null")
    grouped = named.groupBy("attempter").agg(
        F.count(F.lit(1)).alias("total"),
        *kinds,
        count(flag).alias("flagged"),
        F.round(F.avg(F.when(flag, F.col("confidence"))), 6).alias("mean_flagged_confidence"),
        F.countDistinct("occupation").alias("occupations"),
    )
    return grouped.where(F.col("total") >= least).withColumn("flag_rate", share(F.col("flagged"), F.col("total")))


def risk_tier(confirmed_ai: Column, flag_rate: Column) -> Column:
    return (
        F.when((confirmed_ai > 0) & (flag_rate > 0.5), "CRITICAL")
        .when((flag_rate > 0.3) | (confirmed_ai > 0), "HIGH")
        .when(flag_rate > 0.15, "ELEVATED")
        .otherwise("NORMAL")
    )


def risk_report(rows: DataFrame, confirmed: DataFrame) -> DataFrame:
    truth = (
        confirmed.withColumn("attempter", clean(F.col("attempter")))
        .where("attempter is not null")
        .groupBy("attempter")
        .agg(
            F.sum(F.when(F.col("ground_truth") == "ai", 1).otherwise(0)).alias("confirmed_ai"),
            F.sum(F.when(F.col("ground_truth") == "human", 1).otherwise(0)).alias("confirmed_human"),
        )
    )
    joined = author_profiles(rows).select("attempter", "total", "flagged", "flag_rate").join(truth, "attempter", "left").na.fill(0, ["confirmed_ai", "confirmed_human"])
    return joined.withColumn("risk_tier", risk_tier(F.col("confirmed_ai"), F.col("flag_rate")))


def concentration(rows: DataFrame, fraction: float = 0.1) -> DataFrame:
    """Share of all flags that the top ``fraction`` of authors hold; over a histogram of flag counts."""
    authors = rows.withColumn("attempter", clean(F.col("attempter"))).where("attempter is not null")
    per = authors.groupBy("attempter").agg(F.sum(is_flagged(F.col("determination")).cast("int")).alias("f"))
    bins = per.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    down, everything = Window.orderBy(F.col("f").desc()), Window.partitionBy()
    placed = bins.select(
        "f", "n", F.sum("n").over(down).alias("upto"), F.sum("n").over(everything).alias("authors"), F.sum(F.col("f") * F.col("n")).over(everything).alias("flags")
    ).withColumn("top", F.greatest(F.lit(1), F.floor(F.col("authors") * fraction)))
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.col("top") - (F.col("upto") - F.col("n"))))
    return placed.groupBy("authors", "top", "flags").agg(F.sum(taken * F.col("f")).alias("held")).select(
        "authors", F.col("top").cast("bigint").alias("top_authors"), F.col("flags").cast("bigint").alias("flags"),
        F.round(F.when(F.col("flags") > 0, F.col("held") / F.col("flags")).otherwise(0.0), 4).alias("held_share"),
    )


def nth_smallest(rows: DataFrame, group: list[str], value: str, positions: dict[str, Column]) -> DataFrame:
    """Order statistics per group by 1-based position, over values pre-aggregated by count.

    ``positions`` are columns over ``n``, the group's size.
    """
    counted = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("c"))
    part = Window.partitionBy(*group)
    upto = counted.select(*group, value, F.sum("c").over(part.orderBy(value)).alias("upto"), F.sum("c").over(part).alias("n"))
    at = [F.min(F.when(F.col("upto") >= p, F.col(value))).alias(name) for name, p in positions.items()]
    return upto.groupBy(*group, "n").agg(*at)


def stratum(column: str) -> Column:
    """A part of a stratum's name; null and empty ones are ``unknown``."""
    return F.when(F.coalesce(F.col(column), F.lit("")) == "", "unknown").otherwise(F.col(column))


def conformal_quantiles(labelled: DataFrame, score: str = "confidence") -> DataFrame:
    """Nonconformity quantiles of human rows, of each (domain, length bin) and of all (null, null).

    Nothing comes out unless there are 20 human rows in all; a stratum needs 10.
    """
    human = labelled.where("ground_truth = 'human'").select(stratum("task_domain").alias("task_domain"), stratum("length_bin").alias("length_bin"), (1 - F.col(score)).alias("nc")).where("nc is not null")
    everything = human.select(F.lit(None).cast("string").alias("task_domain"), F.lit(None).cast("string").alias("length_bin"), "nc", F.lit(True).alias("is_global"))
    both = human.withColumn("is_global", F.lit(False)).unionByName(everything)
    at = lambda a: F.least(F.greatest(F.ceil((1 - a) * (F.col("n") + 1) - F.lit(1e-9)), F.lit(1)), F.col("n"))
    table = nth_smallest(both, ["task_domain", "length_bin", "is_global"], "nc", {"q01": at(0.01), "q05": at(0.05), "q10": at(0.10)})
    total = table.where("is_global").select(F.col("n").alias("all_n"))  # one row
    return table.join(F.broadcast(total), F.lit(True)).where("all_n >= 20 and (is_global or n >= 10)").select("task_domain", "length_bin", "is_global", "n", "q01", "q05", "q10")


def conformal_table(labelled: DataFrame, score: str = "confidence") -> DataFrame:
    """The quantiles, rounded for reading."""
    return conformal_quantiles(labelled, score).select("task_domain", "length_bin", "is_global", "n", *[F.round(q, 6).alias(q) for q in ("q01", "q05", "q10")])


def calibrate(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Adds conformity level and calibrated confidence from the row's stratum, else from the global row."""
    t = table.where("not is_global").select(F.col("task_domain").alias("_domain"), F.col("length_bin").alias("_bin"), F.struct("q01", "q05", "q10").alias("own"))
    g = table.where("is_global").select(F.struct("q01", "q05", "q10").alias("any"))
    # The global row is one row; the strata number domains times length bins.
    domain, size = stratum("task_domain"), stratum("length_bin")
    joined = rows.join(F.broadcast(t), (domain == F.col("_domain")) & (size == F.col("_bin")), "left").join(F.broadcast(g), F.lit(True), "left")
    nc, q = 1 - F.col("confidence"), F.coalesce("own", "any")
    level = F.when(q.isNull(), None).when(nc <= q["q01"], 1.0).when(nc <= q["q05"], 0.10).when(nc <= q["q10"], 0.05).otherwise(0.01)
    calibrated = F.when(nc > q["q05"], F.least(F.col("confidence") * 1.15, F.lit(0.99))).when(nc < q["q10"], F.col("confidence") * 0.75).otherwise(F.col("confidence"))
    source = F.when(F.col("own").isNotNull(), F.concat_ws("_", domain, size)).when(F.col("any").isNotNull(), "global").otherwise("uncalibrated")
    return joined.select(*[rows[c] for c in rows.columns if c not in ("task_domain", "length_bin")], "task_domain", "length_bin", level.alias("conformity_level"), F.round(calibrated, 6).alias("calibrated"), source.alias("stratum"))


def percentiles(rows: DataFrame, by: str, metrics: list[str], least_rows: int = 5, least_values: int = 3) -> DataFrame:
    """(by, metric, n, p25..p99, mean, std) of groups of at least ``least_rows`` rows."""
    points = {"p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least_rows).select(by)
    long = rows.select(by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select(by, "x.metric", "x.v")
    stats = (
        long.where(F.col("v").isNotNull() & ~F.isnan("v"))
        .groupBy(by, "metric")
        .agg(F.count(F.lit(1)).alias("n"), F.percentile("v", list(points.values())).alias("p"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"))
        .where(F.col("n") >= least_values)
    )
    return stats.join(sizes, by, "left_semi").select(by, "metric", "n", *[F.round(F.get("p", F.lit(i)), 6).alias(k) for i, k in enumerate(points)], "mean", "std")


def tpr_at_fpr(labelled: DataFrame, score: str, limits: tuple[float, ...] = (0.01, 0.05, 0.10), least: int = 20) -> DataFrame:
    """(max_fpr, tpr, threshold): best true positive rate under each limit of the false positive rate."""
    cells = labelled.where("ground_truth in ('ai', 'human')").where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(score).agg(
        F.sum(F.when(F.col("ground_truth") == "ai", 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("ground_truth") == "human", 1).otherwise(0)).alias("neg")
    )
    down, everything = Window.orderBy(F.col(score).desc()), Window.partitionBy()
    curve = cells.select(
        F.col(score).alias("threshold"), (F.sum("pos").over(down) / F.sum("pos").over(everything)).alias("tpr"), (F.sum("neg").over(down) / F.sum("neg").over(everything)).alias("fpr"),
        (F.sum("pos").over(everything) + F.sum("neg").over(everything)).alias("n"),
    ).where(F.col("n") >= least)
    under = curve.select(F.explode(F.array(*[F.lit(x) for x in limits])).alias("max_fpr"), "threshold", "tpr", "fpr").where("fpr <= max_fpr")
    best = F.max_by(F.struct("tpr", "threshold"), F.struct("tpr", "threshold"))
    return under.groupBy("max_fpr").agg(best.alias("b")).select("max_fpr", F.round("b.tpr", 6).alias("tpr"), F.col("b.threshold").alias("threshold"))


def flag_rates(labelled: DataFrame, by: list[str], kinds: tuple[str, ...] = ("RED", "AMBER"), least: int = 1) -> DataFrame:
    flag = F.sum(is_flagged(F.col("determination"), kinds).cast("int"))
    return labelled.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), flag.cast("bigint").alias("flagged")).where(F.col("n") >= least).withColumn("flag_rate", share(F.col("flagged"), F.col("n")))


def disparity(rates: DataFrame, warn: float) -> DataFrame:
    return rates.agg(F.max("flag_rate").alias("highest"), F.min("flag_rate").alias("lowest"), F.count(F.lit(1)).alias("groups")).withColumn("gap", F.round(F.col("highest") - F.col("lowest"), 4)).withColumn(
        "warning", F.col("gap") > warn
    )


def reliability(labelled: DataFrame, score: str = "confidence", bins: int = 10) -> DataFrame:
    """(bin, n, mean_confidence, ai_rate, gap) of labelled rows; the mean gap is the calibration error."""
    rows = labelled.where("ground_truth in ('ai', 'human')").where(F.col(score).between(0, 1))
    cell = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    ai = F.when(F.col("ground_truth") == "ai", 1.0).otherwise(0.0)
    out = rows.groupBy(cell.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("c"), F.avg(ai).alias("a"))
    return out.select("bin", "n", F.round("c", 4).alias("mean_confidence"), F.round("a", 4).alias("ai_rate"), F.round(F.abs(F.col("c") - F.col("a")), 4).alias("gap"))


def confusion(labelled: DataFrame) -> DataFrame:
    rows = labelled.where("ground_truth in ('ai', 'human')")
    flag, ai = is_flagged(F.col("determination")), F.col("ground_truth") == "ai"
    n = lambda c: F.sum(c.cast("int")).cast("bigint")
    cells = rows.agg(n(flag & ai).alias("tp"), n(flag & ~ai).alias("fp"), n(~flag & ~ai).alias("tn"), n(~flag & ai).alias("fn"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 4)
    c = F.col
    return cells.select(
        "tp", "fp", "tn", "fn", ratio(c("tp"), c("tp") + c("fp")).alias("precision"), ratio(c("tp"), c("tp") + c("fn")).alias("recall"),
        ratio(c("tp") + c("tn"), c("tp") + c("fp") + c("tn") + c("fn")).alias("accuracy"), ratio(c("fp"), c("fp") + c("tn")).alias("fpr"),
    )


def log_odds(texts: DataFrame, text: Column, label: str, least: int = 10, threshold: float = 1.5, alpha: float = 0.05) -> DataFrame:
    """(token, n_ai, n_human, log_odds) of vocabulary that sets machine text apart, smoothed over the union vocabulary."""
    tokens = texts.where(F.col(label).isin("ai", "human")).select(label, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}_])([\p{L}]{3,})(?![\p{L}\p{N}_])"), F.lit(1))).alias("token"))
    n = lambda k: F.sum(F.when(F.col(label) == k, 1).otherwise(0))
    counts = tokens.groupBy("token").agg(n("ai").alias("n_ai"), n("human").alias("n_human"))
    totals = counts.agg(F.sum("n_ai").alias("all_ai"), F.sum("n_human").alias("all_human"), F.count(F.lit(1)).alias("v"))
    rate = lambda k: (F.col(f"n_{k}") + alpha) / (F.col(f"all_{k}") + alpha * F.col("v"))
    # The totals are one row.
    return (
        counts.join(F.broadcast(totals), F.lit(True))
        .where((F.col("n_ai") >= least) & (F.col("all_ai") >= 500) & (F.col("all_human") >= 500))
        .select("token", "n_ai", "n_human", F.round(F.log(rate("ai") / rate("human")), 4).alias("log_odds"))
        .where(F.col("log_odds") > threshold)
    )


def attack_type(homoglyphs: Column, invisible: Column, delta: Column | None = None) -> Column:
    a, b = F.coalesce(homoglyphs > 0, F.lit(False)), F.coalesce(invisible > 0, F.lit(False))
    out = F.when(a & b, "combined").when(a, "homoglyph").when(b, "zero_width")
    return (out.when(F.coalesce(delta >= 0.02, F.lit(False)), "encoding") if delta is not None else out).otherwise("none")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
