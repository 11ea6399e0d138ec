"""Operators over ordered numbers and vectors: change points, surprisal windows, lagged and nearest cosines, rolling vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import text


def series(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, xs): each key's values in order. A key's series is one sequence by definition and is held as one array."""
    packed = F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_v"))))
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.transform(packed, lambda x: x["_v"]).alias("xs"))


def chunks(tokens: Column, size: int = 200) -> Column:
    """Successive runs of ``size`` tokens; the last may be shorter, no tokens give none."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size(w) / size).cast("int") - 1), lambda i: F.slice(w, i * size + 1, size))
        return F.when(F.size(w) > 0, runs).otherwise(F.array().cast("array<array<string>>"))

    return text.bound(tokens, of)


def changepoint(xs: Column, threshold: float = 3.0) -> Column:
    """Position of the largest cumulative deviation and its effect; null where there is none."""

    def of(x: Column) -> Column:
        n = F.size(x)
        m = text.mean(x)
        found = F.aggregate(
            x,
            F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("best"), F.lit(0).alias("at"), F.lit(0).alias("i")),
            lambda a, v: F.struct(
                (a["s"] + v - m).alias("s"),
                F.when((a["i"] + 1 < n) & (F.abs(a["s"] + v - m) > a["best"]), F.abs(a["s"] + v - m)).otherwise(a["best"]).alias("best"),
                F.when((a["i"] + 1 < n) & (F.abs(a["s"] + v - m) > a["best"]), a["i"] + 1).otherwise(a["at"]).alias("at"),
                (a["i"] + 1).alias("i"),
            ),
            lambda a: a["at"],
        )

        def judged(at: Column) -> Column:
            before, after = text.mean(F.slice(x, 1, at)), text.mean(F.slice(x, at + 1, n))
            effect = F.abs(after - before) / text.stdev(x)
            ok = (n >= 6) & (at >= 2) & (at <= n - 2) & (text.stdev(x) >= 1e-6)
            return F.when(ok & (effect >= threshold), F.struct(at.alias("changepoint"), F.round(effect, 3).alias("effect_size"), F.round(before, 4).alias("mean_before"), F.round(after, 4).alias("mean_after")))

        return text.bound(found, judged)

    return text.bound(xs, of)


def surprisal_windows(xs: Column, size: int = 64, stride: int = 32) -> Column:
    """Stationarity of windowed means and deviations of token losses."""

    def of(x: Column) -> Column:
        last = F.size(x) - size
        starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(x, i + 1, size))

    def summed(ws: Column) -> Column:
        means, devs = F.transform(ws, lambda w: text.mean(w)), F.transform(ws, lambda w: text.stdev(w))
        rel = lambda v: text.stdev(v) / F.greatest(text.mean(v), F.lit(1e-6))
        enough = F.size(ws) >= 3
        cv, vov = F.when(enough, rel(means)).otherwise(0.0), F.when(enough, rel(devs)).otherwise(0.0)
        still = F.when(enough, F.greatest(F.lit(0.0), 1 - cv) * F.greatest(F.lit(0.0), 1 - vov)).otherwise(0.0)
        return F.struct(F.size(ws).alias("windows"), F.round(cv, 4).alias("trajectory_cv"), F.round(vov, 4).alias("var_of_var"), F.round(still, 4).alias("stationarity"))

    return text.bound(text.bound(xs, of), summed)


def loss_profile(xs: Column) -> Column:
    """Perplexity, variance of surprisal and how it decays from the first to the second half."""

    def of(x: Column) -> Column:
        half = F.floor(F.size(x) / 2).cast("int")
        var = lambda v: F.pow(text.stdev(v, True), 2)
        first, second = var(F.slice(x, 1, half)), var(F.slice(x, half + 1, F.size(x)))
        return F.struct(
            F.round(F.exp(text.mean(x)), 4).alias("perplexity"), F.round(var(x), 4).alias("surprisal_variance"),
            F.round(F.when(second > 1e-6, first / second).otherwise(1.0), 4).alias("volatility_decay_ratio"),
        )

    return text.bound(xs, of)


def perplexity(xs: Column, comp_ratio: Column) -> Column:
    """Verdict of token losses: bands of perplexity, raised by even surprisal, its decay, and compressibility."""

    def of(r: Column) -> Column:
        x, n = r["x"], F.size(r["x"])
        half = F.floor(n / 2).cast("int")
        var = lambda v: F.pow(text.stdev(v, True), 2)
        whole = var(x)
        first = F.when(half > 1, var(F.slice(x, 1, half))).otherwise(whole)
        second = F.when(n - half > 1, var(F.slice(x, half + 1, n))).otherwise(whole)
        long = n >= 10
        return F.struct(
            F.exp(text.mean(x)).alias("ppl"), F.when(long, whole).otherwise(0.0).alias("var"), n.alias("n"), r["z"].alias("z"),
            F.when(long & (second > 1e-6), first / second).otherwise(F.when(long, 1.0).otherwise(0.0)).alias("decay"),
        )

    def banded(r: Column) -> Column:
        det = F.when(r["ppl"] <= 15, "AMBER").when(r["ppl"] <= 25, "YELLOW")
        conf = F.when(r["ppl"] <= 15, F.least(F.lit(0.65), (20 - r["ppl"]) / 20)).when(r["ppl"] <= 25, F.least(F.lit(0.35), (30 - r["ppl"]) / 30)).otherwise(0.0)
        even, fading = (r["var"] < 2.0) & (r["n"] >= 30), (r["decay"] > 1.5) & (r["n"] >= 40)
        return F.struct(*[r[c].alias(c) for c in ("ppl", "var", "n", "z", "decay")], det.alias("d"), conf.alias("c"), even.alias("even"), fading.alias("fading"))

    def raised(r: Column) -> Column:
        both, one, d, c = r["even"] & r["fading"], r["even"] | r["fading"], r["d"], r["c"]
        conf = (
            F.when(both & d.isNull(), F.least(F.lit(0.40), 0.20 + (2 - r["var"]) * 0.05 + (r["decay"] - 1) * 0.05)).when(both & (d == "YELLOW"), F.least(F.lit(0.65), c + 0.15))
            .when(both, F.least(F.lit(0.80), c + 0.10)).when(one & d.isNotNull(), F.least(c + 0.05, F.lit(0.70))).otherwise(c)
        )
        det = F.when(both & d.isNull(), "YELLOW").when(both & (d == "YELLOW"), "AMBER").otherwise(d)
        return F.struct(*[r[x].alias(x) for x in ("ppl", "var", "n", "z", "decay")], det.alias("d"), conf.alias("c"))

    def squeezed(r: Column) -> Column:
        z = r["ppl"] * r["z"]
        tight, d = (z < 8.0) & (r["n"] >= 30), r["d"]
        conf = F.when(tight & d.isNull(), F.least(F.lit(0.35), 0.15 + (8 - z) * 0.02)).when(tight, F.least(r["c"] + 0.05, F.lit(0.80))).otherwise(r["c"])
        return F.struct(
            F.round(r["ppl"], 2).alias("perplexity"), F.when(tight & d.isNull(), "YELLOW").otherwise(d).alias("determination"), F.round(conf, 4).alias("confidence"),
            F.round(r["var"], 4).alias("surprisal_variance"), F.round(r["decay"], 4).alias("volatility_decay_ratio"), F.round(z, 2).alias("zlib_normalized_ppl"),
            F.round(r["z"] / F.greatest(r["ppl"] / 100, F.lit(0.01)), 4).alias("comp_ppl_ratio"),
        )

    out = F.struct(xs.alias("x"), comp_ratio.alias("z"))
    for step in (of, banded, raised, squeezed):
        out = text.bound(out, step)
    return out


def burstiness(sentence_losses: Column) -> Column:
    """Sample variance of the mean losses of a text's sentences (arrays of losses); 0 below three sentences."""
    means = F.transform(F.filter(sentence_losses, lambda s: F.size(s) > 0), text.mean)
    return text.bound(means, lambda m: F.when(F.size(m) >= 3, F.round(F.pow(text.stdev(m), 2), 4)).otherwise(0.0))


def cohesiveness(distances: Column) -> Column:
    """Verdict of how far a text's vector moves when words are deleted; ``distances`` has one value per deletion round."""

    def of(x: Column) -> Column:
        mean, spread = F.when(F.size(x) > 0, text.mean(x)).otherwise(0.0), F.coalesce(text.stdev(x), F.lit(0.0))
        det = F.when((mean >= 0.020) & (spread < 0.010), "AMBER").when(mean >= 0.012, "YELLOW")
        conf = F.when(det == "AMBER", F.least(F.lit(0.60), 0.30 + mean * 10)).when(det == "YELLOW", F.least(F.lit(0.35), 0.15 + mean * 8)).otherwise(0.0)
        return F.struct(F.round(mean, 6).alias("cohesiveness"), F.round(spread, 6).alias("cohesiveness_std"), F.size(x).alias("n_rounds"), det.alias("determination"), F.round(conf, 4).alias("confidence"))

    return text.bound(distances, of)


def binoculars(perplexity: Column, observer: Column) -> Column:
    ratio = perplexity / F.greatest(observer, F.lit(1e-6))
    return F.struct(F.round(ratio, 4).alias("score"), F.when(ratio < 0.70, "AMBER").when(ratio < 0.85, "YELLOW").alias("determination"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm < 1e-12, 0.0).otherwise(dot(a, b) / norm)


def flow(rows: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """(key, n, flow_mean, flow_variance, determination): cosines of consecutive vectors."""
    before = Window.partitionBy(key).orderBy(order)
    pairs = rows.select(key, F.col(vector).alias("v"), F.lag(vector).over(before).alias("u")).where("u is not null").select(key, cosine(F.col("u"), F.col("v")).alias("c"))
    agg = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("m"), F.var_samp("c").alias("s"))
    det = F.when((F.col("s") < 0.008) & (F.col("m") > 0.40), "AMBER").when((F.col("s") < 0.015) & (F.col("m") > 0.35), "YELLOW")
    return agg.select(key, "n", F.round("m", 4).alias("flow_mean"), F.round("s", 6).alias("flow_variance"), det.alias("determination"))


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid): mean vectors; sums per dimension are aggregated before they are shuffled."""
    long = rows.select(label, F.posexplode(vector).alias("i", "x"))
    means = long.groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centroid"))


def resonance(rows: DataFrame, key: str, vector: str, sides: DataFrame, side: str) -> DataFrame:
    """(key, ai, human, delta, determination): greatest cosine to the centroids of either side.

    Centroids come as one small table (two sides times a few clusters), so they are sent to every task.
    """
    near = rows.select(key, vector).join(F.broadcast(sides), F.lit(True)).select(key, side, cosine(F.col(vector), F.col("centroid")).alias("c"))
    top = near.groupBy(key).agg(F.max(F.when(F.col(side) == "ai", F.col("c"))).alias("a"), F.max(F.when(F.col(side) == "human", F.col("c"))).alias("h"))
    delta = F.col("a") - F.col("h")
    det = F.when((F.col("a") >= 0.65) & (delta >= 0.15), "AMBER").when((F.col("a") >= 0.50) & (delta >= 0.08), "YELLOW")
    return top.select(key, F.round("a", 4).alias("ai_score"), F.round("h", 4).alias("human_score"), F.round(delta, 4).alias("delta"), det.alias("determination"))


def mattr(rows: DataFrame, key: str, tokens: Column, window: int = 50) -> DataFrame:
    """(key, mattr): mean share of distinct words over all windows.

    A word is new in a window if its previous place lies before the window; so each occurrence counts for
    as many windows as lie between its previous place and itself, and no window is ever materialised.
    """
    words = rows.select(key, F.size(tokens).alias("n"), F.posexplode(tokens).alias("i", "w"))
    before = F.coalesce(F.lag("i").over(Window.partitionBy(key, "w").orderBy("i")), F.lit(-1))
    placed = words.withColumn("p", before)
    first = F.greatest(F.col("p") + 1, F.col("i") - (window - 1), F.lit(0))
    last = F.least(F.col("i"), F.col("n") - window)
    new = F.greatest(last - first + 1, F.lit(0))
    short = F.when(F.col("p") < 0, 1).otherwise(0)
    sums = placed.groupBy(key, "n").agg(F.sum(new).alias("new"), F.sum(short).alias("distinct"))
    value = F.when(F.col("n") < window, F.col("distinct") / F.col("n")).otherwise(F.col("new") / ((F.col("n") - window + 1) * window))
    return sums.select(key, F.round(value, 6).alias("mattr"))
