"""Trained operators: the shadow classifier, the fusion classifier and centroid clusters, on MLlib."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.session import materialize

LEAST_LABELS, LEAST_PER_CLASS = 200, 30


def labelled_features(rows: DataFrame, features: list[str], truth: str = "ground_truth") -> tuple[DataFrame, int]:
    """(rows labelled ai or human with features filled by zero, the label and a balancing weight; their number).

    The features are written once, since every pass of a training reads them.
    """
    kept = rows.where(F.col(truth).isin("ai", "human"))
    clean = [F.when(F.col(f).isNull() | F.isnan(F.col(f).cast("double")), 0.0).otherwise(F.col(f).cast("double")).alias(f) for f in features]
    out = materialize(kept.select(*clean, (F.col(truth) == "ai").cast("double").alias("label")), "labelled")
    sizes = {r["label"]: r["n"] for r in out.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    if total < LEAST_LABELS or min(sizes.get(0.0, 0), sizes.get(1.0, 0)) < LEAST_PER_CLASS:
        raise ValueError(f"needs {LEAST_LABELS} labels and {LEAST_PER_CLASS} of each class, has {sizes}")
    return out.withColumn("weight", F.when(F.col("label") == 1, total / (2 * sizes[1.0])).otherwise(total / (2 * sizes[0.0]))), total


def shadow_model(data: DataFrame, features: list[str], labels: int) -> PipelineModel:
    """Sparse logistic regression on standardised features of ``labels`` rows."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
            LogisticRegression(elasticNetParam=1.0, regParam=1.0 / labels, weightCol="weight", maxIter=200),
        ]
    ).fit(data)


def fusion_model(data: DataFrame, features: list[str], algorithm: str = "gbt") -> PipelineModel:
    if algorithm == "gbt":
        tree = GBTClassifier(maxIter=200, maxDepth=4, stepSize=0.1, subsamplingRate=0.8, seed=42)
    else:
        tree = RandomForestClassifier(numTrees=200, maxDepth=8, weightCol="weight", seed=42)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), tree]).fit(data)


def cross_validated_auc(data: DataFrame, features: list[str], folds: int = 5) -> float:
    lr = LogisticRegression(elasticNetParam=1.0, regParam=1.0 / data.count(), weightCol="weight", maxIter=100)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), lr])
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=ParamGridBuilder().build(), evaluator=BinaryClassificationEvaluator(), numFolds=folds, seed=42)
    return cv.fit(data).avgMetrics[0]


def importances(model: PipelineModel, features: list[str], top: int = 15) -> list[tuple[str, float]]:
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist()), key=lambda x: -x[1])[:top]


def probability(scored: DataFrame) -> Column:
    return F.get(vector_to_array(scored["probability"]), F.lit(1))


def ml_determination(p: Column) -> Column:
    return F.when(p >= 0.85, "RED").when(p >= 0.65, "AMBER").when(p >= 0.40, "YELLOW").when(p >= 0.15, "REVIEW").otherwise("GREEN")


def fused(rows: DataFrame, model: PipelineModel | None, features: list[str], verdict: str = "verdict") -> DataFrame:
    """Scored rows whose verdict comes from a trained model; without one, or without its features, the rules stand.

    Null and NaN features count as zero. Confidence is the probability of machine text, and the rule is ``ml_fusion``.
    """
    if model is None or any(f not in rows.columns for f in features):
        return rows
    filled = {f: F.coalesce(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), F.lit(0.0)) for f in features}
    kept = rows.withColumns({f"_kept_{f}": F.col(f) for f in features}).withColumns(filled)
    scored = model.transform(kept)
    p = F.round(probability(scored), 4)
    said = F.struct(ml_determination(p).alias("determination"), p.alias("confidence"), F.lit("ml_fusion").alias("triggering_rule"), F.format_string("P(AI)=%.2f", p).alias("reason"))
    out = scored.withColumn(verdict, F.col(verdict).withField("determination", said["determination"]).withField("confidence", said["confidence"]).withField("triggering_rule", said["triggering_rule"]).withField("reason", said["reason"]))
    return out.select(*[F.col(f"_kept_{c}").alias(c) if c in features else F.col(c) for c in rows.columns])


def shadow_disagreement(determination: Column, p: Column) -> Column:
    """Which of the rules and the model flags alone; the model flags above 0.80, and a null verdict is none."""
    flagged, likely = F.coalesce(determination.isin("RED", "AMBER", "MIXED"), F.lit(False)), p > 0.80
    return F.when(flagged & ~likely, "rule_flags_model_passes").when(~flagged & likely, "model_flags_rule_passes")


def cluster_centroids(vectors: DataFrame, vector: str, k: int) -> list[list[float]]:
    """k centroids of an array column; their number does not grow with the data."""
    model = KMeans(k=k, seed=42, featuresCol="v").fit(vectors.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v")))
    return [c.tolist() for c in model.clusterCenters()]
