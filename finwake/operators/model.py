"""Time split, class weights, training and scoring: histogram trees of this library, or Spark ML's learners."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finwake.operators import boosting
from finwake.operators.boosting import BoostedTrees
from finwake.operators.features import FEATURES, PASSTHROUGH

MISSING = -1.0
NULLABLE = ["fx_ratio", "currency_mismatch", "is_cross_bank"] + [
    f"{s}_{n}"
    for s in "sr"
    for n in ("mean_amt_7d", "std_amt_7d", "max_amt_30d", "secs_since_prev", "secs_since_prev_cp", "amt_vs_hist")
]


def parts(cut: str) -> tuple[Column, Column]:
    """Whether a row lies before ``cut``, and whether at or after it; rows without a time are in neither part."""
    moment = F.lit(cut).cast("timestamp_ntz")
    return F.col("event_time") < moment, F.col("event_time") >= moment


def split(features: DataFrame, cut: str) -> tuple[DataFrame, DataFrame]:
    """Rows before ``cut`` and rows at or after it."""
    early, late = parts(cut)
    return features.filter(early), features.filter(late)


def class_weights(train: DataFrame) -> DataFrame:
    """Balanced weight n / (2 n_c) of each label."""
    counts = train.groupBy("is_laundering").agg(F.count("*").alias("n_c"))
    total = F.sum("n_c").over(Window.partitionBy())  # two rows
    return counts.select("is_laundering", "n_c", (total / (2.0 * F.col("n_c"))).alias("weight"))


def prepare(features: DataFrame) -> DataFrame:
    """Fill missing inputs with a value outside their range and flag them."""
    flags = [F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in NULLABLE]
    filled = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(MISSING)).alias(c) for c in FEATURES]
    keep = [c for c in PASSTHROUGH if c in features.columns]
    return features.select(*keep, *filled, *flags)


def fit(train: DataFrame, kind: str = "histogram", trees: int = 200, depth: int = 8, seed: int = 7) -> PipelineModel | BoostedTrees:
    """Boosted trees that take missing values as they are ("histogram"), Spark ML's ("gbt"), or a logistic baseline; on balanced classes."""
    if kind == "histogram":
        return boosting.fit(train, FEATURES, trees=trees, depth=depth)
    weights = class_weights(train)
    data = prepare(train).join(F.broadcast(weights), "is_laundering")  # one row per label value
    data = data.withColumn("label", F.col("is_laundering").cast("double"))
    assemble = VectorAssembler(inputCols=[*FEATURES, *[f"{c}_missing" for c in NULLABLE]], outputCol="raw")
    if kind == "gbt":
        learner = GBTClassifier(
            featuresCol="raw", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed
        )
        stages = [assemble, learner]
    else:
        scale = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True)
        stages = [assemble, scale, LogisticRegression(featuresCol="scaled", weightCol="weight", maxIter=100)]
    return Pipeline(stages=stages).fit(data)


def save(model: PipelineModel | BoostedTrees, path: str, spark: SparkSession) -> None:
    if isinstance(model, BoostedTrees):
        model.save(path, spark)
    else:
        model.write().overwrite().save(path)


def score(model: PipelineModel | BoostedTrees, features: DataFrame) -> DataFrame:
    """id columns and the probability of the positive class; rows keep their ids."""
    if isinstance(model, BoostedTrees):
        return model.score(features, *PASSTHROUGH)
    out = model.transform(prepare(features))
    return out.select(*PASSTHROUGH, vector_to_array("probability")[1].alias("score"))
