"""Training, saving, loading and applying the risk classifier."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.risk import probability
from ..operators.motion import key_split
from ..operators.quality import QualityError, require_columns

INPUTS = ["delta_t", "movement_score"]


def assembled(df: DataFrame, invalid: str = "error", inputs: list[str] = INPUTS) -> DataFrame:
    """A vector column `features`; invalid: error, keep (NaN) or skip."""
    return VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid=invalid).transform(df)


def split(df: DataFrame, key: Column | None = None, seed: int = 42, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """80/20. With a key, by integer arithmetic on it, the same at every run; without, at random over ordered rows."""
    if key is not None:
        marked = key_split(df, key)
        return marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")
    train, test = (df.orderBy(*order) if order else df).randomSplit([0.8, 0.2], seed)
    return train, test


def train(features: DataFrame, key: Column | None = None, label: str = "risk_label", max_iter: int = 20) -> tuple[LogisticRegressionModel, float]:
    """The model and its area under ROC on the held-out fifth. QualityError if only one class is there."""
    require_columns(features, [*INPUTS, label])
    rows = assembled(features.select(*INPUTS, F.col(label).cast("double").alias("label"), *(["second"] if "second" in features.columns else [])))
    if rows.agg(F.count_distinct("label")).first()[0] < 2:
        raise QualityError("only one class in the labels")
    fit, held = split(rows, key, order=[*INPUTS, "label"])
    model = LogisticRegression(maxIter=max_iter).fit(fit)
    auc = BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(model.transform(held))
    return model, auc


def auc(df: DataFrame, score: str, label: str) -> float:
    """The exact area under ROC of a score, ties counted half."""
    rows = df.select(F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("l"))
    return BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="l", metricName="areaUnderROC", numBins=0).evaluate(rows)


def save(model: LogisticRegressionModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> LogisticRegressionModel | PipelineModel:
    """A saved pipeline, or a bare model."""
    try:
        return PipelineModel.load(path)
    except Exception:  # the metadata names another class
        return LogisticRegressionModel.load(path)


def score(features: DataFrame, model) -> DataFrame:
    """predicted_risk and risk_probability by the model's own transform."""
    require_columns(features, INPUTS)
    out = model.transform(assembled(features, "keep"))
    return out.withColumn("risk_probability", vector_to_array("probability").getItem(1)).withColumn(
        "predicted_risk", F.col("prediction").cast("int")
    ).drop("features", "rawPrediction", "probability", "prediction")


def score_native(features: DataFrame, weights, intercept: float) -> DataFrame:
    """The same as a plain expression: nothing leaves code generation."""
    p = probability([F.col(c) for c in INPUTS], weights, intercept)
    return features.withColumn("risk_probability", p).withColumn("predicted_risk", (F.col("risk_probability") > 0.5).cast("int"))


def weights_of(model) -> tuple[list[float], float]:
    m = model.stages[-1] if hasattr(model, "stages") else model
    return list(m.coefficients), float(m.intercept)
