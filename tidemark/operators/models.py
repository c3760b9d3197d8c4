"""Pattern heads and channel classifiers on MLlib, and batch scoring with a caller's model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.ml.regression import AFTSurvivalRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .evaluation import binary


def balanced(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    """Add the weight n / (2 * count) of the row's class."""
    counts = {r[target]: r["count"] for r in df.groupBy(target).count().collect()}
    n = sum(counts.values())
    weight = F.lit(0.0)
    for k, c in counts.items():
        weight = F.when(F.col(target) == k, F.lit(n / (2 * c))).otherwise(weight)
    return df.withColumn(name, weight)


def fit_binary(df: DataFrame, features: list[str], target: str, trees: bool = False, iterations: int = 100) -> PipelineModel:
    """A class-balanced logistic model (L2, one unit per total weight) or boosted trees."""
    weighted = balanced(df.dropna(subset=[*features, target]), target)
    total = weighted.agg(F.sum("weight")).first()[0] or 1.0
    if trees:
        model = GBTClassifier(labelCol=target, weightCol="weight", maxDepth=3, maxIter=30, seed=42)
    else:
        model = LogisticRegression(labelCol=target, weightCol="weight", maxIter=iterations, regParam=1 / total, standardization=False)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), model]).fit(weighted)


def probability(model: PipelineModel, df: DataFrame, features: list[str], name: str) -> DataFrame:
    """Add the probability of class 1 as ``name``; rows with a null feature are left out."""
    out = model.transform(df.dropna(subset=features))
    return out.withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fit_heads(windows: DataFrame, features: list[str], classes: list[str], label: str = "label") -> dict[str, PipelineModel]:
    """One model per pattern against all others; patterns without both classes get none."""
    windows = windows.cache()
    seen = {r[label]: r["count"] for r in windows.groupBy(label).count().collect()}
    n = sum(seen.values())
    heads = {c: fit_binary(windows.withColumn("_y", (F.col(label) == c).cast("int")), features, "_y") for c in classes if 0 < seen.get(c, 0) < n}
    windows.unpersist()
    return heads


def score_heads(windows: DataFrame, heads: dict[str, PipelineModel], features: list[str], up: str = "ascending_channel", down: str = "descending_channel") -> DataFrame:
    """Add p_<pattern> to four places, pred (up if its probability is higher, else down) and confidence."""
    for name, model in heads.items():
        windows = probability(model, windows, features, f"p_{name}")
        windows = windows.withColumn(f"p_{name}", F.round(f"p_{name}", 4))
    a, b = (F.col(f"p_{c}") if c in heads else F.lit(0.0) for c in (up, down))
    return windows.withColumns({"pred": F.when(a > b, up).otherwise(down), "confidence": F.greatest(a, b)})


def save_heads(heads: dict[str, PipelineModel], path: str) -> None:
    for name, model in heads.items():
        model.write().overwrite().save(f"{path}/{name}")


def load_heads(path: str, names: list[str]) -> dict[str, PipelineModel]:
    return {n: PipelineModel.load(f"{path}/{n}") for n in names}


def with_levels(df: DataFrame, price: str = "price", predictions: tuple[str, ...] = ("pred_return", "pred_support", "pred_resistance")) -> DataFrame:
    """Add price * (1 + prediction) of each, named ``<prediction>_price``."""
    return df.withColumns({f"{p}_price": F.col(price) * (1 + F.col(p)) for p in predictions})


def batch_score(windows: DataFrame, load: Callable[[], Callable], classes: list[str], prices: str = "prices", lookback: int = 32, batch_size: int = 256) -> DataFrame:
    """Add prob_<class>, predicted_pattern, pred_return, pred_support, pred_resistance and price levels.

    ``load`` runs once per Python worker and returns a function from a matrix of windows to one of
    len(classes) probabilities and three regressions a row.
    """

    def ready() -> Callable:
        model = load()
        return lambda x: np.asarray(model(x), dtype=np.float64)

    predict = predict_batch_udf(ready, return_type=ArrayType(DoubleType()), batch_size=batch_size, input_tensor_shapes=[[lookback]])
    out = windows.withColumn("_p", predict(prices))
    out = out.withColumns({f"prob_{c}": F.get("_p", k) for k, c in enumerate(classes)})
    top = F.greatest(*[F.col(f"prob_{c}") for c in classes])
    name: Column = F.coalesce(*[F.when(F.col(f"prob_{c}") == top, F.lit(c)) for c in classes])
    out = out.withColumn("predicted_pattern", name)
    out = out.withColumns({n: F.get("_p", len(classes) + k) for k, n in enumerate(("pred_return", "pred_support", "pred_resistance"))})
    return with_levels(out.drop("_p"))


def formation_report(train: DataFrame, test: DataFrame, features: list[str], target: str, least: int = 30) -> DataFrame:
    """(model, metrics) of logistic and boosted models beside the base rate; empty below ``least`` rows or with one class."""
    counts = {r[target]: r["count"] for r in train.groupBy(target).count().collect()}
    schema = "model string, n bigint, base_rate double, accuracy double, precision double, recall double, f1 double, auc double"
    if sum(counts.values()) < least or len(counts) < 2:
        return train.sparkSession.createDataFrame([], schema)
    out = None
    for name, trees in (("logistic", False), ("boosted", True)):
        scored = probability(fit_binary(train, features, target, trees), test, features, "_p")
        part = binary(scored, [], target, "_p").withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("model", "n", "base_rate", "accuracy", "precision", "recall", "f1", "auc")


def fit_aft(df: DataFrame, features: list[str], duration: str = "duration", event: str = "event") -> PipelineModel:
    """A Weibull accelerated-failure-time model; lives under 0.5 count as 0.5."""
    ready = df.select(*features, F.greatest(F.col(duration).cast("double"), F.lit(0.5)).alias("label"), F.col(event).cast("double").alias("censor"))
    aft = AFTSurvivalRegression(censorCol="censor", quantileProbabilities=[0.5], quantilesCol="quantiles")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), aft]).fit(ready)


def aft_survival(model: PipelineModel, df: DataFrame, features: list[str], horizons: list[float]) -> DataFrame:
    """Rows for each horizon with their survival there and ``risk``, the negated life expected."""
    scale = model.stages[-1].scale
    out = model.transform(df).withColumn("risk", -F.col("prediction")).withColumn("horizon", F.explode(F.array(*[F.lit(float(h)) for h in horizons])))
    return out.withColumn("survival", F.exp(-F.pow(F.col("horizon") / F.greatest(F.col("prediction"), F.lit(1e-3)), F.lit(1 / scale)))).drop("features", "prediction", "quantiles")
