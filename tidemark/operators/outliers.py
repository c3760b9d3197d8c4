"""Outlier control of predictions: templates, entropy, spikes and a decayed vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import entropy

from .features import Rolling


def decay_weights(rows: int = 10, cumulative: float = 0.99, newest_first: bool = False) -> list[float]:
    """Weights that add up to 1 and shrink by a constant ratio, so that all but 1 - ``cumulative`` is in ``rows``.

    The first weight, the largest, belongs to the oldest row unless ``newest_first``.
    """
    if rows <= 0:
        raise ValueError("rows must be positive")
    ratio = (1 - min(max(cumulative, 1e-6), 1 - 1e-6)) ** (1 / rows)
    steps = [(1 - ratio) * ratio**i for i in range(rows)]
    total = sum(steps)
    out = [s / total for s in steps]
    return out[::-1] if newest_first else out


def weigh(values: Column, weights: Column) -> Column:
    return F.zip_with(values, weights, lambda v, w: v * w)


def weighted_vote(df: DataFrame, keys: list[str], label: str, weight: str) -> DataFrame:
    """(keys, label, vote): the weight of each label."""
    return df.groupBy(*keys, label).agg(F.sum(weight).alias("vote"))


def fit_templates(windows: DataFrame, metrics: list[str], label: str = "label") -> DataFrame:
    """(label, metric, mean, std): population deviation, 1 where it vanishes."""
    long = windows.select(F.col(label).alias("label"), F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "v"))
    std = F.stddev_pop("v")
    return long.groupBy("label", "metric").agg(F.avg("v").alias("mean"), F.when(std <= 1e-8, 1.0).otherwise(std).alias("std"))


def template_distance(rows: DataFrame, templates: DataFrame, metrics: list[str], label: str = "predicted_pattern") -> DataFrame:
    """Add ``metric_distance``: the root mean square of the metrics' z-scores under the row's class, 0 without one.

    The templates are a few numbers for each of a fixed list of classes, so they are broadcast.
    """
    wide = templates.groupBy(F.col("label").alias("_label")).pivot("metric", metrics).agg(F.first(F.struct("mean", "std")))
    wide = wide.withColumnsRenamed({m: f"_t_{m}" for m in metrics})
    squares = [F.pow((F.col(m) - F.col(f"_t_{m}.mean")) / (F.col(f"_t_{m}.std") + 1e-8), 2) for m in metrics]
    total = squares[0]
    for s in squares[1:]:
        total = total + s
    joined = rows.join(F.broadcast(wide), F.col(label) == F.col("_label"), "left")
    return joined.withColumn("metric_distance", F.coalesce(F.sqrt(total / len(metrics)), F.lit(0.0))).select(*rows.columns, "metric_distance")


def with_entropy(rows: DataFrame, probabilities: list[str]) -> DataFrame:
    return rows.withColumn("pattern_entropy", entropy([F.col(p) for p in probabilities]))


def control(
    rows: DataFrame,
    keys: list[str],
    classes: list[str],
    order: str = "end",
    window: int = 10,
    cumulative: float = 0.99,
    spike_window: int = 20,
    score_threshold: float = 0.68,
    min_confidence: float = 0.55,
    distance_threshold: float = 2.5,
    newest_first: bool = False,
) -> DataFrame:
    """Add volatility_spike, dominant_pattern_window, its confidence, weighted_outlier_score and outlier_flag.

    ``rows`` have ``prob_`` columns of the classes, predicted_pattern, pattern_entropy,
    metric_distance and future_return or pred_return. Each row looks at up to ``window`` rows
    ending with it; their weights are the tail of the decay weights, made to add up to 1.
    """
    r = Rolling(keys, order)
    source = "future_return" if "future_return" in rows.columns else "pred_return"
    base, ratio = r.spike(F.col(source), spike_window)
    rows = rows.withColumn("_base", base).withColumn("volatility_spike", ratio(F.col("_base"))).drop("_base")
    item = F.struct(
        F.array(*[F.col(f"prob_{c}").cast("double") for c in classes]).alias("p"),
        (1 - F.exp(-F.col("metric_distance"))).alias("d"),
        F.col("pattern_entropy").alias("h"),
        F.tanh(F.greatest(F.col("volatility_spike") - 1, F.lit(0.0))).alias("s"),
        F.col("predicted_pattern").alias("c"),
    )
    weights = F.array(*[F.lit(w) for w in decay_weights(window, cumulative, newest_first)])
    df = rows.withColumn("_h", F.collect_list(item).over(r.frame(window)))
    tail = F.slice(weights, window + 1 - F.size("_h"), F.size("_h"))
    df = df.withColumn("_w", tail).withColumn("_w", F.transform("_w", lambda w: w / F.aggregate(F.col("_w"), F.lit(0.0), lambda a, x: a + x)))
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    vote = lambda k: add(F.zip_with("_h", "_w", lambda x, w: F.get(x.p, F.lit(k)) * w))
    votes = {f"_v{k}": vote(k) for k in range(len(classes))}
    df = df.withColumns(votes)
    top = F.greatest(*[F.col(v) for v in votes])
    dominant = F.coalesce(*[F.when(F.col(v) == top, F.lit(c)) for v, c in zip(votes, classes, strict=True)])
    df = df.withColumns({"dominant_confidence_window": top, "dominant_pattern_window": dominant})
    score = add(
        F.zip_with("_h", "_w", lambda x, w: w * (0.45 * x.d + 0.25 * x.h + 0.20 * x.s + 0.10 * F.when(x.c == F.col("dominant_pattern_window"), 0.0).otherwise(1.0)))
    )
    df = df.withColumn("weighted_outlier_score", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))
    flag = (F.col("weighted_outlier_score") >= score_threshold) | (F.col("dominant_confidence_window") < min_confidence) | (F.col("metric_distance") >= distance_threshold)
    return df.withColumn("outlier_flag", flag.cast("int")).drop("_h", "_w", *votes)
