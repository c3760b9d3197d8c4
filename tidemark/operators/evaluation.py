"""Classification, binary and regression metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, classes: list[str], truth: str = "truth", predicted: str = "predicted", keys: list[str] = ()) -> DataFrame:
    """(keys, truth, predicted, n) over the full grid; rows of other labels are ignored."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(t, p) for t in classes for p in classes], "truth string, predicted string")
    counts = df.where(F.col(truth).isin(classes) & F.col(predicted).isin(classes)).groupBy(*keys, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    if keys:
        grid = df.select(*keys).distinct().join(F.broadcast(grid))
    return grid.join(counts, [*keys, "truth", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def confusion_sheet(matrix: DataFrame, classes: list[str], keys: list[str] = ()) -> DataFrame:
    """A confusion matrix as people read it: a row for each true class, a column for each predicted one, and the row's total."""
    cell = lambda c: F.coalesce(F.sum(F.when(F.col("predicted") == c, F.col("n"))), F.lit(0)).alias(c)
    return matrix.groupBy(*keys, "truth").agg(*map(cell, classes), F.sum("n").alias("total"))


def per_class(matrix: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, label, support, precision, recall, f1) from a confusion matrix; 0 on empty."""
    true = matrix.groupBy(*keys, F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits"))
    called = matrix.groupBy(*keys, F.col("predicted").alias("label")).agg(F.sum("n").alias("called"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = true.join(called, [*keys, "label"])
    out = out.withColumns({"precision": zero(F.try_divide("hits", "called")), "recall": zero(F.try_divide("hits", "support"))})
    return out.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))).select(*keys, "label", "support", "precision", "recall", "f1")


def classification(matrix: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, n, accuracy, balanced_accuracy, macro_f1); the last two over classes with support."""
    with_support = F.col("support") > 0
    return (
        per_class(matrix, keys)
        .groupBy(*keys)
        .agg(
            F.sum("support").alias("n"),
            (F.sum(F.col("recall") * F.col("support")) / F.greatest(F.lit(1), F.sum("support"))).alias("accuracy"),
            F.coalesce(F.avg(F.when(with_support, F.col("recall"))), F.lit(0.0)).alias("balanced_accuracy"),
            F.coalesce(F.avg(F.when(with_support, F.col("f1"))), F.lit(0.0)).alias("macro_f1"),
        )
    )


def auc(df: DataFrame, keys: list[str], actual: str = "actual", score: str = "score", weight: str | None = None) -> DataFrame:
    """(keys, auc): area under the ROC curve by mean ranks; null with one class only.

    Rows are first added up by score, so the window runs over distinct scores.
    """
    w = F.col(weight) if weight else F.lit(1)
    by_score = df.groupBy(*keys, score).agg(F.sum(F.when(F.col(actual) == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col(actual) == 0, w).otherwise(0)).alias("neg"))
    under = F.coalesce(F.sum("neg").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = by_score.withColumn("wins", F.col("pos") * (under + F.col("neg") / 2))
    return ranked.groupBy(*keys).agg(F.try_divide(F.sum("wins"), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def binary(df: DataFrame, keys: list[str], actual: str = "actual", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """(keys, n, base_rate, accuracy, precision, recall, f1, auc) at a threshold; 0 on empty."""
    hit, yes = F.col(score) >= threshold, F.col(actual) == 1
    count = lambda c: F.sum(c.cast("int"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(yes.cast("double")).alias("base_rate"),
        F.avg((hit == yes).cast("double")).alias("accuracy"),
        zero(F.try_divide(count(hit & yes), count(hit))).alias("precision"),
        zero(F.try_divide(count(hit & yes), count(yes))).alias("recall"),
        zero(F.try_divide(2 * count(hit & yes), count(hit) + count(yes))).alias("f1"),
    )
    curve = auc(df, keys, actual, score)
    return out.join(curve, keys) if keys else out.join(F.broadcast(curve))


def regression(df: DataFrame, keys: list[str], pairs: list[tuple[str, str, str]]) -> DataFrame:
    """(keys, target, n, mae, rmse, directional_accuracy) for (name, predicted, true) columns; null pairs are left out."""
    items = F.array(*[F.struct(F.lit(n).alias("target"), F.col(p).cast("double").alias("p"), F.col(t).cast("double").alias("t")) for n, p, t in pairs])
    long = df.select(*keys, F.explode(items).alias("x")).select(*keys, "x.*").where("p is not null and t is not null")
    return long.groupBy(*keys, "target").agg(
        F.count("*").alias("n"),
        F.avg(F.abs(F.col("p") - F.col("t"))).alias("mae"),
        F.sqrt(F.avg(F.pow(F.col("p") - F.col("t"), 2))).alias("rmse"),
        F.avg((F.signum("p") == F.signum("t")).cast("double")).alias("directional_accuracy"),
    )


def class_weights(df: DataFrame, label: str, classes: list[str], scheme: str = "balanced") -> DataFrame:
    """(label, weight) of the present classes, mean 1: balanced n / (k * c), inverse 1 / c, sqrt_inverse or none."""
    counts = df.where(F.col(label).isin(classes)).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("c"))
    everything = Window.partitionBy()  # one row a class
    raw = {
        "balanced": F.sum("c").over(everything) / (len(classes) * F.col("c")),
        "inverse": 1 / F.col("c"),
        "sqrt_inverse": 1 / F.sqrt("c"),
        "none": F.lit(1.0),
    }[scheme]
    return counts.withColumn("w", raw).select("label", (F.col("w") / F.avg("w").over(everything)).alias("weight"))


def threshold_grid(df: DataFrame, keys: list[str], actual: str = "actual", score: str = "score", step: float = 0.025) -> DataFrame:
    """(keys, threshold, f1): the grid point of highest F1, the lowest among equals.

    Every row falls into one step of the grid; counts from a step upwards give each threshold's F1.
    """
    steps = round(1 / step)
    cell = F.least(F.greatest(F.floor(F.col(score) / F.lit(step) + F.lit(1e-9)), F.lit(0)), F.lit(steps)).cast("int")
    counts = df.groupBy(*keys, cell.alias("cell")).agg(F.count("*").alias("called"), F.sum((F.col(actual) == 1).cast("int")).alias("hits"))
    w = Window.partitionBy(*keys)
    up = w.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    grid = counts.withColumns({"pos": F.sum("hits").over(w), "c": F.sum("called").over(up), "h": F.sum("hits").over(up)})
    grid = grid.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("h"), F.col("c") + F.col("pos")), F.lit(0.0)))
    best = F.max_by(F.struct((F.col("cell") * F.lit(step)).alias("threshold"), "f1"), F.struct("f1", -F.col("cell")))
    return grid.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.threshold", "b.f1")
