"""Sliding windows of series, their labels and shape metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.functions import patterns

from .calendar import complete_window, row_index
from .features import Rolling, future_targets


def sliding(df: DataFrame, keys: list[str], value: str = "value", lookback: int = 32, stride: int = 1, required: list[str] = (), ts: str = "ts", first_end: int | None = None) -> DataFrame:
    """One row per window: start and end (exclusive) positions, end_date, price, and the array ``prices``.

    Windows end at ``lookback``, ``lookback + stride`` and so on; those with a null in ``value`` or
    ``required`` on any row are left out.
    """
    r = Rolling(keys, ts)
    indexed = row_index(df, keys, ts)
    rows = indexed.withColumns(
        {"prices": F.collect_list(value).over(r.frame(lookback)), "_full": complete_window(keys, [value, *required], lookback, ts), "end": F.col("row_idx") + 1}
    )
    at = F.col("end") - (lookback if first_end is None else first_end)
    return rows.where(F.col("_full") & (at >= 0) & (at % stride == 0)).withColumns({"start": F.col("end") - lookback, "end_date": F.col(ts), "price": F.col(value)}).drop("_full", "row_idx")


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.list_(pa.float64()))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _struct(values: np.ndarray, names: list[str]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(values[:, k].astype(float)) for k in range(len(names))], names=names)


def _doubles(names: list[str]) -> StructType:
    return StructType([StructField(n, DoubleType()) for n in names])


LINE = ["slope", "intercept", "r2", "resid_std"]


@F.arrow_udf(_doubles(patterns.PATTERNS))
def pattern_scores(prices: pa.Array) -> pa.Array:
    """The eight pattern scores of windows of one length."""
    return _struct(patterns.scores(_matrix(prices)) if len(prices) else np.zeros((0, len(patterns.PATTERNS))), patterns.PATTERNS)


@F.arrow_udf(_doubles(patterns.METRICS))
def shape_metrics(prices: pa.Array) -> pa.Array:
    """The twelve shape metrics of windows of one length."""
    return _struct(patterns.metrics(_matrix(prices)) if len(prices) else np.zeros((0, len(patterns.METRICS))), patterns.METRICS)


@F.arrow_udf(_doubles(patterns.CHANNEL_FEATURES))
def channel_shape(prices: pa.Array, atr: pa.Array, ascending: pa.Array) -> pa.Array:
    """The eleven channel features of windows of one length."""
    if not len(prices):
        return _struct(np.zeros((0, len(patterns.CHANNEL_FEATURES))), patterns.CHANNEL_FEATURES)
    values = patterns.channel_features(_matrix(prices), atr.to_numpy(zero_copy_only=False), ascending.to_numpy(zero_copy_only=False))
    return _struct(values, patterns.CHANNEL_FEATURES)


@F.arrow_udf(_doubles(LINE))
def channel_line(prices: pa.Array) -> pa.Array:
    """The line through a window's smoothed prices."""
    values = np.stack(patterns.line(patterns.smooth(_matrix(prices))), axis=1) if len(prices) else np.zeros((0, 4))
    return _struct(values, LINE)


def best_label(scores: dict[str, Column], threshold: float) -> tuple[Column, Column]:
    """The highest score's name, earlier names first among equals, and the score; below the threshold unclassified."""
    top = F.greatest(*scores.values())
    name = F.coalesce(*[F.when(s == top, F.lit(p)) for p, s in scores.items()])
    return F.when(top >= threshold, name).otherwise(patterns.UNCLASSIFIED), top


def label(windows: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Add the eight ``score_`` columns, label, confidence and pattern_idx (-1: no class)."""
    scored = windows.withColumn("_s", pattern_scores("prices"))
    scored = scored.withColumns({f"score_{p}": F.col(f"_s.{p}") for p in patterns.PATTERNS}).drop("_s")
    name, top = best_label({p: F.col(f"score_{p}") for p in patterns.PATTERNS}, threshold)
    scored = scored.withColumns({"label": name, "confidence": top})
    return scored.withColumn("pattern_idx", class_index(F.col("label")))


def class_index(name: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, patterns.PATTERNS)), name) - 1, F.lit(-1)).cast("int")


def with_metrics(windows: DataFrame) -> DataFrame:
    shaped = windows.withColumn("_m", shape_metrics("prices"))
    return shaped.withColumns({m: F.col(f"_m.{m}") for m in patterns.METRICS}).drop("_m")


def training_windows(
    df: DataFrame,
    keys: list[str],
    value: str = "value",
    lookback: int = 32,
    horizon: int = 5,
    sr_horizon: int = 10,
    stride: int = 1,
    threshold: float = 0.35,
    keep_unclassified: bool = False,
    required: list[str] = (),
    target: str | None = None,
    target_is_log: bool = True,
    ts: str = "ts",
) -> DataFrame:
    """The window table: positions, label, scores, metrics and future targets of each labelled window.

    A window needs its required values, a price, ``max(horizon, sr_horizon)`` complete future rows
    and, if ``target`` names a column, its value on the last row, turned from a log return when
    ``target_is_log``. Unclassified windows are left out unless kept.
    """
    ahead = future_targets(df, keys, value, horizon, sr_horizon, ts)
    future = F.count(value).over(Rolling(keys, ts).w.rowsBetween(1, max(horizon, sr_horizon)))
    ahead = ahead.withColumn("_future", future)
    if target:
        ahead = ahead.withColumn("future_return", F.expm1(target) if target_is_log else F.col(target))
    out = sliding(ahead, keys, value, lookback, stride, required, ts).where((F.col("_future") == max(horizon, sr_horizon)) & F.col("future_return").isNotNull())
    out = label(out.drop("_future"), threshold)
    if not keep_unclassified:
        out = out.where(F.col("label") != patterns.UNCLASSIFIED)
    return with_metrics(out)


def inference_windows(df: DataFrame, keys: list[str], value: str = "value", lookback: int = 32, stride: int = 1, required: list[str] = (), ts: str = "ts") -> DataFrame:
    """Windows up to the last row, without labels or future."""
    return sliding(df, keys, value, lookback, stride, required, ts)


def tensor_windows(df: DataFrame, keys: list[str], features: list[str], target: str, lookback: int = 32, ts: str = "ts") -> DataFrame:
    """Windows of all ``features`` as an array of rows, complete and with a target on the last row."""
    r = Rolling(keys, ts)
    rows = df.withColumns(
        {"window": F.collect_list(F.array(*[F.col(f).cast("float") for f in features])).over(r.frame(lookback)), "_full": complete_window(keys, features, lookback, ts)}
    )
    return rows.where(F.col("_full") & F.col(target).isNotNull()).select(*keys, F.col(ts).alias("end_date"), "window", F.col(target).alias("target"))


def channel_windows(df: DataFrame, keys: list[str], value: str = "value", lookback: int = 32, threshold: float = 0.30, ts: str = "ts") -> DataFrame:
    """Every complete window with its channel flag and channel features; a window of another label counts as ascending."""
    r = Rolling(keys, ts)
    step, average = r.average_range(F.col(value))
    ranged = df.withColumn("_step", step).withColumn("atr", average(F.col("_step"))).drop("_step")
    out = label(sliding(ranged, keys, value, lookback, ts=ts), threshold)
    flag = F.col("label").isin(*patterns.CHANNELS)
    out = out.withColumn("is_channel", flag.cast("int"))
    shaped = out.withColumn("_f", channel_shape("prices", "atr", ~flag | (F.col("label") == patterns.CHANNELS[0])))
    return shaped.withColumns({c: F.col(f"_f.{c}") for c in patterns.CHANNEL_FEATURES}).drop("_f")
