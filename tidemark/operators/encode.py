"""Windows as images: Gramian angular fields, recurrence plots, feature maps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import _matrix


def to_unit_band(v: np.ndarray) -> np.ndarray:
    """Each row scaled to -1 ... 1; a constant one is zeros."""
    low, high = v.min(1, keepdims=True), v.max(1, keepdims=True)
    flat = np.isclose(low, high)
    return np.where(flat, 0.0, np.clip(2 * (v - low) / np.where(flat, 1.0, high - low) - 1, -1, 1))


def angular_field(v: np.ndarray, difference: bool = False) -> np.ndarray:
    """cos of the sums, or sin of the differences, of the rows' angles.

    With s = sin(phi) the pairs are products of the scaled values and s, no angle is needed.
    """
    c = to_unit_band(v)
    s = np.sqrt(np.maximum(0.0, 1 - c * c))
    outer = lambda a, b: a[:, :, None] * b[:, None, :]
    return outer(s, c) - outer(c, s) if difference else outer(c, c) - outer(s, s)


def recurrence(v: np.ndarray, quantile: float = 0.20) -> np.ndarray:
    gaps = np.abs(v[:, :, None] - v[:, None, :])
    scale = np.quantile(gaps.reshape(len(v), -1), quantile, axis=1)
    return np.exp(-gaps / np.where(scale > 0, scale, 1.0)[:, None, None])


def unit(x: np.ndarray) -> np.ndarray:
    low, high = x.min((1, 2), keepdims=True), x.max((1, 2), keepdims=True)
    flat = np.isclose(low, high)
    return np.where(flat, 0.0, (x - low) / np.where(flat, 1.0, high - low))


def stretch(old: int, new: int) -> np.ndarray:
    """The matrix that resamples ``old`` evenly spaced points to ``new`` by linear interpolation."""
    at = np.linspace(0, old - 1, new)
    return np.maximum(0.0, 1 - np.abs(at[:, None] - np.arange(old)[None, :]))


def resize(x: np.ndarray, rows: int, columns: int) -> np.ndarray:
    return stretch(x.shape[1], rows) @ x @ stretch(x.shape[2], columns).T


def feature_map(x: np.ndarray, size: int) -> np.ndarray:
    """Windows (n, rows, features) as squares: features by robust z-score, -3 ... 3 to 0 ... 1."""
    x = np.swapaxes(x, 1, 2)
    low, middle, high = np.nanpercentile(x, [25, 50, 75], axis=2, keepdims=True)
    spread = np.where(high - low == 0, 1.0, high - low)
    z = np.nan_to_num((x - middle) / spread, nan=0.0)
    return resize(np.clip((z + 3) / 6, 0, 1), size, size)


def image(prices: np.ndarray, features: np.ndarray, size: int) -> np.ndarray:
    """(n, size, size, 3), 0 ... 255: the price field, the returns field, the feature map."""
    returns = np.diff(prices, axis=1, prepend=prices[:, :1]) / np.maximum(prices, 1e-8)
    base = prices.shape[1]
    channels = [unit(angular_field(prices)), unit(angular_field(returns, True)), feature_map(features, base)]
    if base != size:
        channels = [resize(c, size, size) for c in channels]
    return np.clip(np.stack(channels, axis=-1) * 255, 0, 255).astype(np.float32)


def _lists(x: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(x.reshape(len(x), -1), dtype=np.float32)
    width = flat.shape[1] if len(flat) else 0
    return pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * width, flat.ravel())


def encode(windows: DataFrame, kind: str, size: int | None = None, prices: str = "prices", name: str = "image") -> DataFrame:
    """Add ``name``, a flat array of floats: gasf, gadf, recurrence, scaled, or image (price as the only feature)."""

    @F.arrow_udf("array<float>")
    def run(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.list_(pa.float32()))
        v = _matrix(column)
        if kind == "scaled":
            return _lists(to_unit_band(v))
        if kind == "image":
            return _lists(image(v, v[:, :, None], size or v.shape[1]))
        x = {"gasf": angular_field, "gadf": lambda a: angular_field(a, True), "recurrence": recurrence}[kind](v)
        return _lists(resize(x, size, size) if size else x)

    return windows.withColumn(name, run(prices))


def encode_features(windows: DataFrame, prices: str, window: str, size: int, name: str = "image") -> DataFrame:
    """Add the three-channel image of a price array and an array of feature rows."""

    @F.arrow_udf("array<float>")
    def run(price: pa.Array, rows: pa.Array) -> pa.Array:
        if not len(price):
            return pa.array([], pa.list_(pa.float32()))
        v = _matrix(price)
        x = rows.flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), v.shape[1], -1)
        return _lists(image(v, x, size))

    return windows.withColumn(name, run(prices, window))


def config_hash(*parts) -> str:
    """The name under which encoded windows of one configuration are stored."""
    import hashlib

    return hashlib.sha256(repr(parts).encode()).hexdigest()[:16]


def mean_pixel(image_column: str) -> Column:
    return F.aggregate(F.col(image_column), F.lit(0.0), lambda a, x: a + x) / F.size(image_column)
