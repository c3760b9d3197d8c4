"""Chart-pattern geometry over many windows at once: every function takes a matrix of one window per row."""

from __future__ import annotations

import numpy as np

# The pattern names in the order that settles ties and numbers the classes.
PATTERNS = [
    "double_bottom", "double_top", "ascending_channel", "descending_channel",
    "high_tight_flag", "head_shoulders", "inverse_head_shoulders", "range",
]
CHANNELS = ("ascending_channel", "descending_channel")
UNCLASSIFIED = "unclassified"

# The names of the shape metrics.
METRICS = [
    "trend_slope", "residual_std", "pattern_range", "n_maxima", "n_minima", "symmetry_score",
    "drawdown", "volatility_ratio", "compression_ratio", "breakout_strength", "return_mean", "return_std",
]

# The names of a channel's features at its detection.
CHANNEL_FEATURES = [
    "dir_asc", "slope_norm", "r2", "resid_norm", "band_width", "atr_norm",
    "vol20", "last_ret", "accel", "n_turn", "pos_in_channel",
]


def smooth(v: np.ndarray) -> np.ndarray:
    """Mean of three neighbours, the ends repeated; shorter windows stay as they are."""
    if v.shape[1] < 3:
        return v.copy()
    wide = np.concatenate([v[:, :1], v, v[:, -1:]], axis=1)
    return (wide[:, :-2] + wide[:, 1:-1] + wide[:, 2:]) / 3


def spaced(points: np.ndarray, apart: int) -> np.ndarray:
    """Of marked places, from the left, those at least ``apart`` after the last one kept."""
    kept = np.zeros_like(points)
    last = np.full(len(points), -apart)
    for j in range(points.shape[1]):
        take = points[:, j] & (j - last >= apart)
        kept[:, j] = take
        last[take] = j
    return kept


def turning_points(v: np.ndarray, apart: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Masks of maxima and minima: where the direction falls or rises; flat steps keep the last direction."""
    n, size = v.shape
    highs, lows = np.zeros((n, size), bool), np.zeros((n, size), bool)
    if size >= 5:
        way = np.sign(np.diff(v, axis=1))
        for j in range(1, size - 1):
            way[:, j] = np.where(way[:, j] == 0, way[:, j - 1], way[:, j])
        turn = np.diff(way, axis=1)
        highs[:, 1:-1], lows[:, 1:-1] = turn < 0, turn > 0
    return spaced(highs, apart), spaced(lows, apart)


def line(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slope, intercept, R2 (0 without variance) and population deviation of the residuals."""
    x = np.arange(v.shape[1]) - (v.shape[1] - 1) / 2
    mean = v.mean(1)
    off = v - mean[:, None]
    slope = off @ x / max(float(x @ x), 1e-300)
    rest = off - slope[:, None] * x
    total = (off**2).sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        r2 = np.where(total > 0, 1 - (rest**2).sum(1) / total, 0.0)
    return slope, mean - slope * (v.shape[1] - 1) / 2, r2, rest.std(1)


def extent(v: np.ndarray) -> np.ndarray:
    return v.max(1) - v.min(1) + 1e-8


def twin_score(v: np.ndarray, highs: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """Best pair of neighbouring lows with a high between them: alike, deep, and left upwards."""
    n, size = v.shape
    scale, best = extent(v), np.zeros(n)
    before = np.full(n, -1)
    bridge = np.full(n, -np.inf)
    rows = np.arange(n)
    for j in range(size):
        bridge = np.where(highs[:, j], np.maximum(bridge, v[:, j]), bridge)
        here = lows[:, j]
        first = v[rows, np.maximum(before, 0)]
        with np.errstate(invalid="ignore"):
            alike = 1 - np.minimum(np.abs(first - v[:, j]) / scale, 1)
            rebound = np.minimum((bridge - np.maximum(first, v[:, j])) / scale, 1)
            left = np.minimum((v[:, -1] - v[:, j]) / scale, 1)
            score = 0.45 * alike + 0.35 * rebound + 0.20 * np.maximum(left, 0)
        good = here & (before >= 0) & (j - before >= max(4, size // 10)) & np.isfinite(bridge)
        best = np.where(good, np.maximum(best, score), best)
        before = np.where(here, j, before)
        bridge = np.where(here, -np.inf, bridge)
    return np.clip(best, 0, 1)


def shoulders_score(v: np.ndarray, highs: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """Best triple of neighbouring highs: level shoulders, a higher head, a neckline below, left downwards."""
    n, size = v.shape
    scale, best = extent(v), np.zeros(n)
    rows = np.arange(n)
    low_sum = np.cumsum(np.where(lows, v, 0.0), axis=1)
    low_count = np.cumsum(lows, axis=1)
    left, head = np.full(n, -1), np.full(n, -1)
    for j in range(size):
        here = highs[:, j]
        a, b = np.maximum(left, 0), np.maximum(head, 0)
        side = np.minimum(v[rows, a], v[:, j])
        alike = 1 - np.minimum(np.abs(v[rows, a] - v[:, j]) / scale, 1)
        margin = np.minimum((v[rows, b] - np.maximum(v[rows, a], v[:, j])) / scale, 1)
        count = low_count[:, j] - low_count[rows, a]
        level = (low_sum[:, j] - low_sum[rows, a]) / np.maximum(count, 1)
        neck = np.where(count > 0, np.minimum((side - level) / scale, 1), 0.0)
        drop = np.minimum((v[rows, b] - v[:, -1]) / scale, 1)
        score = 0.35 * alike + 0.35 * margin + 0.15 * neck + 0.15 * np.maximum(drop, 0)
        best = np.where(here & (left >= 0), np.maximum(best, score), best)
        left, head = np.where(here, head, left), np.where(here, j, head)
    return np.clip(best, 0, 1)


def flag_score(v: np.ndarray) -> np.ndarray:
    """A steep first half and a narrow second one; windows under twelve rows score 0."""
    n, size = v.shape
    if size < 12:
        return np.zeros(n)
    first, second, scale = v[:, : size // 2], v[:, size // 2 :], extent(v)
    impulse = np.minimum((first.max(1) - first.min(1)) / scale, 1)
    trend = np.maximum((first[:, -1] - first[:, 0]) / scale, 0)
    quiet = 1 - np.minimum((second.max(1) - second.min(1)) / scale / 0.5, 1)
    drift = np.maximum((v[:, -1] - np.median(second, axis=1)) / scale, 0)
    return np.clip(0.35 * impulse + 0.30 * trend + 0.20 * quiet + 0.15 * drift, 0, 1)


def scores(raw: np.ndarray) -> np.ndarray:
    """The eight scores of every raw window, in the order of PATTERNS."""
    v = smooth(np.asarray(raw, float))
    size = v.shape[1]
    highs, lows = turning_points(v)
    turns = highs.sum(1) + lows.sum(1)
    slope, _, r2, rest = line(v)
    scale = extent(v)
    spread = np.minimum(rest / scale, 1)
    channel = lambda up: np.clip(0.40 * up + 0.30 * np.maximum(r2, 0) + 0.20 * (1 - spread) + 0.10 * np.minimum(turns / 8, 1), 0, 1)
    flat = 1 - np.minimum(np.abs(slope) * size / scale, 1)
    sideways = np.clip(0.50 * flat + 0.25 * (1 - np.maximum(r2, 0)) + 0.15 * spread + 0.10 * np.minimum(turns / 6, 1), 0, 1)
    return np.stack(
        [
            twin_score(v, highs, lows), twin_score(-v, lows, highs), channel(slope > 0), channel(slope < 0),
            flag_score(v), shoulders_score(v, highs, lows), shoulders_score(-v, lows, highs), sideways,
        ],
        axis=1,
    )


def metrics(raw: np.ndarray) -> np.ndarray:
    """The twelve shape metrics of every raw window, in the order of METRICS."""
    v = smooth(np.asarray(raw, float))
    n, size = v.shape
    rows = np.arange(n)
    highs, lows = turning_points(v)
    slope, _, _, rest = line(v)
    scale = extent(v)
    returns = np.diff(v, axis=1, prepend=v[:, :1]) / np.maximum(v, 1e-8)
    early, late = slice(0, max(2, size // 2)), slice(max(1, size // 2), size)

    def ends_apart(points: np.ndarray) -> np.ndarray:
        return np.abs(v[rows, points.argmax(1)] - v[rows, size - 1 - points[:, ::-1].argmax(1)])

    apart = np.where(highs.sum(1) >= 2, ends_apart(highs), np.where(lows.sum(1) >= 2, ends_apart(lows), 0.0))
    span = lambda x: x.max(1) - x.min(1)
    return np.stack(
        [
            slope, rest, scale, highs.sum(1), lows.sum(1), np.clip(1 - np.minimum(apart / scale, 1), 0, 1),
            (v / np.maximum.accumulate(v, axis=1) - 1).min(1),
            returns[:, late].std(1) / (returns[:, early].std(1) + 1e-8),
            span(v[:, late]) / (span(v[:, early]) + 1e-8),
            (v[:, -1] - np.median(v, axis=1)) / scale, returns.mean(1), returns.std(1),
        ],
        axis=1,
    )


def channel_features(raw: np.ndarray, atr: np.ndarray, ascending: np.ndarray, band: float = 2.0) -> np.ndarray:
    """The eleven features of every raw window seen as a channel, in the order of CHANNEL_FEATURES."""
    raw = np.asarray(raw, float)
    size = raw.shape[1]
    v = smooth(raw)
    slope, start, r2, rest = line(v)
    level = raw.mean(1)
    level = np.where(level == 0, 1.0, level)
    with np.errstate(divide="ignore", invalid="ignore"):
        returns = np.diff(raw, axis=1) / raw[:, :-1]
        near = np.where(raw[:, -1] != 0, atr / raw[:, -1], 0.0)
    highs, lows = turning_points(v)
    lower = start + slope * (size - 1) - band * rest
    width = 2 * band * rest
    place = (raw[:, -1] - lower) / np.where(width == 0, 1e-8, width)
    accel = line(returns[:, -10:])[0] if size >= 4 else np.zeros(len(raw))
    return np.stack(
        [
            np.asarray(ascending, float), slope / level, r2, rest / level, width / level, near,
            returns[:, -20:].std(1), returns[:, -1], accel, highs.sum(1) + lows.sum(1), np.clip(place, 0, 1),
        ],
        axis=1,
    )
