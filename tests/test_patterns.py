"""Pattern geometry against plain one-window versions written from the definitions."""

import random

import numpy as np
import pytest

from tidemark.functions import patterns as P


def plain_smooth(v):
    if len(v) < 3:
        return list(v)
    w = [v[0], *v, v[-1]]
    return [(w[i] + w[i + 1] + w[i + 2]) / 3 for i in range(len(v))]


def plain_turns(v):
    if len(v) < 5:
        return [], []
    signs, last = [], 0
    for a, b in zip(v, v[1:]):
        s = int(b > a) - int(b < a)
        last = s if s else last
        signs.append(last)
    out = []
    for falls in (True, False):
        kept = []
        for i in range(len(signs) - 1):
            d = signs[i + 1] - signs[i]
            if (d < 0 if falls else d > 0) and (not kept or i + 1 - kept[-1] >= 3):
                kept.append(i + 1)
        out.append(kept)
    return out


def plain_double_bottom(v):
    highs, lows = plain_turns(v)
    scale, best = max(v) - min(v) + 1e-8, 0.0
    for a, b in zip(lows, lows[1:]):
        between = [v[m] for m in highs if a < m < b]
        if b - a >= max(4, len(v) // 10) and between:
            s = 0.45 * (1 - min(abs(v[a] - v[b]) / scale, 1)) + 0.35 * min((max(between) - max(v[a], v[b])) / scale, 1) + 0.20 * max(min((v[-1] - v[b]) / scale, 1), 0)
            best = max(best, s)
    return min(max(best, 0), 1)


def plain_shoulders(v):
    highs, lows = plain_turns(v)
    scale, best = max(v) - min(v) + 1e-8, 0.0
    for a, b, c in zip(highs, highs[1:], highs[2:]):
        necks = [v[m] for m in lows if a < m < c]
        neck = min((min(v[a], v[c]) - sum(necks) / len(necks)) / scale, 1) if necks else 0
        s = 0.35 * (1 - min(abs(v[a] - v[c]) / scale, 1)) + 0.35 * min((v[b] - max(v[a], v[c])) / scale, 1) + 0.15 * neck + 0.15 * max(min((v[b] - v[-1]) / scale, 1), 0)
        best = max(best, s)
    return min(max(best, 0), 1)


def plain_fit(v):
    x = np.arange(len(v))
    slope, start = np.polyfit(x, v, 1)
    rest = np.array(v) - (slope * x + start)
    total = ((np.array(v) - np.mean(v)) ** 2).sum()
    return slope, start, 1 - (rest**2).sum() / total if total > 0 else 0.0, rest.std()


def plain_scores(raw):
    v = plain_smooth(raw)
    n, scale = len(v), max(v) - min(v) + 1e-8
    slope, _, r2, sd = plain_fit(v)
    turns = sum(map(len, plain_turns(v)))
    channel = lambda up: 0.4 * up + 0.3 * max(r2, 0) + 0.2 * (1 - min(sd / scale, 1)) + 0.1 * min(turns / 8, 1)
    flag = 0.0
    if n >= 12:
        a, b = v[: n // 2], v[n // 2 :]
        flag = 0.35 * min((max(a) - min(a)) / scale, 1) + 0.3 * max((a[-1] - a[0]) / scale, 0) + 0.2 * (1 - min((max(b) - min(b)) / scale / 0.5, 1)) + 0.15 * max((v[-1] - np.median(b)) / scale, 0)
    flat = 0.5 * (1 - min(abs(slope) * n / scale, 1)) + 0.25 * (1 - max(r2, 0)) + 0.15 * min(sd / scale, 1) + 0.1 * min(turns / 6, 1)
    down = [-x for x in v]
    return [plain_double_bottom(v), plain_double_bottom(down), channel(slope > 0), channel(slope < 0), min(max(flag, 0), 1), plain_shoulders(v), plain_shoulders(down), flat]


def walks(n, size, seed=0):
    rng = np.random.default_rng(seed)
    smooth = 50 + np.cumsum(rng.normal(size=(n, size)), axis=1)
    coarse = np.round(smooth)  # flat steps and ties
    return np.concatenate([smooth, coarse, np.full((1, size), 5.0)])


@pytest.mark.parametrize("size", [4, 11, 32, 45])
def test_scores_match_plain_versions(size):
    raw = walks(80, size)
    got = P.scores(raw)
    want = np.array([plain_scores(list(map(float, r))) for r in raw])
    smooth = np.array([plain_smooth(list(r)) for r in raw])
    keep = np.abs([plain_fit(list(r))[0] for r in smooth]) > 1e-9  # no sign to compare on level windows
    assert np.allclose(got[keep], want[keep], atol=1e-9)
    assert ((got >= 0) & (got <= 1)).all()


def test_turning_points_match_plain_version():
    for raw in walks(100, 32, 3):
        highs, lows = P.turning_points(raw[None, :])
        assert [list(np.flatnonzero(highs[0])), list(np.flatnonzero(lows[0]))] == list(map(list, plain_turns(list(raw))))


def test_mirrored_windows_swap_patterns():
    raw = walks(60, 32, 1)[:60]
    a, b = P.scores(raw), P.scores(-raw)
    for one, other in (("double_bottom", "double_top"), ("ascending_channel", "descending_channel"), ("head_shoulders", "inverse_head_shoulders")):
        assert np.allclose(a[:, P.PATTERNS.index(one)], b[:, P.PATTERNS.index(other)])


def test_metrics_match_plain_versions():
    raw = walks(60, 32, 2)[:60]
    got = P.metrics(raw)
    for r, g in zip(raw, got):
        v = np.array(plain_smooth(list(r)))
        slope, _, _, sd = plain_fit(list(v))
        highs, lows = plain_turns(list(v))
        scale = v.max() - v.min() + 1e-8
        ret = np.r_[0.0, np.diff(v)] / np.maximum(v, 1e-8)
        ends = highs if len(highs) >= 2 else lows if len(lows) >= 2 else None
        sym = 1 - min(abs(v[ends[0]] - v[ends[-1]]) / scale, 1) if ends else 1.0
        want = [
            slope, sd, scale, len(highs), len(lows), sym, min(v / np.maximum.accumulate(v) - 1), ret[16:].std() / (ret[:16].std() + 1e-8),
            np.ptp(v[16:]) / (np.ptp(v[:16]) + 1e-8), (v[-1] - np.median(v)) / scale, ret.mean(), ret.std(),
        ]
        assert np.allclose(g, want, atol=1e-8)


def test_channel_features_match_plain_versions():
    rng = random.Random(4)
    raw = walks(40, 32, 5)[:40]
    atr = np.array([rng.random() for _ in raw])
    up = np.array([rng.random() < 0.5 for _ in raw])
    for r, a, u, g in zip(raw, atr, up, P.channel_features(raw, atr, up)):
        v = plain_smooth(list(r))
        slope, start, r2, sd = plain_fit(v)
        ret = np.diff(r) / r[:-1]
        low = start + slope * 31 - 2 * sd
        want = [
            float(u), slope / r.mean(), r2, sd / r.mean(), 4 * sd / r.mean(), a / r[-1], ret[-20:].std(), ret[-1], np.polyfit(np.arange(10), ret[-10:], 1)[0],
            sum(map(len, plain_turns(v))), min(max((r[-1] - low) / (4 * sd), 0), 1),
        ]
        assert np.allclose(g, want, atol=1e-8)


def test_known_shapes_get_their_names():
    x = np.arange(32)
    shapes = {"ascending_channel": 50 + x + np.sin(x), "descending_channel": 90 - x + np.sin(x), "double_bottom": 50 - 5 * np.abs(np.sin(x / 31 * 2 * np.pi))}
    for name, v in shapes.items():
        assert P.PATTERNS[int(P.scores(v[None, :])[0].argmax())] == name
