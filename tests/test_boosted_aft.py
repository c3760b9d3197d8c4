"""Boosted lives against a plain version, and their likelihood against its definition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosted_aft as B


def plain_loss(mu, low, high, s):
    cdf = lambda t: 0.5 * math.erfc(-(math.log(t) - mu) / s / math.sqrt(2)) if 0 < t < math.inf else float(t > 0)
    if low == high:
        z = (math.log(low) - mu) / s
        return 0.5 * z * z + math.log(s * math.sqrt(2 * math.pi) * low)
    return -math.log(cdf(high) - cdf(low))


@pytest.mark.parametrize(("low", "high"), [(3.0, 3.0), (3.0, math.inf), (2.0, 9.0), (0.0, 4.0)])
@pytest.mark.parametrize("mu", [-1.0, 0.7, 2.5])
def test_likelihood_and_its_derivatives(low, high, mu):
    loss, slope, curve = (float(x[0]) for x in B.likelihood(np.array([mu]), np.array([low]), np.array([high]), 0.8))
    f = lambda m: plain_loss(m, low, high, 0.8)
    assert loss == pytest.approx(f(mu), rel=1e-9)
    assert slope == pytest.approx((f(mu + 1e-5) - f(mu - 1e-5)) / 2e-5, rel=1e-5, abs=1e-7)
    second = (f(mu + 1e-4) - 2 * f(mu) + f(mu - 1e-4)) / 1e-8
    assert curve == pytest.approx(min(max(second, B.FLOOR), B.CEILING), rel=1e-3, abs=1e-5)


def test_far_tails_stay_finite():
    loss, slope, curve = B.likelihood(np.array([-60.0, 60.0, 0.0]), np.array([5.0, 5.0, 1e300]), np.full(3, np.inf), 1.0)
    assert np.isfinite(loss).all() and np.isfinite(slope).all() and (curve >= B.FLOOR).all()


@pytest.fixture(scope="module")
def lives():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, 3)), 2)
    life = np.exp(1.5 + 0.8 * (x[:, 0] > 0) - 0.5 * x[:, 1] + rng.normal(size=400) * 0.4)
    low, high = life.copy(), life.copy()
    high[::4] = np.inf
    low[::4] *= 0.6
    low[1::8], high[1::8] = np.floor(low[1::8]) + 0.5, np.floor(low[1::8]) + 2.5
    return x, np.maximum(low, 0.5), high


def plain_boost(x, low, high, edges, rounds, depth, rate, ridge, base, scale):
    """Trees built node by node over rows."""
    bins = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    mu, losses = np.full(len(x), base), []
    for _ in range(rounds):
        loss, g, h = B.likelihood(mu, low, high, scale)
        losses.append(loss.mean())

        def grow(rows, left, add):
            gain_best, found = 1e-9, None
            total = g[rows].sum() ** 2 / (h[rows].sum() + ridge)
            for f in range(x.shape[1]):
                for cut in range(31):
                    a = rows[bins[rows, f] <= cut]
                    b = rows[bins[rows, f] > cut]
                    if len(a) and len(b):
                        gain = g[a].sum() ** 2 / (h[a].sum() + ridge) + g[b].sum() ** 2 / (h[b].sum() + ridge) - total
                        if gain > gain_best * (1 + 1e-9):
                            gain_best, found = gain, (a, b)
            if left and found:
                for side in found:
                    grow(side, left - 1, add)
            else:
                add[rows] = -g[rows].sum() / (h[rows].sum() + ridge)

        add = np.zeros(len(x))
        grow(np.arange(len(x)), depth, add)
        mu = mu + rate * add
    return mu, [*losses, B.likelihood(mu, low, high, scale)[0].mean()]


@pytest.mark.parametrize("refresh", [3, 25])
def test_trees_are_those_of_a_plain_version(spark, lives, refresh, monkeypatch):
    monkeypatch.setattr(B, "REFRESH", refresh)
    x, low, high = lives
    data = [(*map(float, r), float(a), None if np.isinf(b) else float(b)) for r, a, b in zip(x, low, high)]
    df = spark.createDataFrame(data, "a double, b double, c double, low double, high double").repartition(3)
    model = B.fit(df, ["a", "b", "c"], "low", "high", rounds=6, depth=2, rate=0.3, scale=0.6)
    want, losses = plain_boost(x, low, high, model.edges, 6, 2, 0.3, 1.0, float(np.log(low).mean()), 0.6)
    assert model.losses == pytest.approx(losses, rel=1e-9)
    assert all(b < a for a, b in zip(model.losses, model.losses[1:]))
    got = np.array([r["log_life"] for r in B.predict(df.coalesce(1), model).orderBy("a", "b", "c", "low").collect()])
    assert np.allclose(np.sort(got), np.sort(want), atol=1e-9)


def test_survival_falls_with_the_horizon_and_nulls_pass(spark, lives):
    x, low, high = lives
    df = spark.createDataFrame([(*map(float, r), float(a)) for r, a in zip(x, low)], "a double, b double, c double, low double").withColumn("high", F.lit(None).cast("double"))
    model = B.fit(df, ["a", "b", "c"], "low", "high", rounds=2, depth=1)
    out = B.survival(B.predict(df.limit(5), model), model, [1, 5, 50]).orderBy("a", "b", "c", "low", "horizon").collect()
    assert all(p["survival"] > q["survival"] for p, q in zip(out, out[1:]) if p["horizon"] < q["horizon"])
    none = B.predict(df.limit(1).withColumn("b", F.lit(None).cast("double")), model)
    assert none.first()["log_life"] is None and B.survival(none, model, [1]).first()["survival"] is None
    assert B.fit(df.limit(0), ["a", "b", "c"], "low", "high").trees == []
