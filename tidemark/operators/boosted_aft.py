"""Boosted accelerated failure times: trees on histograms of a censored log-likelihood's gradients.

A life's logarithm is a sum of trees plus normal noise. Lives are known, bounded below, above or on
both sides. A level of a tree is one pass: tasks add up gradients and curvatures by node, feature and
bin, so what leaves a task, and what the driver sees, does not depend on the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import store

#: Curvatures are kept between these, so that rows far in a tail neither vanish nor rule.
FLOOR, CEILING = 1e-6, 15.0
#: Trees after which their sum is written beside the rows, so that a pass need not add up all.
REFRESH = 25


def normal_tail(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.frompyfunc(math.erfc, 1, 1)(np.asarray(z, float) / math.sqrt(2)).astype(float)


def density(z: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * np.minimum(np.abs(z), 38.0) ** 2) / math.sqrt(2 * math.pi)


def likelihood(mu: np.ndarray, lower: np.ndarray, upper: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature by ``mu`` of lives between ``lower`` and ``upper``, the same where known, infinite where open."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        a, b = (np.log(lower) - mu) / scale, (np.log(upper) - mu) / scale
        known = lower == upper
        # On the left of the middle the other tail is exact.
        mass = np.where(b < 0, normal_tail(-b) - normal_tail(-a), normal_tail(a) - normal_tail(b))
        # Bounds eight deviations off on one side: what the nearer one tells, from the tail's series.
        off = np.where(a > 8, a, np.where(b < -8, -b, np.nan))
        side, far = np.where(a > 8, -1.0, 1.0), ~np.isnan(off)
        mass = np.where(far | (mass <= 0), 1.0, mass)
        pa_, pb = np.where(np.isinf(a), 0.0, density(a)), np.where(np.isinf(b), 0.0, density(b))
        turn = (np.where(np.isinf(b), 0.0, b * pb) - np.where(np.isinf(a), 0.0, a * pa_)) / mass
        rate = np.where(far, side * (off + 1 / off), (pb - pa_) / mass)
        turn = np.where(far, -off * (off + 1 / off), turn)
        open_loss = np.where(far, 0.5 * off * off + np.log(off * math.sqrt(2 * math.pi)), -np.log(mass))
        loss = np.where(known, 0.5 * a * a + math.log(scale * math.sqrt(2 * math.pi)) + np.log(np.where(known, lower, 1.0)), open_loss)
        slope = np.where(known, -a, rate) / scale
        curve = np.where(known, 1.0, turn + rate * rate) / scale**2
    return loss, slope, np.clip(curve, FLOOR, CEILING)


@dataclass
class Tree:
    """Splits by node in the order of a heap: feature (-1: none) and last bin of the left side; values of the lowest level's nodes."""

    depth: int
    feature: np.ndarray
    cut: np.ndarray
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def leaf(self, x: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row of bins after ``levels`` splits, from 0; rows go left where a node has none."""
        node = np.zeros(len(x), int)
        for level in range(levels):
            at = (1 << level) - 1 + node
            chosen = self.feature[at]
            node = 2 * node + ((chosen >= 0) & (x[np.arange(len(x)), np.maximum(chosen, 0)] > self.cut[at]))
        return node

    def add(self, x: np.ndarray) -> np.ndarray:
        return self.values[self.leaf(x, self.depth)]


@dataclass
class BoostedLives:
    features: list[str]
    edges: list[np.ndarray]
    base: float
    scale: float
    rate: float
    trees: list[Tree]
    losses: list[float]


def best_split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[int, int, float]:
    """The feature and bin whose split of sums (features, bins) gains most, the first of equal ones; -1 if none gains."""
    left_g, left_h = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
    all_g, all_h = g[0].sum(), h[0].sum()
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
    gain = np.where((left_h > FLOOR / 2) & (right_h > FLOOR / 2), gain, 0.0)
    if not gain.size or gain.max() <= 1e-9:
        return -1, 0, 0.0
    f, k = np.unravel_index(int(np.argmax(gain > gain.max() * (1 - 1e-9))), gain.shape)
    return int(f), int(k), float(gain[f, k])


def fit(df: DataFrame, features: list[str], lower: str, upper: str, rounds: int = 200, depth: int = 3, rate: float = 0.05, scale: float = 1.2, bins: int = 32, ridge: float = 1.0) -> BoostedLives:
    """Fit on lives between ``lower`` and ``upper`` (null: without end); those under 0.5 count as 0.5, rows with a null feature are left out.

    ``losses`` has the mean loss before each round and at the end. A pass's sums are 2 ** level nodes x
    features x bins numbers a task.
    """
    d = len(features)
    rows = df.dropna(subset=[*features, lower]).select(
        *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(features)],
        F.greatest(F.col(lower).cast("double"), F.lit(0.5)).alias("lower"),
        F.when(F.col(upper).isNull(), float("inf")).otherwise(F.greatest(F.col(upper).cast("double"), F.lit(0.5))).alias("upper"),
    )
    rows = store(rows, "boosted-rows")
    cuts = [k / bins for k in range(1, bins)]
    told = rows.agg(F.count("*").alias("n"), F.avg(F.ln("lower")).alias("base"), *[F.percentile_approx(f"x{k}", cuts, 10_000).alias(f"q{k}") for k in range(d)]).first()
    edges = [np.unique(np.array(told[f"q{k}"] or [], float)) for k in range(d)]
    model = BoostedLives(features, edges, told["base"] or 0.0, scale, rate, [], [])
    if not told["n"]:
        return model
    table = rows.withColumn("margin", F.lit(model.base))

    def margins(x: np.ndarray, margin: np.ndarray, trees: list[Tree]) -> np.ndarray:
        for tree in trees:
            margin = margin + rate * tree.add(x)
        return margin

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        x = np.stack([np.searchsorted(e, batch.column(f"x{k}").to_numpy(), side="left") for k, e in enumerate(edges)], axis=1)
        return x, *(batch.column(c).to_numpy() for c in ("lower", "upper", "margin"))

    def sums(source: DataFrame, trees: list[Tree], tree: Tree, level: int) -> tuple[np.ndarray, np.ndarray, float]:
        size = (1 << level) * d * bins

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g, h, loss = np.zeros(size), np.zeros(size), 0.0
            for batch in batches:
                x, low, high, margin = read(batch)
                one, slope, curve = likelihood(margins(x, margin, trees), low, high, scale)
                loss += float(one.sum())
                place = (tree.leaf(x, level)[:, None] * d + np.arange(d)) * bins + x
                g += np.bincount(place.ravel(), np.repeat(slope, d), size)
                h += np.bincount(place.ravel(), np.repeat(curve, d), size)
            k = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, k]), pa.array(np.r_[loss, g[k]]), pa.array(np.r_[0.0, h[k]])], names=["k", "g", "h"])

        g, h, loss = np.zeros(size), np.zeros(size), 0.0
        for r in source.mapInArrow(run, "k bigint, g double, h double").groupBy("k").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            if r["k"] < 0:
                loss = r["g"]
            else:
                g[r["k"]], h[r["k"]] = r["g"], r["h"]
        return g.reshape(-1, d, bins), h.reshape(-1, d, bins), loss / told["n"]

    fresh: list[Tree] = []
    nothing = Tree(0, np.zeros(0, int), np.zeros(0, int))
    for _ in range(rounds):
        tree = Tree(depth, np.full((1 << depth) - 1, -1), np.zeros((1 << depth) - 1, int), np.zeros(1 << depth))
        for level in range(depth):
            g, h, loss = sums(table, fresh, tree, level)
            if not level:
                model.losses.append(loss)
            for node in range(1 << level):
                at = (1 << level) - 1 + node
                f, k, _ = best_split(g[node], h[node], ridge) if h[node].any() else (-1, 0, 0.0)
                tree.feature[at], tree.cut[at] = f, k
                if level == depth - 1:
                    whole_g, whole_h = g[node][0].sum(), h[node][0].sum()
                    left_g, left_h = (whole_g, whole_h) if f < 0 else (g[node][f][: k + 1].sum(), h[node][f][: k + 1].sum())
                    tree.values[2 * node : 2 * node + 2] = -left_g / (left_h + ridge), -(whole_g - left_g) / (whole_h - left_h + ridge)
        fresh.append(tree)
        model.trees.append(tree)
        if len(fresh) == REFRESH:
            done = list(fresh)

            def settled(batches: Iterator[pa.RecordBatch], done=done) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    x, _, _, margin = read(batch)
                    yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margins(x, margin, done)))

            table, fresh = store(table.mapInArrow(settled, table.schema), "boosted-margins"), []
    model.losses.append(sums(table, fresh, nothing, 0)[2])
    return model


def predict(df: DataFrame, model: BoostedLives, name: str = "log_life") -> DataFrame:
    """Add the logarithm of the life expected; null where a feature is."""

    @F.arrow_udf("double")
    def run(x: pa.Array) -> pa.Array:
        values = np.asarray(x.flatten().to_numpy(zero_copy_only=False), float).reshape(len(x), -1) if len(x) else np.zeros((0, len(model.features)))
        binned = np.stack([np.searchsorted(e, values[:, k], side="left") for k, e in enumerate(model.edges)], axis=1)
        total = np.full(len(values), model.base)
        for tree in model.trees:
            total += model.rate * tree.add(binned)
        return pa.array(total, mask=np.isnan(values).any(axis=1))

    return df.withColumn(name, run(F.array(*[F.col(f).cast("double") for f in model.features])))


def survival(df: DataFrame, model: BoostedLives, horizons: list[float], name: str = "log_life") -> DataFrame:
    """A row for each horizon with the chance to outlive it, of rows with :func:`predict`'s column."""
    scale = model.scale

    @F.arrow_udf("double")
    def tail(z: pa.Array) -> pa.Array:
        values = z.to_numpy(zero_copy_only=False)
        return pa.array(normal_tail(np.nan_to_num(values)), mask=np.isnan(values))

    out = df.withColumn("horizon", F.explode(F.array(*[F.lit(float(h)) for h in horizons])))
    return out.withColumn("survival", tail((F.ln("horizon") - F.col(name)) / scale))
