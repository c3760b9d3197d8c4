"""Many logistic models fitted together: one pass over the rows is a Newton step of all of them.

A row belongs to any number of models (patterns, cutoffs of time, regimes) with a label in each. Tasks
add up every model's gradient and curvature over their rows, a few numbers a model, so rows are never
copied by model and nothing is shuffled but those sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import store

#: Rows that a task turns into matrices at a time.
ROWS = 4096
#: Halvings of a step that raised the loss before it is given up.
HALVINGS = 20


@dataclass
class Models:
    """Coefficients (models, features) and intercepts of models that were fitted; ``fitted`` is false where a class was missing."""

    names: list[str]
    features: list[str]
    weights: np.ndarray
    intercepts: np.ndarray
    fitted: np.ndarray


def labels_of(memberships: dict[str, tuple[Column, Column]]) -> Column:
    """An array with a label for each model: 1 or 0 where the model's first column holds, by its second; null elsewhere."""
    return F.array(*[F.when(member, label.cast("double")) for member, label in memberships.values()])


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        flat = lambda c: np.asarray(part.column(c).flatten().to_numpy(zero_copy_only=False), float).reshape(part.num_rows, -1)  # noqa: B023, E731
        yield flat("x"), flat("y")


def fit_many(rows: DataFrame, features: list[str], memberships: dict[str, tuple[Column, Column]], iterations: int = 30, tolerance: float = 1e-9, balance: bool = True) -> Models:
    """A logistic model for each entry of ``memberships`` (name -> which rows, their label), L2-penalised by one unit over all.

    Classes weigh alike if ``balance`` is set. Rows with a null feature belong to no model. The driver
    holds the models and their sums, models x features squared numbers, whatever the rows are; a
    step that would raise a model's loss is halved for that model alone.
    """
    names, d = list(memberships), len(features)
    table = rows.dropna(subset=features).select(F.array(*[F.col(f).cast("double") for f in features]).alias("x"), labels_of(memberships).alias("y"))
    table = store(table, "many-models")
    of = F.posexplode("y").alias("m", "label")
    counts = {(r["m"], r["label"]): r["count"] for r in table.select(of).where("label is not null").groupBy("m", "label").count().collect()}
    ones, zeros = (np.array([counts.get((m, y), 0) for m in range(len(names))], float) for y in (1.0, 0.0))
    fitted = (ones > 0) & (zeros > 0)
    lift = np.where(fitted & balance, (ones + zeros) / 2, 1.0)
    weight_one, weight_zero = (np.where(fitted, lift / np.maximum(n, 1), 0.0) if balance else np.where(fitted, 1.0, 0.0) for n in (ones, zeros))
    spread = table.agg(*[f(F.get("x", k)).alias(f"{n}{k}") for k in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([spread[f"m{k}"] or 0.0 for k in range(d)])
    scale = np.array([spread[f"s{k}"] or 1.0 for k in range(d)])
    # Fitted on scaled features; the penalty is that of the features as they are.
    penalty = np.r_[1 / scale**2, 0.0]

    def sums(beta: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, slope, curve = np.zeros(len(names)), np.zeros((len(names), d + 1)), np.zeros((len(names), d + 1, d + 1))
            for batch in batches:
                for x, y in _matrices(batch):
                    x = np.c_[(x - mean) / scale, np.ones(len(x))]
                    z = x @ beta.T
                    w = np.where(np.isnan(y), 0.0, np.where(y == 1, weight_one, weight_zero))
                    p = 0.5 * (1 + np.tanh(z / 2))
                    hit = np.nan_to_num(y)
                    loss += (w * (np.logaddexp(0, z) - hit * z)).sum(axis=0)
                    slope += (w * (p - hit)).T @ x
                    curve += np.einsum("nm,ni,nj->mij", w * p * (1 - p), x, x, optimize=True)
            told = np.concatenate([loss[:, None], slope, curve.reshape(len(names), -1)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(names)), pa.int32()), pa.array(told.tolist(), pa.list_(pa.float64()))], names=["m", "sums"])

        width = 1 + (d + 1) + (d + 1) ** 2
        parts = table.mapInArrow(run, "m int, sums array<double>").groupBy("m").agg(*[F.sum(F.get("sums", k)).alias(f"c{k}") for k in range(width)])
        out = np.zeros((len(names), width))
        for r in parts.collect():
            out[r["m"]] = r[1:]
        loss = out[:, 0] + 0.5 * (penalty * beta**2).sum(axis=1)
        slope = out[:, 1 : d + 2] + penalty * beta
        curve = out[:, d + 2 :].reshape(-1, d + 1, d + 1) + np.diag(penalty)
        return loss, slope, curve

    best = np.zeros((len(names), d + 1))
    loss, slope, curve = sums(best)
    step = np.zeros_like(best)
    active, halved = fitted.copy(), np.zeros(len(names), int)
    for m in np.flatnonzero(active):
        step[m] = np.linalg.solve(curve[m] + 1e-12 * np.eye(d + 1), -slope[m])
    for _ in range(iterations):
        if not active.any():
            break
        tried = best + np.where(active[:, None], step * 0.5 ** halved[:, None], 0.0)
        new_loss, new_slope, new_curve = sums(tried)
        for m in np.flatnonzero(active):
            if new_loss[m] > loss[m] + 1e-12 * abs(loss[m]) and halved[m] < HALVINGS:
                halved[m] += 1
                continue
            gained = loss[m] - new_loss[m]
            best[m], loss[m], slope[m], curve[m], halved[m] = tried[m], new_loss[m], new_slope[m], new_curve[m], 0
            active[m] = gained > tolerance * tolerance * max(1.0, abs(loss[m])) and np.abs(step[m]).max() > tolerance
            step[m] = np.linalg.solve(curve[m] + 1e-12 * np.eye(d + 1), -slope[m])
    weights = best[:, :d] / scale
    return Models(names, features, weights, best[:, d] - weights @ mean, fitted)


def probabilities(rows: DataFrame, models: Models, name: str = "probabilities") -> DataFrame:
    """Add an array with each model's probability of label 1: null where a feature is null or a model was not fitted."""
    weights, intercepts, fitted = models.weights, models.intercepts, models.fitted

    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        values = np.asarray(x.flatten().to_numpy(zero_copy_only=False), float).reshape(len(x), -1) if len(x) else np.zeros((0, weights.shape[1]))
        z = values @ weights.T + intercepts
        p = np.where(fitted, 0.5 * (1 + np.tanh(z / 2)), np.nan)
        flat = pa.array(p.ravel(), mask=np.isnan(p.ravel()))
        return pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1], flat)

    return rows.withColumn(name, run(F.array(*[F.col(f).cast("double") for f in models.features])))


def rolling_refits(rows: DataFrame, features: list[str], label: str, cutoffs: list[str], gap_days: int, date: str = "end_date", months: int = 12) -> DataFrame:
    """``rows`` after a cutoff, once for each model up to ``months`` old: cutoff, age in months and its score.

    The model of a cutoff has learned from rows at least ``gap_days`` before it, whose labels were
    known by then. All models are fitted together.
    """
    known = F.col(label).isNotNull()
    days = [F.to_date(F.lit(c)) for c in cutoffs]
    models = fit_many(rows, features, {c: (known & (F.date_add(date, gap_days) <= day), F.col(label)) for c, day in zip(cutoffs, days, strict=True)})
    scored = probabilities(rows.where(known), models).select("*", F.posexplode("probabilities").alias("_m", "score")).where("score is not null")
    cut = F.element_at(F.array(*days), F.col("_m") + 1)
    scored = scored.withColumn("cutoff", cut).withColumn("age", F.months_between(date, cut))
    return scored.where((F.col(date) > F.col("cutoff")) & (F.col("age") <= months)).drop("probabilities", "_m")


def gated_scores(rows: DataFrame, features: list[str], label: str, regime: str, regimes: int, train: Column) -> DataFrame:
    """``rows`` outside ``train`` with ``gated``, the score of their own regime's head, and ``pooled``, that of one head for all.

    Heads are fitted together; a regime whose head has seen one class only takes the pooled one.
    """
    own = {f"regime {k}": (train & (F.col(regime) == k), F.col(label)) for k in range(regimes)}
    models = fit_many(rows, features, {"pooled": (train, F.col(label))} | own)
    scored = probabilities(rows.where(~train), models)
    pooled = F.get("probabilities", F.lit(0))
    return scored.withColumns({"pooled": pooled, "gated": F.coalesce(F.get("probabilities", F.col(regime).cast("int") + 1), pooled)}).drop("probabilities")
