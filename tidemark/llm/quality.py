"""Quality classifier: a generalised additive model with pairwise interactions, boosted from shallow trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, short_batches, store

# Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    b"the of and to a in is that it was for on with as by an are this der die das und ist ein eine zu den von "
    b"mit auf nicht le la les un une et de des est que en il dans pour el los las y es por con no".split()
)
FEATURES = [
    "log_bytes", "log_words", "word_length", "word_length_sd", "longest_word", "upper", "digits", "spaces", "marks",
    "non_ascii", "rare_marks", "shouts", "pipes", "distinct_words", "top_word", "function_words", "mark_ended_words",
    "plain_words", "log_lines", "line_length", "distinct_lines", "ended_lines", "byte_entropy", "distinct_pairs",
]

UPPER, DIGIT = slice(65, 91), slice(48, 58)
SPACE = [9, 10, 11, 12, 13, 32]
MARKS = [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]
COMMON_MARKS = [33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63, 124]
RARE_MARKS = [m for m in MARKS if m not in COMMON_MARKS]


def features(text: bytes) -> list[float]:
    """What the classifier knows of a whole text; all zero for one without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(text)
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lowered = text.lower().split()
    counts: dict[bytes, int] = {}
    for w in lowered:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    shares = histogram[histogram > 0] / size
    last = np.fromiter((w[-1] for w in words), np.uint8, n)
    ended = (last < 127) & (last > 32) & ~((last >= 48) & (last <= 57)) & ~((last >= 65) & (last <= 90)) & ~((last >= 97) & (last <= 122))
    return [
        math.log1p(size), math.log1p(n), float(lengths.mean()), float(lengths.std()), math.log1p(int(lengths.max())),
        histogram[UPPER].sum() / size, histogram[DIGIT].sum() / size, histogram[SPACE].sum() / size, histogram[MARKS].sum() / size,
        histogram[128:].sum() / size, histogram[RARE_MARKS].sum() / size, histogram[33] / size, histogram[124] / size,
        len(counts) / n, max(counts.values()) / n, sum(counts.get(w, 0) for w in FUNCTION_WORDS) / n,
        float(ended.mean()), sum(map(bytes.isalpha, lowered)) / n, math.log1p(len(lines)), math.log1p(size / len(lines)),
        len(set(lines)) / len(lines), sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
        float(-(shares * np.log2(shares)).sum()), len(set(zip(lowered, lowered[1:]))) / max(1, n - 1),
    ]


def _matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


def leaves(gain: np.ndarray, weight: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """The Newton step of a tree of ``depth`` over ordered bins, as one value per bin."""
    g, h = np.cumsum(gain), np.cumsum(weight)
    if depth and len(g) > 1:
        left = g[:-1] ** 2 / (h[:-1] + ridge) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + ridge)
        k = int(left.argmax()) + 1
        if left[k - 1] > g[-1] ** 2 / (h[-1] + ridge) + 1e-12:
            return np.r_[leaves(gain[:k], weight[:k], depth - 1, ridge), leaves(gain[k:], weight[k:], depth - 1, ridge)]
    return np.full(len(g), g[-1] / (h[-1] + ridge))


def quadrants(gain: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """The Newton step of the best tree that cuts a grid once along either axis, as one value per cell."""
    sums = []
    for grid in (gain, weight):
        c = grid.cumsum(0).cumsum(1)
        corner, row, column = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        sums.append(np.stack([corner, row - corner, column - corner, c[-1, -1] - row - column + corner]))
    g, h = sums
    a, b = np.unravel_index((g**2 / (h + ridge)).sum(0).argmax(), g.shape[1:])
    value = (g / (h + ridge))[:, a, b]
    step = np.empty(gain.shape)
    step[: a + 1, : b + 1], step[: a + 1, b + 1 :], step[a + 1 :, : b + 1], step[a + 1 :, b + 1 :] = value
    return step


def fit_tables(x: np.ndarray, y: np.ndarray, bins: list[int], pairs: int, rounds: int, rate: float = 0.15, coarse: int = 8, ridge: float = 2.0):
    """Lookup tables of binned features ``x``: an intercept, one table per feature, some per pair.

    Boosting is cyclic: every round visits each feature once and adds a shallow tree, fitted to the
    log-loss gradient of that feature's bins, to its table. The pairs whose coarse grids explain
    most of what the features leave are then boosted the same way.
    """
    base = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    intercept = math.log(base / (1 - base))
    score = np.full(len(y), intercept)
    single = [np.zeros(b) for b in bins]
    for _ in range(rounds):
        for f, b in enumerate(bins):
            p = 1 / (1 + np.exp(-score))
            step = rate * leaves(np.bincount(x[:, f], y - p, b), np.bincount(x[:, f], p * (1 - p), b), 2, ridge)
            single[f] += step
            score += step[x[:, f]]
    p = 1 / (1 + np.exp(-score))
    g, h = y - p, p * (1 - p)
    low = [np.minimum(x[:, f] * coarse // b, coarse - 1) for f, b in enumerate(bins)]
    cells = {(i, j): low[i] * coarse + low[j] for i in range(len(bins)) for j in range(i)}
    explains = {k: (np.bincount(c, g, coarse**2) ** 2 / (np.bincount(c, h, coarse**2) + ridge)).sum() for k, c in cells.items()}
    chosen = sorted(explains, key=lambda k: (-explains[k], k))[:pairs]
    double = {k: np.zeros(coarse**2) for k in chosen}
    for _ in range(rounds // 2):
        for k in chosen:
            c = cells[k]
            p = 1 / (1 + np.exp(-score))
            step = quadrants(np.bincount(c, y - p, coarse**2).reshape(coarse, coarse), np.bincount(c, p * (1 - p), coarse**2).reshape(coarse, coarse), ridge)
            double[k] += rate * step.ravel()
            score += rate * step.ravel()[c]
    return intercept, single, double


def train(
    labelled: DataFrame, label_col: str = "label", text_col: str = "text", bins: int = 32, bags: int = 4, pairs: int = 8, rounds: int = 60, coarse: int = 8
) -> dict:
    """Fit the model on ``labelled``: rows of a text and a label of 0 or 1, bounded by the caller.

    Tasks compute the features and Spark their quantiles, the bins' edges. Each of ``bags`` tasks fits
    one model on its bootstrap of the rows; the tables are averaged. Fewer than two classes give
    a model that answers the base rate. Null texts count as empty; rows of null label are left out.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("row"), *(pa.array(x[:, k]) for k in range(len(FEATURES)))], names=["label", "row", *FEATURES])

    rows = labelled.where(F.col(label_col).isNotNull()).select(
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), F.col(label_col).cast("double").alias("label"), F.xxhash64(text_col, label_col).alias("row")
    )
    schema = "label double, row bigint, " + ", ".join(f"{f} double" for f in FEATURES)
    sample = store(short_batches(rows).mapInArrow(measure, schema), "quality-sample")
    cuts = [k / bins for k in range(1, bins)]
    quantiles = sample.agg(*[F.percentile_approx(f, cuts, 2000).alias(f) for f in FEATURES]).first()
    edges = [np.unique(np.array(quantiles[f] or [], np.float64)) for f in FEATURES]
    sizes = [len(e) + 1 for e in edges]

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "label", *FEATURES])
        x = np.stack([np.searchsorted(e, frame[f].to_numpy(), side="right") for e, f in zip(edges, FEATURES, strict=True)], axis=1)
        pick = np.random.default_rng(int(key[0])).integers(0, len(frame), len(frame))
        intercept, single, double = fit_tables(x[pick], frame["label"].to_numpy()[pick], sizes, pairs, rounds, coarse=coarse)
        out = [(-1, -1, 0, intercept)]
        out += [(f, -1, b, float(v)) for f, table in enumerate(single) for b, v in enumerate(table)]
        out += [(i, j, b, float(v)) for (i, j), table in double.items() for b, v in enumerate(table)]
        return pd.DataFrame(out, columns=["i", "j", "bin", "value"])

    fitted = sample.withColumn("bag", F.explode(F.sequence(F.lit(1), F.lit(bags)))).groupBy("bag").applyInPandas(fit, "i int, j int, bin int, value double")
    tables: dict = {}
    for r in fitted.groupBy("i", "j", "bin").agg(F.sum("value").alias("value")).collect():
        k = (r["i"], r["j"])
        table = tables.setdefault(k, np.zeros(1 if k[0] < 0 else sizes[k[0]] if k[1] < 0 else coarse**2))
        table[r["bin"]] = r["value"] / bags
    return {"edges": edges, "tables": tables, "coarse": coarse}


def log_odds(texts: list[bytes], model: dict) -> np.ndarray:
    x, coarse = _matrix(texts), model["coarse"]
    binned = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model["edges"])]
    low = [np.minimum(b * coarse // (len(e) + 1), coarse - 1) for b, e in zip(binned, model["edges"], strict=True)]
    total = np.zeros(len(x))
    for (i, j), table in model["tables"].items():
        total += table[0] if i < 0 else table[binned[i]] if j < 0 else table[low[i] * coarse + low[j]]
    return total


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row: the sum of the bins' table entries as a probability of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = log_odds(batch.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-total)))], names=["doc_id", "score"])

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return short_batches(source).mapInArrow(run, "doc_id bigint, score double").withColumnRenamed("doc_id", id_col)


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", bound: int = 20_000) -> DataFrame:
    """A sample of about 0.95 * ``bound`` labelled rows outside the held-out third, or all if fewer.

    The bound holds however often ids repeat, see :func:`.common.labelled_sample`.
    """
    return labelled_sample(docs, labels.where(~held_out(id_col)), label_col, bound, "quality", id_col, text_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Scores of all rows of ``docs`` under a model learned from ``labels``: id, held_out, score, predicted.

    The score uses the text alone. Empty and null texts are scored like others, by their features.
    Null ids are not held out. Repeated rows get equal scores; an empty table gives no rows. Texts
    are read whole, however long; other columns are not read.
    """
    model = train(training_rows(docs, labels, id_col=id_col, text_col=text_col, **options))
    scored = score(docs, model, id_col, text_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns, whatever their names.

    A row stays if its text's probability of label 1 is a half or more. Null and empty texts are
    judged alike, by their features; ids do not matter, so rows of null or repeated ids and
    repeated rows are judged each. Without labels of both classes every row is judged by the base
    rate. An empty table gives no rows.
    """
    model = train(training_rows(docs, labels, id_col=id_col, text_col=text_col, **options))

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        return pa.array(log_odds(texts.to_pylist(), model) >= 0)

    return short_batches(docs).where(good(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
