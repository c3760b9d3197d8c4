"""Mixing sources to target weights: capped water-filling and seeded repetitions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, WORD, store, weighted_cuts, whole_row


def water_fill(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Targets that share ``total`` by weight, none above ``cap`` times its size.

    Sources above their cap are clamped to it and what they leave is shared anew by weight among
    the others, until none is above. If all are clamped, the total is not reached.
    """
    targets, open_now, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_now:
        weight = sum(weights[i] for i in open_now)
        over = {i for i in open_now if left * weights[i] / weight > cap * sizes[i]} if weight else set()
        if not over:
            for i in open_now:
                targets[i] = left * weights[i] / weight if weight else 0.0
            break
        for i in over:
            targets[i] = float(cap * sizes[i])
            left -= targets[i]
        open_now -= over
    return targets


def cycle_weights(weights: list[float]) -> Callable[[list], list[float]]:
    return lambda names: [weights[i % len(weights)] for i in range(len(names))]


def hashed(docs: DataFrame, seed: int, id_col: str, text_col: str) -> Column:
    """The place of a row in its source's seeded order."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 2)


def source_rates(table: DataFrame, weigh: Callable[[list], list[float]], share: float, max_epochs: float) -> DataFrame:
    """One row per source of a stored table (source, size, hash): target, whole repetitions, and where one more ends.

    It is marked to be broadcast while it is small.
    """
    sums = table.groupBy("source").agg(F.sum("size").alias("size")).collect()
    sums = sorted(sums, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    sizes = [int(r["size"]) for r in sums]
    targets = water_fill(sizes, weigh([r["source"] for r in sums]), share * sum(sizes), max_epochs)
    whole = [math.floor(t / n) if n else 0 for n, t in zip(sizes, targets, strict=True)]
    kind = table.schema["source"].dataType.simpleString()
    # Beyond the bound a shuffle joins them, whose hot sources Spark splits.
    sent = F.broadcast if sum(len(r["source"] or "") + 64 for r in sums) <= BROADCAST_BYTES else lambda df: df
    names = table.sparkSession.createDataFrame([(k, r["source"]) for k, r in enumerate(sums)], f"code int, _source {kind}")
    coded = table.join(sent(names), F.col("source").eqNullSafe(F.col("_source")))
    needs = {k: t - w * n for k, (n, t, w) in enumerate(zip(sizes, targets, whole, strict=True)) if n and t > w * n}
    cuts = weighted_cuts(coded, "code", ["hash"], "size", needs) if needs else {}
    rows = []
    for k, (r, n, t, w) in enumerate(zip(sums, sizes, targets, whole, strict=True)):
        (at, *_), inclusive = cuts.get(k, ([0], False))
        rows.append((r["source"], n, t, w, at + inclusive))
    return sent(table.sparkSession.createDataFrame(rows, f"_source {kind}, source_size bigint, target double, _whole int, _more_below bigint"))


def sizes_table(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return store(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            F.col(source_col).alias("source"),
            hashed(docs, seed, id_col, text_col).alias("hash"),
        ),
        "mix-sizes",
    )


REPEATS = "_whole + cast(hash < _more_below as int)"


def mix_plan(
    docs: DataFrame,
    weigh: Callable[[list], list[float]] = cycle_weights([5, 2, 1]),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How often the mix takes each document: one row per row of ``docs``.

    Sizes are words; a null text has none. Sources are ordered by code point, null last, and get
    the weights ``weigh`` gives for that list. Together they are to give ``share`` times all
    words; :func:`water_fill` sets targets, at most ``max_epochs`` times a source's words. A source
    takes each of its documents floor(target / size) times, and once more those first in the
    order of a seeded hash, up to the point where the words taken come nearest the target. That
    point is found by distributed sums. The same rows and seed give the same mix. Rows alike in
    id and text have the same hash and are taken alike; null and empty texts are taken by the same
    rule, as often as their source's others. Texts count whole, however long. Null ids and sources are values like others; other
    columns are not read; an empty table gives no rows. The driver gets one row a source; they
    are broadcast up to ``BROADCAST_BYTES`` and joined by a shuffle beyond. Returns the id, size, source, source_size, target, repeats, taken.
    """
    table = sizes_table(docs, seed, id_col, text_col, source_col)
    rates = source_rates(table, weigh, share, max_epochs)
    return (
        table.join(rates, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("repeats", F.expr(REPEATS))
        .withColumn("taken", F.col("size") * F.col("repeats"))
        .select(F.col("doc_id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", "repeats", "taken")
    )


def mix(
    docs: DataFrame,
    weigh: Callable[[list], list[float]] = cycle_weights([5, 2, 1]),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mixed corpus: rows of ``docs`` with all their columns, each as often as :func:`mix_plan` says.

    Null, empty and repeated texts, ids and sources are taken as :func:`mix_plan` says, and columns may
    have any names. An empty table gives no rows. A row's hash and its source's rate tell its
    repeats, so no text is moved while the sources are small enough to be broadcast.
    """
    rates = source_rates(sizes_table(docs, seed, id_col, text_col, source_col), weigh, share, max_epochs)
    placed = docs.select(whole_row(docs), F.col(source_col).alias("_mix_source"), hashed(docs, seed, id_col, text_col).alias("hash"))
    times = placed.join(rates, F.col("_mix_source").eqNullSafe(F.col("_source"))).select("_row", F.expr(REPEATS).alias("_times")).where("_times > 0")
    return times.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
