"""Segmented prefix scans: running operators over series of any length, cut into ranges of bounded rows.

A plain window with an unbounded frame is one task a series. Here a series is cut by quantiles of its
time; windows run inside a range, each range hands on one row, and a scan over those rows, a few for
each series, tells every range what came before it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a range, about; shorter series are one range.
BLOCK = 1_000_000
PART = "_part"
#: Cuts up to this many bytes are broadcast; more are joined as Spark sees fit.
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class Step:
    """An associative step: its aggregate over a window or a group, and how a later part takes an earlier one's result."""

    over: Callable[[Column], Column]
    whole: Callable[[Column, Column, bool], Column]
    join: Callable[[Column, Column], Column]


def _latest(x: Column, at: Column, backward: bool) -> Column:
    when = F.when(x.isNotNull(), F.struct(at))
    return F.min_by(x, when) if backward else F.max_by(x, when)


#: The last value that is not null; going backward, the next one.
LAST = Step(lambda x: F.last(x, ignorenulls=True), _latest, lambda earlier, own: F.coalesce(own, earlier))
MAXIMUM = Step(F.max, lambda x, at, backward: F.max(x), F.greatest)
MINIMUM = Step(F.min, lambda x, at, backward: F.min(x), F.least)
TOTAL = Step(F.sum, lambda x, at, backward: F.sum(x), lambda earlier, own: F.coalesce(own + earlier, own, earlier))


def as_number(df: DataFrame, ts: str) -> Column:
    kind = df.schema[ts].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(ts).cast("bigint")
    return F.unix_micros(F.col(ts).cast("timestamp")) if isinstance(kind, T.TimestampType | T.TimestampNTZType) else F.col(ts)


def block_of(df: DataFrame, ts: str, block: int | None) -> int | None:
    """The rows of a range: as asked, else none for dates, since a calendar bounds such a series, and :data:`BLOCK` for other times."""
    return block or (None if isinstance(df.schema[ts].dataType, T.DateType) else BLOCK)


def alike(left: list[str], right: list[str]) -> Column:
    same = F.lit(True)
    for a, b in zip(left, right, strict=True):
        same = same & F.col(a).eqNullSafe(F.col(b))
    return same


def ranged(df: DataFrame, keys: list[str], ts: str, block: int) -> DataFrame | None:
    """``df`` with the number of the range of time, in its series, that a row falls into; None if no series is longer than ``block``.

    Each long series is cut at its own quantiles, so its ranges hold about ``block`` rows however uneven
    its times are. Rows of one time stay together; those without a time are in the first range.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    most, long = sizes.where(F.col("_n") > block).agg(F.max("_n"), F.count("*")).first()
    if not most:
        return None
    pieces = -(-most // block)
    quantiles = F.percentile_approx(as_number(df, ts), [k / pieces for k in range(1, pieces)], max(10_000, 100 * pieces))
    cuts = df.groupBy(*keys).agg(F.count("*").alias("_n"), quantiles.alias("_cuts")).where(F.col("_n") > block)
    every = F.floor(F.lit(most) / F.col("_n"))  # a shorter series needs fewer of the cuts
    thinned = F.filter("_cuts", lambda c, i: (i + 1) % every == 0)
    cuts = cuts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], thinned.alias("_cuts"))
    if long * pieces * 16 <= BROADCAST_BYTES:
        cuts = F.broadcast(cuts)
    at = as_number(df, ts)
    met = df.join(cuts, alike(keys, [f"_k_{k}" for k in keys]), "left")
    return met.withColumn(PART, F.coalesce(F.size(F.filter("_cuts", lambda c: c < at)), F.lit(0))).drop("_cuts", *[f"_k_{k}" for k in keys])


def scan(df: DataFrame, keys: list[str], ts: str, steps: dict[str, tuple[Step, Column]], backward: bool = False) -> DataFrame:
    """Set columns to running results along ``ts``, or against it, of a table that :func:`ranged` has cut.

    No window holds more than a range or, over the ranges' totals, more than a series has ranges.
    """
    way = F.desc if backward else F.asc
    inside = Window.partitionBy(*keys, PART).orderBy(way(ts)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(way(PART)).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, PART).agg(*[step.whole(x, F.col(ts), backward).alias(f"_t_{c}") for c, (step, x) in steps.items()])
    earlier = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(PART).alias("_k_part"), *[step.over(F.col(f"_t_{c}")).over(before).alias(f"_e_{c}") for c, (step, _) in steps.items()]
    )
    own = df.withColumns({f"_i_{c}": step.over(x).over(inside) for c, (step, x) in steps.items()})
    met = own.join(earlier, alike([*keys, PART], [f"_k_{k}" for k in keys] + ["_k_part"]))
    met = met.withColumns({c: step.join(F.col(f"_e_{c}"), F.col(f"_i_{c}")) for c, (step, _) in steps.items()})
    return met.drop("_k_part", *[f"_k_{k}" for k in keys], *[f"{p}{c}" for c in steps for p in ("_e_", "_i_")])


def run(df: DataFrame, keys: list[str], ts: str, steps: dict[str, tuple[Step, Column]], block: int | None = None, backward: bool = False) -> DataFrame:
    """Set columns to running results of the series: by ranges if one is longer than ``block``, else by a plain window."""
    block = block_of(df, ts, block)
    cut = ranged(df, keys, ts, block) if block else None
    if cut is not None:
        return scan(cut, keys, ts, steps, backward).drop(PART)
    w = Window.partitionBy(*keys).orderBy(F.desc(ts) if backward else F.asc(ts)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: step.over(x).over(w) for c, (step, x) in steps.items()})


def bounded(df: DataFrame, keys: list[str], ts: str, left: int, right: int, apply: Callable[[DataFrame, list[str]], DataFrame], block: int | None = None) -> DataFrame:
    """``apply`` (table, keys) for operators whose frames reach ``left`` rows back and ``right`` ahead, on series of any length.

    Rows are numbered by a scan and cut into chunks with that many neighbours on either side; the
    operator runs by chunk, and what it tells of neighbours is dropped.
    """
    from .calendar import chunk_with_halo, row_index

    block = block_of(df, ts, block)
    if not block:
        return apply(df, keys)
    chunks = chunk_with_halo(row_index(df, keys, ts, "_row", block), keys, block, left, right, "_row")
    return apply(chunks, [*keys, "chunk"]).where("in_chunk").drop("chunk", "in_chunk", "_row")
