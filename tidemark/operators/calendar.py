"""Cleaning, calendars, fills, projections and predicates over series."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan

# Column names under which public data providers ship dates and values, best first.
DATE_NAMES = ("date", "DATE", "observation_date", "TIME_PERIOD", "time_period")
VALUE_NAMES = ("value", "VALUE", "OBS_VALUE", "obs_value")


def to_date(column: str | Column) -> Column:
    """The column as a date; what does not parse is null."""
    return F.try_to_timestamp(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")).cast("date")


def to_number(column: str | Column) -> Column:
    """The column as a finite double; what does not parse, NaN and infinities are null."""
    return finite((F.col(column) if isinstance(column, str) else column).try_cast("double"))


def finite(column: Column) -> Column:
    return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)


def by_time(keys: list[str], ts: str = "ts"):
    return Window.partitionBy(*keys).orderBy(ts)


def standardize(df: DataFrame, value_name: str) -> DataFrame:
    """(date, ``value_name``): the first known date and value columns, dates that parse, sorted by need of the reader."""
    date = next((c for c in DATE_NAMES if c in df.columns), df.columns[0])
    value = next((c for c in (value_name, *VALUE_NAMES) if c in df.columns and c != date), None)
    value = value or next((c for c in df.columns if c != date), None)
    if value is None:
        raise ValueError("no value column")
    return df.select(to_date(date).alias("date"), to_number(value).alias(value_name)).where(F.col("date").isNotNull())


def clip(df: DataFrame, start=None, end=None, ts: str = "ts") -> DataFrame:
    """Rows from ``start`` to ``end``, both included."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start))
    return df if end is None else df.where(F.col(ts) <= F.lit(end))


def first_per_date(df: DataFrame, keys: list[str], tiebreak: list[Column], ts: str = "ts") -> DataFrame:
    """One row per key and time: the first in the order of ``tiebreak``."""
    n = F.row_number().over(Window.partitionBy(*keys, ts).orderBy(*tiebreak))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def business_day(ts: str | Column) -> Column:
    """The date itself from Monday to Friday, else the Friday before."""
    day = (F.col(ts) if isinstance(ts, str) else ts).cast("date")
    return F.date_sub(day, F.greatest(F.lit(0), F.weekday(day) - 4))


def business_calendar(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Every business day between each series' first and last date."""
    spans = df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    return spans.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 day"))).alias(ts)).where(F.weekday(ts) < 5)


def fill_forward(df: DataFrame, keys: list[str], columns: list[str], ts: str = "ts", block: int | None = None) -> DataFrame:
    """Nulls become the last value before them; series longer than ``block`` are filled by ranges, see :mod:`.scan`."""
    return scan.run(df, keys, ts, {c: (scan.LAST, F.col(c)) for c in columns}, block)


def fill_backward(df: DataFrame, keys: list[str], columns: list[str], ts: str = "ts", block: int | None = None) -> DataFrame:
    """Nulls become the next value after them, by ranges as in :func:`fill_forward`."""
    return scan.run(df, keys, ts, {c: (scan.LAST, F.col(c)) for c in columns}, block, backward=True)


def resample_business(df: DataFrame, keys: list[str], columns: list[str], ts: str = "ts", block: int | None = None) -> DataFrame:
    """Business days with each column's last non-null value of the day, gaps filled forward.

    Saturday and Sunday belong to the Friday before, even when that is earlier than the series.
    """
    days = df.withColumn("_bin", business_day(ts)).groupBy(*keys, F.col("_bin")).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in columns]
    )
    days = days.withColumnRenamed("_bin", ts)
    return fill_forward(business_calendar(days, keys, ts).join(days, [*keys, ts], "left"), keys, columns, ts, block)


def reindex_business(df: DataFrame, keys: list[str], columns: list[str], ts: str = "ts", block: int | None = None) -> DataFrame:
    """Business days between a series' first and last date, gaps filled forward; weekend rows are left out."""
    return fill_forward(business_calendar(df, keys, ts).join(df.select(*keys, ts, *columns), [*keys, ts], "left"), keys, columns, ts, block)


def reindex_hourly(df: DataFrame, keys: list[str], columns: list[str], ts: str = "ts", block: int | None = None) -> DataFrame:
    """Every hour between a series' first and last one, gaps filled forward."""
    spans = df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    hours = spans.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 hour"))).alias(ts))
    return fill_forward(hours.join(df.select(*keys, ts, *columns), [*keys, ts], "left"), keys, columns, ts, block)


def infinities_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in columns})


def select_listed(df: DataFrame, wanted: list[str] | None, ts: str = "ts") -> list[str]:
    """The wanted columns that exist, in that order; all but the time if none are asked for."""
    return [c for c in wanted if c in df.columns] if wanted else [c for c in df.columns if c != ts]


def select_matching(df: DataFrame, wanted: list[str] | None = None, keep: list[str] = (), drop: list[str] = (), ts: str = "ts") -> list[str]:
    """As :func:`select_listed`, then those that any of ``keep`` matches, without those any of ``drop`` does."""
    names = select_listed(df, wanted, ts)
    if keep:
        names = [c for c in names if any(re.search(p, c) for p in keep)]
    return [c for c in names if not any(re.search(p, c) for p in drop)]


def prefix_columns(df: DataFrame, columns: list[str], prefix: str = "z__") -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in columns})


def row_index(df: DataFrame, keys: list[str], ts: str = "ts", name: str = "row_idx", block: int | None = None) -> DataFrame:
    """The row's place in its series, from 0; places of series longer than ``block`` are counted by ranges."""
    size = scan.block_of(df, ts, block)
    cut = scan.ranged(df, keys, ts, size) if size else None
    if cut is None:
        return df.withColumn(name, F.row_number().over(by_time(keys, ts)).cast("bigint") - 1)
    return scan.scan(cut, keys, ts, {name: (scan.TOTAL, F.lit(1))}).withColumn(name, F.col(name) - 1).drop(scan.PART)


def stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, std): over the whole frame, sample deviation."""
    long = df.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("feature", "v"))
    return long.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))


def replay_zscore(df: DataFrame, stored: dict[str, tuple[float | None, float | None]], fallback: dict | None = None, prefix: str = "z__") -> DataFrame:
    """(value - mean) / std by stored statistics; missing ones come from ``fallback``, a std of 0 or null is 1."""
    columns = {}
    for c, (mean, std) in stored.items():
        more = (fallback or {}).get(c, (None, None))
        mean, std = (more[0] if mean is None else mean), (more[1] if std is None else std)
        columns[prefix + c] = (F.col(c) - F.lit(0.0 if mean is None else mean)) / F.lit(std or 1.0)
    return df.withColumns(columns)


def complete_window(keys: list[str], columns: list[str], rows: int, ts: str = "ts") -> Column:
    """Whether the last ``rows`` rows exist and have none of the columns null."""
    full = F.lit(1)
    for c in columns:
        full = F.when(F.col(c).isNull(), 0).otherwise(full)
    return F.coalesce(F.sum(full).over(by_time(keys, ts).rowsBetween(1 - rows, 0)) == rows, F.lit(False))


def chunk_with_halo(df: DataFrame, keys: list[str], chunk_rows: int, left: int, right: int, index: str = "row_idx") -> DataFrame:
    """Cut long series into chunks that carry ``left`` and ``right`` neighbour rows.

    Adds ``chunk`` and ``in_chunk``. Operators with bounded frames may then run by (keys, chunk),
    many tasks to a series; rows with ``in_chunk`` false are dropped afterwards.
    """
    at = F.col(index)
    first = F.greatest(F.lit(0), F.floor((at - right) / chunk_rows))
    last = F.floor((at + left) / chunk_rows)
    spread = df.withColumn("chunk", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    return spread.withColumn("in_chunk", F.floor(at / chunk_rows) == F.col("chunk"))
