"""Readers of price series, market frames and series bundles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.calendar import clip, first_per_date, reindex_business, replay_zscore, standardize, stats, to_date, to_number

#: Column names, in lower and upper case, of dates and prices in published price files.
PRICE_DATES = ("date", "fecha", "observation_date")
PRICES = ("BRENT", "DCOILBRENTEU", "VALUE", "CLOSE")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def read_market_csv(spark: SparkSession, path: str, date_col: str = "date", rename: dict[str, str] | None = None) -> DataFrame:
    """A frame of one date and numbers; what does not parse is null, and rows without a date are left out."""
    raw = _csv(spark, path).withColumnsRenamed(rename or {})
    if date_col not in raw.columns:
        raise ValueError(f"no column {date_col}")
    return raw.select(to_date(date_col).alias("date"), *[to_number(c).alias(c) for c in raw.columns if c != date_col]).where("date is not null")


def read_indexed_csv(spark: SparkSession, path: str) -> DataFrame:
    """A frame whose first column, or else the one named date, is the date."""
    raw = _csv(spark, path)
    first = raw.columns[0]
    bad = raw.where(F.col(f"`{first}`").isNotNull() & to_date(first).isNull()).limit(1).count()
    index = "date" if bad and "date" in raw.columns else first
    if bad and index == first:
        raise ValueError(f"{first} is not a date")
    return raw.select(to_date(index).alias("date"), *[to_number(c).alias(c) for c in raw.columns if c != index]).where("date is not null")


def read_named_values(spark: SparkSession, path: str) -> DataFrame:
    """(feature, value) of a file of two columns."""
    raw = _csv(spark, path)
    if len(raw.columns) < 2:
        raise ValueError("two columns are needed")
    return raw.select(F.col(f"`{raw.columns[0]}`").alias("feature"), to_number(raw.columns[1]).alias("value"))


def load_prices(raw: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, ts, value) on business days, gaps filled forward, from a frame with a known date and price column."""
    date = next((c for c in raw.columns if c.lower() in PRICE_DATES), None)
    price = next((c for c in raw.columns if c.upper() in PRICES), None)
    if date is None or price is None:
        raise ValueError("no date or price column")
    named = raw.select(*keys, to_date(date).alias("ts"), to_number(price).alias("value")).dropna(subset=["ts", "value"])
    if keys:
        return reindex_business(named, list(keys), ["value"])
    return reindex_business(named.withColumn("_one", F.lit(1)), ["_one"], ["value"]).drop("_one")


def merge_series(frames: list[DataFrame], keys: list[str], how: str = "full", ts: str = "date") -> DataFrame:
    """Outer (or ``how``) join of frames by key and time; one row per time."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, [*keys, ts], how)
    return first_per_date(out, keys, [F.xxhash64(*[c for c in out.columns])], ts)


def download_bundle(landed: dict[str, DataFrame], start=None, end=None) -> DataFrame:
    """The standard set of landed series, each standardised under its name, joined by date and clipped."""
    return clip(merge_series([standardize(df, name) for name, df in landed.items()], []), start, end, "date")


@dataclass
class SeriesBundle:
    """A raw frame, its z-scores, a target, and each feature's mean and deviation."""

    raw: DataFrame
    zscore: DataFrame
    target: DataFrame
    features: list[str]
    means: dict[str, float | None] = field(default_factory=dict)
    stds: dict[str, float | None] = field(default_factory=dict)


def load_bundle(raw: DataFrame, target: DataFrame, price: str, means: DataFrame | None = None, stds: DataFrame | None = None, features: list[str] | None = None, target_col: str = "target", ts: str = "date") -> SeriesBundle:
    """Check columns and complete the statistics: missing ones are measured, a deviation of 0 is 1."""
    if price not in raw.columns or target_col not in target.columns:
        raise ValueError("price or target column is missing")
    features = features or [c for c in raw.columns if c != ts]
    if missing := [f for f in features if f not in raw.columns]:
        raise ValueError(f"not in the raw frame: {missing}")
    measured = {r["feature"]: (r["mean"], r["std"]) for r in stats(raw, features).collect()}
    given = lambda df: {r["feature"]: r["value"] for r in df.collect()} if df is not None else {}
    mean, std = given(means), given(stds)
    stored = {f: (mean.get(f), std.get(f)) for f in features}
    z = replay_zscore(raw, stored, measured, "").select(ts, *features)
    pick = lambda k, own: {f: own.get(f) if own.get(f) is not None else measured.get(f, (None, None))[k] for f in features}
    return SeriesBundle(raw, z, target, features, pick(0, mean), {f: v or 1.0 for f, v in pick(1, std).items()})
