"""The latest signal of each series, kept up to date from a stream of prices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions import patterns
from tidemark.operators.windows import inference_windows, label
from tidemark.sources.sinks import latest_rows


def latest_signals(history: DataFrame, keys: list[str], value: str = "value", lookback: int = 32, threshold: float = 0.30, ts: str = "ts") -> DataFrame:
    """Label and confidence of each series' last window."""
    last = latest_rows(inference_windows(history, keys, value, lookback, ts=ts), keys)
    return label(last, threshold).select(*keys, "end_date", "price", "label", "confidence")


def start(stream: DataFrame, keys: list[str], folder: str, lookback: int = 32, ts: str = "ts", watermark: str = "7 days", **trigger) -> StreamingQuery:
    """Append each micro-batch, without repeated rows within the watermark, to ``folder``/prices, and the
    latest signals of the series it touches to ``folder``/signals; see :func:`current`.

    Frames of rows are not for streams, so ``folder``/state holds the last ``lookback`` rows of every series. A
    batch reads the state before it, never the prices, and writes the one after it; the two take
    turns, so a batch that is run again finds what it started from and overwrites what it wrote.
    A row that comes later than the last ``lookback`` of its series enters the prices only.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{folder}/prices/batch={batch_id}")
        known = batch
        if batch_id:
            known = spark.read.schema(batch.schema).parquet(f"{folder}/state/turn={(batch_id - 1) % 2}").unionByName(batch).dropDuplicates([*keys, ts])
        touched = known.join(batch.select(*keys).distinct(), keys, "left_semi")
        latest_signals(touched, keys, lookback=lookback, ts=ts).write.mode("overwrite").parquet(f"{folder}/signals/batch={batch_id}")
        newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ts)))
        known.withColumn("_n", newest).where(F.col("_n") <= lookback).drop("_n").write.mode("overwrite").parquet(f"{folder}/state/turn={batch_id % 2}")

    unique = stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([*keys, ts])
    return unique.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The last signal written for each series."""
    return latest_rows(spark.read.parquet(f"{folder}/signals"), keys, "batch").drop("batch")


def keyed_signals(stream: DataFrame, keys: list[str], value: str = "value", lookback: int = 32, threshold: float = 0.30, ts: str = "ts", watermark: str = "7 days") -> DataFrame:
    """The latest signal of each series that a micro-batch touches, as a stream: keys, end_date, price, label, confidence.

    Each series' last ``lookback`` rows are its state in Spark's state store, so a batch reads and writes
    the series that it has rows of and no others. Rows repeated within the watermark count once; one
    that comes later than the last ``lookback`` of its series changes nothing. A series is told of once
    it has so many rows, none without a value.
    """
    unique = stream.select(*keys, F.col(ts).cast("timestamp").alias("_ts"), F.col(value).cast("double").alias("_v")).withWatermark("_ts", watermark).dropDuplicatesWithinWatermark([*keys, "_ts"])

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        for frame in frames:
            for t, v in zip(frame["_ts"].to_numpy().astype("datetime64[us]").astype(np.int64).tolist(), frame["_v"].tolist(), strict=True):
                held.setdefault(t, v)
        times = sorted(held)[-lookback:]
        values = [held[t] for t in times]
        state.update((times, values))
        if len(times) == lookback and not np.isnan(np.array(values, float)).any():
            scores = patterns.scores(np.array([values], float))[0]
            name = patterns.PATTERNS[int(scores.argmax())] if scores.max() >= threshold else patterns.UNCLASSIFIED
            yield pd.DataFrame([[*key, pd.Timestamp(times[-1], unit="us"), values[-1], name, float(scores.max())]], columns=[*keys, "end_date", "price", "label", "confidence"])

    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, end_date timestamp, price double, label string, confidence double"
    return unique.groupBy(*keys).applyInPandasWithState(step, schema, "times array<bigint>, prices array<double>", "append", GroupStateTimeout.NoTimeout)


def start_keyed(stream: DataFrame, keys: list[str], folder: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """Append :func:`keyed_signals` to ``folder``/signals; see :func:`newest` for each series' last one."""
    signals = keyed_signals(stream, keys, **options).writeStream.format("parquet").option("path", f"{folder}/signals").option("checkpointLocation", f"{folder}/checkpoint")
    return signals.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def newest(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The signal of the latest end date for each series."""
    return latest_rows(spark.read.parquet(f"{folder}/signals"), keys, "end_date")
