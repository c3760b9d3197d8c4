"""Queries that write given tables by the library's sinks and read them back by its readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import encode, outliers, tables, windows
from tidemark.sources import provider, series, sinks

from .modelling import ENDS, LONG, ends
from .panels import brand_daily, flag_daily, market_wide, predictions, sql
from .registry import query, rounded, single

KEYS = ["series_id"]


def landing(spark, name: str) -> str:
    """A new folder that all executors see, swept with the other tables."""
    path = f"{tables.shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    tables.WRITTEN.append(path)
    return path


def f32(x: str) -> str:
    return f"cast(cast({x} as float) as double)"


@query("s3_market_csv", sql(f"select ts as date, {f32('p_a')} as p_a, {f32('eurusd')} as eurusd from market_wide", "market_wide"))
def s3(spark, sf_dir):
    path = landing(spark, "market-csv")
    market_wide(spark, sf_dir).select(F.col("ts").alias("TIME_PERIOD"), "p_a", "eurusd").write.csv(path, header=True)
    return single(series.read_market_csv(spark, path, rename={"TIME_PERIOD": "date"}))


@query("s4_indexed_csv", sql(f"select ts as date, {f32('p_n')} as p_n, {f32('p_r')} as p_r from market_wide", "market_wide"))
def s4(spark, sf_dir):
    path = landing(spark, "indexed-csv")
    market_wide(spark, sf_dir).select("ts", "p_n", "p_r").write.csv(path, header=True)
    return single(series.read_indexed_csv(spark, path))


@query("s5_named_values", sql("select series_id as feature, round(avg(value), 4) as value from brand_daily group by 1", "brand_daily"))
def s5(spark, sf_dir):
    path = landing(spark, "named-values")
    brand_daily(spark, sf_dir).groupBy("series_id").agg(F.avg("value").alias("0")).write.csv(path, header=True)
    return rounded(series.read_named_values(spark, path), 4)


@query("s3_s10_provider_files", sql(f"select series_id, ts as date, {f32('value')} as value from brand_daily", "brand_daily"))
def provider_files(spark, sf_dir):
    """Every brand's prices as provider files, written and read through the data source."""
    path = landing(spark, "provider")
    provider.write_provider(brand_daily(spark, sf_dir).withColumnRenamed("ts", "date"), path)
    return single(provider.read_provider(spark, path))


@query("s10_window_table", sql(f'{ENDS} select series_id, start, "end", end_date from p', "flag_daily"))
def s10(spark, sf_dir):
    path = landing(spark, "window-table")
    sinks.write_windows(ends(spark, sf_dir), path, KEYS)
    return spark.read.parquet(path)


@query("s12_a9_fold_predictions", sql("select l_orderkey, l_linenumber, probability, case when year(ts) < 1996 then 0 when year(ts) < 1998 then 1 else 2 end as fold_id from predictions", "predictions"))
def s12(spark, sf_dir):
    """Out-of-sample predictions of three folds, each a table of its own, as one."""
    path = landing(spark, "fold-predictions")
    rows = predictions(spark, sf_dir).select("l_orderkey", "l_linenumber", "probability", F.when(F.year("ts") < 1996, 0).when(F.year("ts") < 1998, 1).otherwise(2).alias("fold_id"))
    sinks.write_folds([rows.where(F.col("fold_id") == k) for k in range(3)], path, "l_orderkey")
    return spark.read.parquet(path)


@query("s13_templates", sql(f"{LONG} select label, metric, round(avg(v), 5) as mean, round(case when stddev_pop(v) <= 1e-8 then 1 else stddev_pop(v) end, 5) as std from u group by 1, 2", "predictions"))
def s13(spark, sf_dir):
    path = landing(spark, "templates")
    sinks.write_templates(outliers.fit_templates(predictions(spark, sf_dir), ["probability", "forecast", "outcome"], "truth"), path)
    return rounded(spark.read.json(path), 5)


@query("s15_encoded_windows", sql("""n as (select series_id, ts, row_number() over (partition by series_id order by ts) as rn, list(value) over (partition by series_id order by ts rows between 31 preceding and current row) as p from flag_daily),
    w as (select * from n where rn >= 32), u as (select series_id, ts, list_transform(p, lambda x: 2 * (x - list_min(p)) / (list_max(p) - list_min(p)) - 1) as c from w)
    select series_id, ts, unnest(generate_series(0, 31))::int as pixel, cast(cast(unnest(c) as float) as double) + 0 as value from u""", "flag_daily"))
def s15(spark, sf_dir):
    """Windows encoded in two runs over a growing table: the second encodes only those that are new."""
    path = landing(spark, "encoded-windows")
    rows = windows.sliding(flag_daily(spark, sf_dir), KEYS).select("series_id", "ts", "prices")
    scaled = lambda df: encode.encode(df, "scaled").drop("prices")
    for part in (rows.where("ts < '1998-01-01'"), rows):
        sinks.encode_unseen(part, ["series_id", "ts"], path, encode.config_hash("scaled", 32), scaled)
    found = sinks.read_encoded(spark, path, encode.config_hash("scaled", 32))
    return found.select("series_id", "ts", F.posexplode("image").alias("pixel", "value")).withColumn("value", F.col("value").cast("double") + 0.0)


@query("s16_report_sheets", sql("select truth, predicted, count(*) as n from predictions group by 1, 2", "predictions"))
def s16(spark, sf_dir):
    path = landing(spark, "report")
    sinks.write_report({"confusion": predictions(spark, sf_dir).groupBy("truth", "predicted").agg(F.count("*").alias("n"))}, path)
    return spark.read.csv(f"{path}/confusion", header=True, schema="truth string, predicted string, n bigint")
