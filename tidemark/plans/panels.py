"""Price panels derived from the given tables, and the same panels as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flag_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean unit price of each return flag and ship date."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").cast("date").alias("ts"))
        .agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("value"))
    )


def brand_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean unit price of each brand and ship date; days without sales are missing."""
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("series_id"), F.col("l_shipdate").cast("date").alias("ts"))
        .agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("value"))
    )


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("ts"))
        .agg(F.avg("o_totalprice").alias("value"))
    )


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("ts"))
        .agg(F.avg("value").alias("value"))
    )


def market_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a day: the price of each flag, the mean discount as a rate, the mean tax as a level."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_shipdate").cast("date").alias("ts"))
        .agg(
            *[
                (F.sum(F.when(F.col("l_returnflag") == f, F.col("l_extendedprice"))) / F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")))).alias(f"p_{f.lower()}")
                for f in "ANR"
            ],
            (1 + F.avg("l_discount")).alias("eurusd"),
            (100 + F.avg("l_tax") * 100).alias("inflation"),
        )
        .withColumn("series_id", F.lit("market"))
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth, probability, forecast and outcome of line items, without a model."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("truth"),
        F.when(F.col("l_discount") < 0.03, "A").when(F.col("l_discount") < 0.07, "N").otherwise("R").alias("predicted"),
        (F.col("l_linestatus") == "F").cast("int").alias("actual"),
        F.round((F.col("l_discount") * 7 + F.col("l_tax") * 3 + F.col("l_quantity") / 100) / 2, 3).alias("probability"),
        F.round(F.col("l_tax") - F.col("l_discount"), 4).alias("forecast"),
        F.round(F.ln(F.col("l_extendedprice") / F.col("l_quantity") / 2000) / 10, 6).alias("outcome"),
        F.col("l_shipdate").cast("date").alias("ts"),
        F.col("l_returnflag").alias("series_id"),
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
    )


#: The same panels for SQL, each a WITH item.
SQL = {
    "flag_daily": """flag_daily as (select l_returnflag as series_id, cast(l_shipdate as date) as ts,
        sum(l_extendedprice) / sum(l_quantity) as value from lineitem group by 1, 2)""",
    "brand_daily": """brand_daily as (select p_brand as series_id, cast(l_shipdate as date) as ts,
        sum(l_extendedprice) / sum(l_quantity) as value from lineitem join part on l_partkey = p_partkey group by 1, 2)""",
    "orders_daily": """orders_daily as (select o_orderpriority as series_id, cast(o_orderdate as date) as ts,
        avg(o_totalprice) as value from orders group by 1, 2)""",
    "events_hourly": """events_hourly as (select event_type as series_id, date_trunc('hour', ts) as ts,
        avg(value) as value from events group by 1, 2)""",
    "market_wide": """market_wide as (select 'market' as series_id, cast(l_shipdate as date) as ts,
        sum(l_extendedprice) filter (where l_returnflag = 'A') / sum(l_quantity) filter (where l_returnflag = 'A') as p_a,
        sum(l_extendedprice) filter (where l_returnflag = 'N') / sum(l_quantity) filter (where l_returnflag = 'N') as p_n,
        sum(l_extendedprice) filter (where l_returnflag = 'R') / sum(l_quantity) filter (where l_returnflag = 'R') as p_r,
        cast(1 as double) + avg(l_discount) as eurusd, cast(100 as double) + avg(l_tax) * 100 as inflation
        from lineitem group by 2)""",
    "predictions": """predictions as (select l_returnflag as truth,
        case when l_discount < 0.03 then 'A' when l_discount < 0.07 then 'N' else 'R' end as predicted,
        cast(l_linestatus = 'F' as int) as actual,
        round((l_discount * 7 + l_tax * 3 + l_quantity / 100) / 2, 3) as probability,
        round(l_tax - l_discount, 4) as forecast,
        round(ln(l_extendedprice / l_quantity / 2000) / 10, 6) as outcome,
        cast(l_shipdate as date) as ts, l_returnflag as series_id, l_orderkey, l_linenumber, l_suppkey from lineitem)""",
}


def sql(body: str, *names: str) -> str:
    """``body`` behind the WITH items it needs."""
    return "with " + ",\n".join(SQL[n] for n in names) + ("\n" if body.lstrip().lower().startswith("select") else ",\n") + body
