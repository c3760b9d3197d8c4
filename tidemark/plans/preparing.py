"""Queries over sources, calendars, features, windows and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import arrays, patterns
from tidemark.operators import calendar as cal
from tidemark.operators import encode, features, scan, windows
from tidemark.sources import series, sinks

from . import shapes
from .panels import brand_daily, events_hourly, flag_daily, market_wide, orders_daily, sql, table
from .registry import query, rounded, single

KEYS = ["series_id"]
#: Rows of a range where queries run by ranges: few, so that the given tables' series have several.
RANGE = 500
R = features.Rolling(KEYS)
W = "over (partition by series_id order by ts)"


def f32(x: str) -> str:
    return f"cast(cast({x} as float) as double)"


def over(rows: int) -> str:
    return f"over (partition by series_id order by ts rows between {rows - 1} preceding and current row)"


def raw_orders(spark, sf_dir):
    """Orders as a provider's text file would have them, with bad dates and numbers."""
    return table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 11 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("observation_date"),
        F.when(F.col("o_orderkey") % 7 == 0, "n/a").when(F.col("o_orderkey") % 13 == 0, "NaN").otherwise(F.col("o_orderkey").cast("string")).alias("OBS_VALUE"),
    )


RAW_ORDERS = """raw_orders as (select case when o_orderkey % 11 = 0 then 'not a date' else strftime(o_orderdate, '%Y-%m-%d') end as d,
    case when o_orderkey % 7 = 0 then 'n/a' when o_orderkey % 13 = 0 then 'NaN' else cast(o_orderkey as varchar) end as v from orders)"""


@query("s1_standardize_series", f"with {RAW_ORDERS} select try_cast(d as date) as date, case when v = 'NaN' then null else try_cast(v as double) end as price from raw_orders where try_cast(d as date) is not null")
def s1(spark, sf_dir):
    return cal.standardize(raw_orders(spark, sf_dir), "price")


@query("s2_date_range", sql(f"select * exclude (value), {f32('value')} as value from flag_daily where ts between date '1996-03-01' and date '1996-06-30'", "flag_daily"))
def s2(spark, sf_dir):
    return single(cal.clip(flag_daily(spark, sf_dir), "1996-03-01", "1996-06-30"))


@query("s6_load_prices", f"""with p as (select cast(o_orderdate as date) as ts, avg(o_totalprice) as v from orders group by 1),
    c as (select cast(unnest(generate_series(min(ts), max(ts), interval 1 day)) as date) as ts from p)
    select ts, {f32("last_value(v ignore nulls) over (order by ts)")} as value from c left join p using (ts) where isodow(ts) < 6""")
def s6(spark, sf_dir):
    daily = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("fecha")).agg(F.avg("o_totalprice").alias("Close"))
    return single(series.load_prices(daily))


@query("s7_bundle_zscores", sql("""m as (select avg(p_a) ma, stddev_samp(p_a) sa, avg(p_n) mn, stddev_samp(p_n) sn, avg(p_r) mr from market_wide)
    select ts as date, round((p_a - ma) / sa, 6) as p_a, round((p_n - 1500) / sn, 6) as p_n, round(p_r - mr, 6) as p_r from market_wide, m""", "market_wide"))
def s7(spark, sf_dir):
    wide = market_wide(spark, sf_dir).select(F.col("ts").alias("date"), "p_a", "p_n", "p_r")
    means = spark.createDataFrame([("p_n", 1500.0)], "feature string, value double")
    stds = spark.createDataFrame([("p_r", 0.0)], "feature string, value double")
    bundle = series.load_bundle(wide, wide.withColumn("target", F.lit(0.0)), "p_a", means, stds, ["p_a", "p_n", "p_r"])
    return rounded(bundle.zscore)


@query("s8_download_bundle", sql(f"""select ts as date, {f32("max(value) filter (where series_id = 'A')")} as first, {f32("max(value) filter (where series_id = 'R')")} as second,
    {f32("max(value) filter (where series_id = 'N')")} as third from flag_daily where ts <= date '2000-12-31' group by 1""", "flag_daily"))
def s8(spark, sf_dir):
    daily = flag_daily(spark, sf_dir)
    landed = {n: daily.where(F.col("series_id") == f).select(F.col("ts").alias("date"), "value") for n, f in (("first", "A"), ("second", "R"), ("third", "N"))}
    return single(series.download_bundle(landed, end="2000-12-31"))


@query("s11_latest_row", sql(f"select series_id, max(ts) as ts, {f32('arg_max(value, ts)')} as value from brand_daily group by 1", "brand_daily"))
def s11(spark, sf_dir):
    return single(sinks.latest_rows(brand_daily(spark, sf_dir), KEYS, "ts"))


@query("t1_coerce", f"with {RAW_ORDERS} select count(try_cast(d as date)) as dates, count(case when v = 'NaN' then null else try_cast(v as double) end) as numbers, count(*) as n from raw_orders")
def t1(spark, sf_dir):
    raw = raw_orders(spark, sf_dir)
    return raw.agg(F.count(cal.to_date("observation_date")).alias("dates"), F.count(cal.to_number("OBS_VALUE")).alias("numbers"), F.count("*").alias("n"))


@query("t2_dedupe_by_date", "select o_orderpriority as series_id, cast(o_orderdate as date) as ts, min(o_orderkey) as o_orderkey from orders group by 1, 2")
def t2(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("ts"), "o_orderkey")
    return cal.first_per_date(rows, KEYS, [F.col("o_orderkey")])


BIN = shapes.BIN
CALENDAR = """c as (select series_id, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as ts from (select series_id, min(ts) lo, max(ts) hi from b group by 1))"""


@query("t3_resample_business", sql(f"""b as (select series_id, {BIN} as ts, arg_max(value, ts) as value from brand_daily group by 1, 2), {CALENDAR}
    select series_id, ts, {f32(f'last_value(value ignore nulls) {W}')} as value from c left join b using (series_id, ts) where isodow(ts) < 6""", "brand_daily"))
def t3(spark, sf_dir):
    return single(cal.resample_business(brand_daily(spark, sf_dir), KEYS, ["value"], block=RANGE))


@query("t4_reindex_business", sql(f"""b as (select * from brand_daily), {CALENDAR}
    select series_id, ts, {f32(f'last_value(value ignore nulls) {W}')} as value from (select c.series_id, c.ts, value from c left join b using (series_id, ts) where isodow(c.ts) < 6)""", "brand_daily"))
def t4(spark, sf_dir):
    return single(cal.reindex_business(brand_daily(spark, sf_dir), KEYS, ["value"], block=RANGE))


@query("t4_reindex_hourly", sql(f"""c as (select series_id, unnest(generate_series(lo, hi, interval 1 hour)) as ts from (select series_id, min(ts) lo, max(ts) hi from events_hourly group by 1))
    select series_id, ts, {f32(f'last_value(value ignore nulls) {W}')} as value from c left join events_hourly using (series_id, ts)""", "events_hourly"))
def t4h(spark, sf_dir):
    return single(cal.reindex_hourly(events_hourly(spark, sf_dir), KEYS, ["value"], block=RANGE))


@query("t5_fill", sql(f"""g as (select series_id, ts, case when day(ts) % 3 <> 0 then value end as value from flag_daily)
    select series_id, ts, {f32(f'last_value(value ignore nulls) {W}')} as forward,
    {f32('first_value(value ignore nulls) over (partition by series_id order by ts rows between current row and unbounded following)')} as backward from g""", "flag_daily"))
def t5(spark, sf_dir):
    gaps = flag_daily(spark, sf_dir).withColumn("forward", F.when(F.dayofmonth("ts") % 3 != 0, F.col("value"))).withColumn("backward", F.col("forward")).drop("value")
    return single(cal.fill_backward(cal.fill_forward(gaps, KEYS, ["forward"], block=RANGE), KEYS, ["backward"], block=RANGE))


@query("t6_infinity_to_null", "select o_orderkey, case when o_orderkey % 5 = 0 then null else round(o_totalprice, 2) end as x from orders")
def t6(spark, sf_dir):
    x = F.when(F.col("o_orderkey") % 5 == 0, F.lit("Infinity").cast("double")).otherwise(F.round("o_totalprice", 2))
    return cal.infinities_to_null(table(spark, sf_dir, "orders").select("o_orderkey", x.alias("x")), ["x"])


@query("t8_rename_target", sql(f"select series_id, ts, {f32('p_n')} as value, {f32('eurusd')} as eurusd from market_wide", "market_wide"))
def t8(spark, sf_dir):
    return single(features.rename_target(market_wide(spark, sf_dir).select("series_id", "ts", "p_n", "eurusd"), "p_n"))


@query("t9_t10_select_features", sql(f"select ts, {f32('p_a')} as z__p_a, {f32('p_r')} as z__p_r from market_wide", "market_wide"))
def t10(spark, sf_dir):
    wide = market_wide(spark, sf_dir)
    names = cal.select_matching(wide, None, keep=["^p_", "eur"], drop=["_n$", "^eur"])
    return single(cal.prefix_columns(wide.select("ts", *names), names))


@query("t12_row_index", sql(f"select series_id, ts, row_number() {W} - 1 as row_idx from brand_daily", "brand_daily"))
def t12(spark, sf_dir):
    return cal.row_index(brand_daily(spark, sf_dir), KEYS, block=RANGE).drop("value").withColumn("row_idx", F.col("row_idx").cast("bigint"))


@query("t13_replay_zscore", sql("select ts, round((p_a - 1500) / 20, 6) as z__p_a, round(p_n - 1490, 6) as z__p_n from market_wide", "market_wide"))
def t13(spark, sf_dir):
    z = cal.replay_zscore(market_wide(spark, sf_dir), {"p_a": (1500.0, 20.0), "p_n": (None, 0.0)}, {"p_n": (1490.0, None)})
    return rounded(z.select("ts", "z__p_a", "z__p_n"))


@query("t14_complete_windows", sql(f"""g as (select series_id, ts, case when day(ts) <> 13 then value end as value from flag_daily)
    select series_id, ts, count(value) {over(20)} = 20 as complete from g""", "flag_daily"))
def t14(spark, sf_dir):
    gaps = flag_daily(spark, sf_dir).withColumn("value", F.when(F.dayofmonth("ts") != 13, F.col("value")))
    return gaps.select("series_id", "ts", cal.complete_window(KEYS, ["value"], 20).alias("complete"))


RETURNS = f"r as (select *, ln(value) - lag(ln(value)) {W} as lr from brand_daily)"


def returns(spark, sf_dir):
    return brand_daily(spark, sf_dir).withColumn("lr", R.log_return(F.col("value")))


def least(agg: str, x: str, n: int, mp: int) -> str:
    return f"case when count({x}) {over(n)} >= {mp} then {agg}({x}) {over(n)} end"


@query("w1_log_return", sql(f"{RETURNS} select series_id, ts, round(lr, 6) as lr from r", "brand_daily"))
def w1(spark, sf_dir):
    return rounded(returns(spark, sf_dir).drop("value"))


@query("w2_percent_change", sql(f"select series_id, ts, round(value / lag(value, 1) {W} - 1, 6) as c1, round(value / lag(value, 21) {W} - 1, 6) as c21, round(value / lag(value, 126) {W} - 1, 6) as c126 from brand_daily", "brand_daily"))
def w2(spark, sf_dir):
    return rounded(brand_daily(spark, sf_dir).select("series_id", "ts", R.change(F.col("value")).alias("c1"), R.change(F.col("value"), 21).alias("c21"), R.change(F.col("value"), 126).alias("c126")))


@query("w3_rolling_std", sql(f"{RETURNS} select series_id, ts, round({least('stddev_pop', 'lr', 10, 5)}, 6) as s10, round({least('stddev_pop', 'lr', 20, 10)}, 6) as s20 from r", "brand_daily"))
def w3(spark, sf_dir):
    lr = F.col("lr")
    return rounded(returns(spark, sf_dir).select("series_id", "ts", R.std(lr, 10, 5).alias("s10"), R.std(lr, 20, 10).alias("s20")))


@query("w4_rolling_mean", sql(f"select series_id, ts, round({least('avg', 'value', 10, 5)}, 4) as m10, round({least('avg', 'value', 30, 10)}, 4) as m30 from brand_daily", "brand_daily"))
def w4(spark, sf_dir):
    return rounded(brand_daily(spark, sf_dir).select("series_id", "ts", R.mean(F.col("value"), 10, 5).alias("m10"), R.mean(F.col("value"), 30, 10).alias("m30")), 4)


@query("w5_moving_average_gap", sql(f"select series_id, ts, round(value / {least('avg', 'value', 10, 5)} - 1, 6) as g10, round(value / {least('avg', 'value', 30, 10)} - 1, 6) as g30 from brand_daily", "brand_daily"))
def w5(spark, sf_dir):
    return rounded(brand_daily(spark, sf_dir).select("series_id", "ts", R.gap(F.col("value"), 10, 5).alias("g10"), R.gap(F.col("value"), 30, 10).alias("g30")))


@query("w6_drawdown", sql(f"select series_id, ts, {f32(least('max', 'value', 60, 10))} as peak, round(value / {least('max', 'value', 60, 10)} - 1, 6) as drawdown from brand_daily", "brand_daily"))
def w6(spark, sf_dir):
    def drawdown(df, keys):
        r = features.Rolling(keys)
        return df.withColumns({"peak": r.maximum(F.col("value"), 60, 10), "drawdown": r.drawdown(F.col("value"))}).drop("value")

    out = scan.bounded(brand_daily(spark, sf_dir), KEYS, "ts", 59, 0, drawdown, RANGE)
    return out.withColumns({"peak": F.col("peak").cast("float").cast("double"), "drawdown": F.round("drawdown", 6)})


@query("w7_rolling_zscore", sql(f"select series_id, ts, round((value - {least('avg', 'value', 20, 5)}) / nullif({least('stddev_pop', 'value', 20, 5)}, 0), 5) as z from brand_daily", "brand_daily"))
def w7(spark, sf_dir):
    return rounded(brand_daily(spark, sf_dir).select("series_id", "ts", R.zscore(F.col("value"), 20).alias("z")), 5)


PAIR = f"q as (select series_id, ts, ln(p_a) - lag(ln(p_a)) {W} as a, ln(eurusd) - lag(ln(eurusd)) {W} as b, inflation from market_wide)"


def pair(spark, sf_dir):
    wide = market_wide(spark, sf_dir)
    return wide.select("series_id", "ts", R.log_return(F.col("p_a")).alias("a"), R.log_return(F.col("eurusd")).alias("b"), "inflation")


@query("w8_rolling_correlation", sql(f"{PAIR} select ts, round(case when count(case when a is not null and b is not null then 1 end) {over(20)} >= 10 then corr(a, b) {over(20)} end, 5) as c from q", "market_wide"))
def w8(spark, sf_dir):
    return rounded(pair(spark, sf_dir).select("ts", R.correlation(F.col("a"), F.col("b")).alias("c")), 5)


@query("w9_return_spread", sql(f"{PAIR}, s as (select *, a - b as d from q) select ts, round(d, 6) as spread, round((d - {least('avg', 'd', 20, 5)}) / nullif({least('stddev_pop', 'd', 20, 5)}, 0), 5) as z from s", "market_wide"))
def w9(spark, sf_dir):
    s = pair(spark, sf_dir).withColumn("d", F.col("a") - F.col("b"))
    return s.select("ts", F.round("d", 6).alias("spread"), F.round(R.zscore(F.col("d"), 20), 5).alias("z"))


@query("w10_real_return", sql(f"{PAIR} select ts, round(a - coalesce(inflation / lag(inflation, 21) {W} - 1, 0) / 21, 6) as real_return from q", "market_wide"))
def w10(spark, sf_dir):
    out = pair(spark, sf_dir).select("ts", (F.col("a") - F.coalesce(R.change(F.col("inflation"), 21), F.lit(0.0)) / 21).alias("real_return"))
    return rounded(out)


@query("w11_w12_features_alone", sql(f"""{RETURNS} select series_id, ts, round(lr, 6) as real_return, 0.0::double as spread_zscore, round({least('stddev_pop', 'lr', 20, 10)}, 6) as vol_20
    from (select *, row_number() {W} as rn from r) r qualify rn > 10""", "brand_daily"))
def w11(spark, sf_dir):
    out = features.market_features(brand_daily(spark, sf_dir), KEYS, warmup="drop")
    return rounded(out.select("series_id", "ts", "real_return", "spread_zscore", "vol_20"))


@query("w12_feature_set", sql(f"""g as (select ts, series_id, last_value(p_a ignore nulls) {W} as p_a, inflation from market_wide), f as (select ts, series_id, p_a, ln(p_a) - lag(ln(p_a)) {W} as lr, row_number() {W} as rn, inflation from g)
    select ts, round(lr, 6) as log_return, round({least('avg', 'p_a', 30, 10)}, 4) as ma_30, round(p_a / {least('max', 'p_a', 60, 10)} - 1, 6) as drawdown_60,
    round(inflation / lag(inflation, 126) {W} - 1, 6) as inflation_126 from f qualify rn > 126""", "market_wide"))
def w12(spark, sf_dir):
    out = features.market_features(market_wide(spark, sf_dir), KEYS, "p_a", "eurusd", "inflation", warmup="drop")
    return out.select("ts", F.round("log_return", 6).alias("log_return"), F.round("ma_30", 4).alias("ma_30"), F.round("drawdown_60", 6).alias("drawdown_60"), F.round("inflation_126", 6).alias("inflation_126"))


@query("w12_feature_set_backfilled", sql(f"""f as (select ts, series_id, inflation / lag(inflation, 126) {W} - 1 as i from market_wide)
    select ts, round(coalesce(i, first_value(i ignore nulls) over (partition by series_id order by ts rows between current row and unbounded following)), 6) as inflation_126 from f""", "market_wide"))
def w12b(spark, sf_dir):
    out = features.market_features(market_wide(spark, sf_dir), KEYS, "p_a", "eurusd", "inflation")
    return rounded(out.select("ts", "inflation_126"))


@query("w13_volatility_spike", sql(f"""{RETURNS}, b as (select *, {least('stddev_pop', 'lr', 20, 5)} as base from r)
    select series_id, ts, round(coalesce(base / ({least('avg', 'base', 20, 5)} + 1e-8), 1.0), 5) as spike from b""", "brand_daily"))
def w13(spark, sf_dir):
    base, ratio = R.spike(F.col("lr"), 20)
    return rounded(returns(spark, sf_dir).withColumn("base", base).select("series_id", "ts", ratio(F.col("base")).alias("spike")), 5)


@query("w14_average_range", sql(f"""s as (select *, coalesce(abs(value - lag(value) {W}), 0) as step from brand_daily)
    select series_id, ts, round(avg(step) {over(14)}, 4) as atr from s""", "brand_daily"))
def w14(spark, sf_dir):
    step, average = R.average_range(F.col("value"))
    return rounded(brand_daily(spark, sf_dir).withColumn("step", step).select("series_id", "ts", average(F.col("step")).alias("atr")), 4)


@query("w15_equity", sql(f"""c as (select series_id, ts, (value - 1500) / 15000 as ret from flag_daily), e as (select *, exp(sum(ln(1 + ret)) {W}) as equity from c)
    select series_id, ts, round(equity, 5) as equity, round(max(equity) {W}, 5) as peak, round(equity / max(equity) {W} - 1, 5) as drawdown from e""", "flag_daily"))
def w15(spark, sf_dir):
    rows = flag_daily(spark, sf_dir).select("series_id", "ts", ((F.col("value") - 1500) / 15000).alias("ret"))
    return rounded(features.equity(rows, KEYS, "ret").drop("ret"), 5)


@query("w16_forward_flag", sql("""select series_id, ts, coalesce(max(cast(day(ts) = 1 as int)) over (partition by series_id order by ts rows between 1 following and 5 following), 0) as soon from flag_daily""", "flag_daily"))
def w16(spark, sf_dir):
    flag = (F.dayofmonth("ts") == 1).cast("int")
    return flag_daily(spark, sf_dir).withColumn("f", flag).select("series_id", "ts", R.upcoming_flag(F.col("f"), 5).alias("soon"))


AHEAD = "over (partition by series_id order by ts rows between 1 following and 10 following)"


@query("w17_future_targets", sql(f"""select series_id, ts, round(lead(value, 5) {W} / value - 1, 6) as future_return,
    case when count(value) {AHEAD} = 10 then round(min(value) {AHEAD} / value - 1, 6) end as support_ratio,
    case when count(value) {AHEAD} = 10 then round(max(value) {AHEAD} / value - 1, 6) end as resistance_ratio from brand_daily""", "brand_daily"))
def w17(spark, sf_dir):
    return rounded(features.future_targets(brand_daily(spark, sf_dir), KEYS, "value", 5, 10).select("series_id", "ts", "future_return", "support_ratio", "resistance_ratio"))


@query("w20_latest_starters", sql("""select feature, min(ts) filter (where v is not null) as first_valid from (
    unpivot (select ts, p_a, case when ts >= date '1997-01-01' then p_n end as p_n, case when ts >= date '1999-01-01' then p_r end as p_r from market_wide)
    on p_a, p_n, p_r into name feature value v) group by 1 order by 2 desc limit 2""", "market_wide"))
def w20(spark, sf_dir):
    wide = market_wide(spark, sf_dir).select(
        "ts", "p_a", F.when(F.col("ts") >= "1997-01-01", F.col("p_n")).alias("p_n"), F.when(F.col("ts") >= "1999-01-01", F.col("p_r")).alias("p_r")
    )
    return features.latest_starters(wide, ["p_a", "p_n", "p_r"], 2)


def business(spark, sf_dir):
    return cal.resample_business(brand_daily(spark, sf_dir), KEYS, ["value"])


def placed(df, *more):
    """A window's place and price, and more columns, rounded."""
    place = [F.col(c).cast("bigint").alias(c) for c in ("start", "end")]
    price = F.col("price").cast("float").cast("double").alias("price")
    return df.select("series_id", *place, "end_date", price, *[F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in df.select(*more).dtypes])


SCORED = [*[f"score_{p}" for p in patterns.PATTERNS], "confidence", "label", "pattern_idx"]
TARGETS = ["future_return", "support_ratio", "resistance_ratio"]
TARGET_SQL = """round(future_return, 5) as future_return, round(support_price / price - 1, 5) as support_ratio, round(resistance_price / price - 1, 5) as resistance_ratio,
    cast(cast(support_price as float) as double) as support_price, cast(cast(resistance_price as float) as double) as resistance_price"""


@query("l1_window_table", sql(f"{shapes.shapes('brand_daily', 0.35)} select {shapes.PLACE}, {shapes.LABELLED}, {shapes.rounds(shapes.METRICS, 5)}, {TARGET_SQL} from indexed where {shapes.TRAINED}", "brand_daily"))
def l1(spark, sf_dir):
    prices = ("support_price", "resistance_price")
    rows = windows.training_windows(business(spark, sf_dir), KEYS).withColumns({c: F.col(c).cast("float") for c in prices})
    return placed(rows, *SCORED, *patterns.METRICS, *TARGETS, *prices).withColumns({c: F.col(c).cast("double") for c in prices})


@query("w18_provided_target", sql(f"""n as (select *, row_number() {W} as "end", ln(value) - lag(ln(value)) {W} as lr, count(value) {AHEAD} as ahead from flag_daily)
    select series_id, "end", round(exp(lr) - 1, 6) as future_return from n where "end" >= 32 and ahead = 10 and lr is not null""", "flag_daily"))
def w18(spark, sf_dir):
    daily = flag_daily(spark, sf_dir).withColumn("lr", R.log_return(F.col("value")))
    out = windows.training_windows(daily, KEYS, keep_unclassified=True, target="lr")
    return out.select("series_id", F.col("end").cast("bigint").alias("end"), F.round("future_return", 6).alias("future_return"))


@query("j3_j5_j8_windows_with_lines", sql(f"""n as (select series_id, ts, value, row_number() {W} as "end", list(value) {over(32)} as p from flag_daily),
    w as (select series_id, "end" - 32 as start, "end", value, p from n where "end" >= 32),
    m as (select series_id, start, "end", list_sum(list_transform(generate_series(1, 32), lambda i: p[i] * (i - 16.5::double))) / 2728 as slope from w where "end" % 3 = 0)
    select w.series_id, w.start, w."end", {f32("w.value")} as price, round(m.slope, 5) as slope from w left join m using (series_id, start, "end")""", "flag_daily"))
def j3(spark, sf_dir):
    """Every window with its price; every third has a line, so that the left join finds some without."""
    rows = windows.sliding(flag_daily(spark, sf_dir), KEYS)
    lines = rows.where("`end` % 3 = 0").select("series_id", "start", "end", F.round(arrays.slope(F.col("prices")), 5).alias("slope"))
    out = rows.select("series_id", "start", "end", F.element_at("prices", -1).cast("float").cast("double").alias("price")).join(lines, ["series_id", "start", "end"], "left")
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("start", "end")})


@query("j6_raw_beside_zscores", sql(f"""m as (select avg(p_a) a, stddev_samp(p_a) s from market_wide) select ts, {f32("p_a")} as p_a, round((p_a - a) / s, 6) as z__p_a from market_wide, m""", "market_wide"))
def j6(spark, sf_dir):
    wide = market_wide(spark, sf_dir).select(F.col("ts").alias("date"), "p_a")
    bundle = series.load_bundle(wide, wide.withColumn("target", F.lit(0.0)), "p_a")
    z = cal.prefix_columns(bundle.zscore, ["p_a"])
    return bundle.raw.join(z, "date").select(F.col("date").alias("ts"), F.col("p_a").cast("float").cast("double").alias("p_a"), F.round("z__p_a", 6).alias("z__p_a"))


@query("x6_extended_history", sql(f"""w as (select ts, p_a, case when ts > date '1999-01-01' then p_n end as p_n from market_wide),
    u as (unpivot w on p_a, p_n into name feature value v), late as (select feature from u group by 1 order by min(ts) desc, feature limit 1)
    select ts, feature, {f32("v")} as value from u where feature not in (select feature from late)""", "market_wide"))
def x6(spark, sf_dir):
    """Columns that start late are dropped, so that rows before them count."""
    wide = market_wide(spark, sf_dir).select("ts", "p_a", F.when(F.col("ts") > "1999-01-01", F.col("p_n")).alias("p_n"))
    late = [r["feature"] for r in features.latest_starters(wide, ["p_a", "p_n"], 1).collect()]
    kept = cal.select_matching(wide, None, drop=[f"^{c}$" for c in [*late, "ts"]])
    long = wide.select("ts", *kept).dropna().unpivot(["ts"], kept, "feature", "value")
    return long.withColumn("value", F.col("value").cast("float").cast("double"))


@query("r9_weak_label_summary", sql(f"{shapes.shapes('flag_daily', 0.35)} select {shapes.PLACE}, label, round(confidence, 5) as confidence, round(future_return, 5) as future_return, pattern_idx from indexed where {shapes.TRAINED}", "flag_daily"))
def r9(spark, sf_dir):
    rows = windows.training_windows(cal.resample_business(flag_daily(spark, sf_dir), KEYS, ["value"]), KEYS)
    return placed(rows, "label", "confidence", "future_return", "pattern_idx")


@query("l2_inference_windows", sql(f"""n as (select *, row_number() {W} as "end" from brand_daily)
    select series_id, "end" - 32 as start, "end", ts as end_date, {f32("value")} as price, {f32(f"sum(value) {over(32)}")} as total from n qualify "end" >= 32 and ("end" - 32) % 4 = 0""", "brand_daily"))
def l2(spark, sf_dir):
    out = windows.inference_windows(brand_daily(spark, sf_dir), KEYS, stride=4)
    return out.select("series_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "end_date", F.col("price").cast("float").cast("double").alias("price"), arrays.total(F.col("prices")).cast("float").cast("double").alias("total"))


@query("l3_l5_l6_smoothed_line", sql(f"""n as (select series_id, ts, row_number() {W} as rn, list(value) {over(32)} as p from flag_daily),
    s as (select series_id, ts, list_transform(generate_series(1, 32), lambda i: (p[greatest(i - 1, 1)] + p[i] + p[least(i + 1, 32)]) / 3) as s from n where rn >= 32)
    select series_id, ts, round(list_sum(list_transform(generate_series(1, 32), lambda i: s[i] * (i - 16.5::double))) / 2728, 5) as slope,
    round(list_max(s) - list_min(s) + 1e-8, 4) as extent, round(list_avg(s), 4) as level from s""", "flag_daily"))
def l5(spark, sf_dir):
    out = windows.sliding(flag_daily(spark, sf_dir), KEYS).withColumn("s", arrays.smoothed(F.col("prices")))
    s = F.col("s")
    return out.select("series_id", "ts", F.round(arrays.slope(s), 5).alias("slope"), F.round(arrays.extent(s), 4).alias("extent"), F.round(arrays.mean(s), 4).alias("level"))


@query("l7_l15_pattern_labels", sql(f"{shapes.shapes('brand_daily', 0.35)} select {shapes.PLACE}, {shapes.LABELLED} from indexed", "brand_daily"))
def l15(spark, sf_dir):
    return placed(windows.label(windows.inference_windows(business(spark, sf_dir), KEYS)), *SCORED)


@query("label_counts", sql(f"{shapes.shapes('flag_daily', 0.35)} select series_id, label, count(*) as n, round(avg(confidence), 6) as confidence from indexed group by 1, 2", "flag_daily"))
def label_counts(spark, sf_dir):
    daily = cal.resample_business(flag_daily(spark, sf_dir), KEYS, ["value"])
    return windows.label(windows.inference_windows(daily, KEYS)).groupBy("series_id", "label").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("l16_class_index", "select l_returnflag, l_linestatus, case l_returnflag when 'A' then 0 when 'N' then 7 else -1 end as idx, count(*) as n from lineitem group by all")
def l16(spark, sf_dir):
    name = F.when(F.col("l_returnflag") == "A", "double_bottom").when(F.col("l_returnflag") == "N", "range").otherwise("unclassified")
    return table(spark, sf_dir, "lineitem").withColumn("idx", windows.class_index(name)).groupBy("l_returnflag", "l_linestatus", "idx").agg(F.count("*").alias("n"))


@query("l17_shape_metrics", sql(f"{shapes.shapes('brand_daily', 0.35)} select {shapes.PLACE}, {shapes.rounds(shapes.METRICS, 5)} from indexed", "brand_daily"))
def l17(spark, sf_dir):
    return placed(windows.with_metrics(windows.inference_windows(business(spark, sf_dir), KEYS)), *patterns.METRICS)


@query("l18_l19_channel_features", sql(f"{shapes.shapes('brand_daily', 0.30)} select {shapes.PLACE}, {shapes.LABELLED}, cast(label like '%channel' as int) as is_channel, {shapes.rounds({'atr': 'atr'} | shapes.FEATURES, 5)} from indexed", "brand_daily"))
def l19(spark, sf_dir):
    return placed(windows.channel_windows(business(spark, sf_dir), KEYS), *SCORED, "is_channel", "atr", *patterns.CHANNEL_FEATURES)


@query("l20_tensor_windows", sql(f"""n as (select *, row_number() {W} as rn from market_wide)
    select ts as end_date, 32 as rows, round(sum(p_a + p_n) {over(32)}, 0) as total from n qualify rn >= 32 and count(p_a + p_n) {over(32)} = 32 and p_r is not null""", "market_wide"))
def l20(spark, sf_dir):
    out = windows.tensor_windows(market_wide(spark, sf_dir), KEYS, ["p_a", "p_n"], "p_r")
    total = arrays.total(F.transform(F.flatten("window"), lambda x: x.cast("double")))
    return out.select("end_date", F.size("window").alias("rows"), F.round(total, 0).alias("total"))


PLAIN = f"n as (select series_id, ts, row_number() {W} as rn, list(value) {over(32)} as p from flag_daily), w as (select * from n where rn >= 32)"


@query("e1_e2_angular_field", sql(f"""{PLAIN}, u as (select series_id, ts, list_transform(p, lambda x: 2 * (x - list_min(p)) / (list_max(p) - list_min(p)) - 1) as c from w)
    select series_id, ts, round((pow(list_sum(c), 2) - pow(list_sum(list_transform(c, lambda x: sqrt(greatest(0, 1 - x * x)))), 2)) / 1024, 3) as gasf from u""", "flag_daily"))
def e2(spark, sf_dir):
    out = encode.encode(windows.sliding(flag_daily(spark, sf_dir), KEYS), "gasf")
    return out.select("series_id", "ts", F.round(encode.mean_pixel("image"), 3).alias("gasf"))


@query("e2_difference_field", sql(f"""{PLAIN}, u as (select series_id, ts, list_transform(p, lambda x: 2 * (x - list_min(p)) / (list_max(p) - list_min(p)) - 1) as c from w)
    select series_id, ts, cast(cast(round(cast(cast(sqrt(greatest(0, 1 - c[2] * c[2])) * c[31] - c[2] * sqrt(greatest(0, 1 - c[31] * c[31])) as float) as double), 3) as decimal(18, 3)) as double) as gadf from u""", "flag_daily"))
def e2d(spark, sf_dir):
    """One pixel of the difference field, whose mean is zero by its symmetry: second row, last column but one."""
    out = encode.encode(windows.sliding(flag_daily(spark, sf_dir), KEYS), "gadf")
    return out.select("series_id", "ts", F.round(F.element_at("image", 32 + 31).cast("double"), 3).cast("decimal(18,3)").cast("double").alias("gadf"))


@query("e3_recurrence_level", sql(f"""{PLAIN}, g as (select series_id, ts, flatten(list_transform(p, lambda a: list_transform(p, lambda b: abs(a - b)))) as g from w),
    q as (select *, list_aggregate(g, 'quantile_cont', 0.2) as s from g)
    select series_id, ts, round(list_avg(list_transform(g, lambda x: exp(-x / case when s > 0 then s else 1 end))), 3) as level from q""", "flag_daily"))
def e3m(spark, sf_dir):
    out = encode.encode(windows.sliding(flag_daily(spark, sf_dir), KEYS), "recurrence")
    return out.select("series_id", "ts", F.round(encode.mean_pixel("image"), 3).alias("level"))


@query("e1_scaled_window", sql(f"""{PLAIN}, u as (select series_id, ts, list_transform(p, lambda x: cast(cast(2 * (x - list_min(p)) / (list_max(p) - list_min(p)) - 1 as float) as double)) as c from w)
    select series_id, ts, cast(cast(round(list_sum(c), 3) as decimal(18, 3)) as double) as total, cast(cast(round(list_sum(list_transform(generate_series(1, 32), lambda i: i * c[i])), 2) as decimal(18, 3)) as double) as moment from u""", "flag_daily"))
def e1s(spark, sf_dir):
    out = encode.encode(windows.sliding(flag_daily(spark, sf_dir), KEYS), "scaled")
    c = F.transform("image", lambda x, i: x.cast("double") * (i + 1))
    return out.select("series_id", "ts", F.round(arrays.total(F.transform("image", lambda x: x.cast("double"))), 3).cast("decimal(18,3)").cast("double").alias("total"), F.round(arrays.total(c), 2).cast("decimal(18,3)").cast("double").alias("moment"))


SIDE = 5
#: For each pixel the four cells around its place among 32 x 32, and its distance from the first.
GRID = f"""grid as (select a, b, least(floor(a * 31 / {SIDE - 1}.0), 30)::bigint + 1 as i, a * 31 / {SIDE - 1}.0 - least(floor(a * 31 / {SIDE - 1}.0), 30) as fa,
    least(floor(b * 31 / {SIDE - 1}.0), 30)::bigint + 1 as j, b * 31 / {SIDE - 1}.0 - least(floor(b * 31 / {SIDE - 1}.0), 30) as fb from range({SIDE}) x(a), range({SIDE}) y(b))"""


def between(cell) -> str:
    """A pixel by linear interpolation of the four cells."""
    row = lambda i: f"((1 - fb) * ({cell(i, 'j')}) + fb * ({cell(i, 'j + 1')}))"
    return f"((1 - fa) * {row('i')} + fa * {row('i + 1')})"


def banded(name: str, values: str) -> str:
    """A list scaled to -1 ... 1, and the sines that belong to it."""
    scaled = f"list_transform({values}, lambda x: 2 * (x - list_min({values})) / (list_max({values}) - list_min({values})) - 1)"
    return f"{scaled} as {name}, list_transform({scaled}, lambda x: sqrt(greatest(0, 1 - x * x))) as {name}_s"


def field(c: str, difference: bool = False) -> str:
    cell = f"{c}_s[k] * {c}[m] - {c}[k] * {c}_s[m]" if difference else f"{c}[k] * {c}[m] - {c}_s[k] * {c}_s[m]"
    return f"flatten(list_transform(generate_series(1, 32), lambda k: list_transform(generate_series(1, 32), lambda m: {cell})))"


def robust(values: str) -> str:
    """A feature's robust z-scores from 0 to 1."""
    q = lambda p: f"list_aggregate({values}, 'quantile_cont', {p})"
    return f"list_transform({values}, lambda x: least(greatest(((x - {q(0.5)}) / (case when {q(0.75)} = {q(0.25)} then 1 else {q(0.75)} - {q(0.25)} end) + 3) / 6, 0), 1))"


def images(windows_sql: str, key: str, z: str, feature) -> str:
    """Pixels of the three-channel image of windows ``p`` with lists of features."""
    gain = "list_transform(generate_series(1, 32), lambda k: case when k = 1 then 0 else (p[k] - p[k - 1]) / greatest(p[k], 1e-8) end)"
    cell = lambda g: between(lambda i, j: f"({g}[({i} - 1) * 32 + {j}] - {g}_lo) / ({g}_hi - {g}_lo)")
    return f"""{windows_sql}, r as (select *, {gain} as gain from w), c as (select *, {banded('c', 'p')}, {banded('d', 'gain')}, {z} from r),
    g as (select *, {field('c')} as s, {field('d', True)} as f from c), l as (select *, list_min(s) as s_lo, list_max(s) as s_hi, list_min(f) as f_lo, list_max(f) as f_hi from g),
    {GRID}, t as (select {key}, a, b, {cell('s')} as c0, {cell('f')} as c1, {between(feature)} as c2 from l, grid),
    u as (unpivot t on c0, c1, c2 into name channel value v)
    select {key}, ((a * {SIDE} + b) * 3 + substr(channel, 2)::int)::int as pixel, cast(cast(least(greatest(v * 255, 0), 255) as float) as double) + 0 as value from u"""


def pixels(df, *key):
    return df.select(*key, F.posexplode("image").alias("pixel", "value")).withColumn("value", F.col("value").cast("double") + 0.0)


@query("e3_recurrence_plot", sql(f"""{PLAIN}, q as (select *, list_aggregate(flatten(list_transform(p, lambda x: list_transform(p, lambda y: abs(x - y)))), 'quantile_cont', 0.2) as s from w), {GRID}
    select series_id, ts, (a * {SIDE} + b)::int as pixel, cast(cast({between(lambda i, j: f"exp(-abs(p[{i}] - p[{j}]) / case when s > 0 then s else 1 end)")} as float) as double) + 0 as value from q, grid""", "flag_daily"))
def e3(spark, sf_dir):
    return pixels(encode.encode(windows.sliding(flag_daily(spark, sf_dir), KEYS), "recurrence", SIDE), "series_id", "ts")


@query("e4_e5_channel_images", sql(images(
    f"""n as (select series_id, ts as end_date, {', '.join(f'list({c}) {over(32)} as {c}' for c in ('p_a', 'p_n', 'p_r'))}, count(p_a + p_n + p_r) {over(32)} as full_rows from market_wide),
    w as (select series_id, end_date, p_a as p, {', '.join(f'list_transform({c}, lambda x: cast(cast(x as float) as double)) as f_{c}' for c in ('p_a', 'p_n', 'p_r'))} from n where full_rows = 32)""",
    "series_id, end_date", ", ".join(f"{robust(f'f_{c}')} as z{k}" for k, c in enumerate(("p_a", "p_n", "p_r"))),
    # Three features are stretched to 32 rows first.
    lambda i, j: f"case when ({i} - 1) * 2 / 31.0 < 1 then (1 - ({i} - 1) * 2 / 31.0) * z0[{j}] + ({i} - 1) * 2 / 31.0 * z1[{j}] else (2 - ({i} - 1) * 2 / 31.0) * z1[{j}] + (({i} - 1) * 2 / 31.0 - 1) * z2[{j}] end",
), "market_wide"))
def e5(spark, sf_dir):
    wide = market_wide(spark, sf_dir)
    both = windows.tensor_windows(wide, KEYS, ["p_a", "p_n", "p_r"], "p_a").withColumnRenamed("window", "features")
    prices = windows.sliding(wide, KEYS, "p_a").select("series_id", F.col("ts").alias("end_date"), "prices")
    return pixels(encode.encode_features(both.join(prices, ["series_id", "end_date"]), "prices", "features", SIDE), "series_id", "end_date")


@query("e8_price_encoding", sql(images(f"""n as (select series_id, row_number() {W} as "end", list(value) {over(32)} as p from flag_daily), w as (select * from n where "end" >= 32)""",
    'series_id, "end"', f"{robust('p')} as z", lambda i, j: f"z[{j}]"), "flag_daily"))
def e8(spark, sf_dir):
    return pixels(encode.encode(windows.sliding(flag_daily(spark, sf_dir), KEYS), "image", SIDE), "series_id", "end")


@query("j1_merge_series", sql("""a as (select ts, value as a from flag_daily where series_id = 'A' and day(ts) <> 5), b as (select ts, value as b from flag_daily where series_id = 'N' and day(ts) <> 6),
    c as (select ts, value as c from flag_daily where series_id = 'R' and day(ts) <> 7)
    select ts, cast(cast(a as float) as double) as a, cast(cast(b as float) as double) as b, cast(cast(c as float) as double) as c from a full join b using (ts) full join c using (ts)""", "flag_daily"))
def j1(spark, sf_dir):
    daily = flag_daily(spark, sf_dir)
    part = lambda f, d, n: daily.where((F.col("series_id") == f) & (F.dayofmonth("ts") != d)).select("ts", F.col("value").alias(n))
    return single(series.merge_series([part("A", 5, "a"), part("N", 6, "b"), part("R", 7, "c")], [], ts="ts"))


@query("chunk_with_halo", sql("""n as (select series_id, ts, value, row_number() over (partition by series_id order by ts) - 1 as i from brand_daily)
    select series_id, ts, round(avg(value) over (partition by series_id order by ts rows between 9 preceding and current row), 4) as m from n""", "brand_daily"))
def halo(spark, sf_dir):
    chunks = cal.chunk_with_halo(cal.row_index(brand_daily(spark, sf_dir), KEYS), KEYS, 500, 9, 0)
    r = features.Rolling(["series_id", "chunk"])
    return chunks.withColumn("m", F.round(r.mean(F.col("value"), 10, 1), 4)).where("in_chunk").select("series_id", "ts", "m")


@query("orders_latest_gap", sql(f"select series_id, ts, round(value / avg(value) {over(10)} - 1, 6) as gap from orders_daily", "orders_daily"))
def orders_gap(spark, sf_dir):
    return rounded(orders_daily(spark, sf_dir).select("series_id", "ts", R.gap(F.col("value"), 10, 1).alias("gap")))
