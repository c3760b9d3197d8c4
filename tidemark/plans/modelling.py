"""Queries over splits, templates, models, outlier control and survival."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import patterns
from tidemark.operators import calendar as cal
from tidemark.operators import boosted_aft, evaluation, many_models, models, outliers, splits, survival, windows
from tidemark.operators.tables import store

from . import shapes
from .panels import brand_daily, flag_daily, predictions, sql, table
from .registry import query, rounded

KEYS = ["series_id"]
W = "over (partition by series_id order by ts)"
ENDS = f"""w as (select series_id, ts as end_date, row_number() {W} as "end" from flag_daily),
    p as (select series_id, end_date, "end" - 32 as start, "end", row_number() over (partition by series_id order by "end") - 1 as win_idx, count(*) over (partition by series_id) as n from w where "end" >= 32)"""
#: What a purged and embargoed split leaves out: train near valid or test, valid near test.
NEAR = """({0}.l <= {1}.r and {0}.r >= {1}.l) or ({0}.win_idx > {1}.last and {0}.win_idx <= {1}.last + 5) or ({0}.win_idx < {1}.first and {0}.win_idx >= {1}.first - 5)"""


def ends(spark, sf_dir):
    """Positions of all complete windows of 32 days."""
    return windows.sliding(flag_daily(spark, sf_dir), KEYS).select("series_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "end_date")


def positions(df, *more):
    return df.select("series_id", F.col("win_idx").cast("bigint").alias("win_idx"), *more)


@query("c1_c2_ratio_split", sql(f"{ENDS} select series_id, win_idx, case when win_idx < floor(n * 0.7) then 'train' when win_idx < floor(n * 0.85) then 'valid' else 'test' end as split from p", "flag_daily"))
def c1(spark, sf_dir):
    return positions(splits.split_by_ratio(ends(spark, sf_dir), KEYS, 0.7, 0.15), "split")


@query("c2_precomputed_split", sql(f"{ENDS} select series_id, win_idx, case when win_idx < 1350 then 'train' when win_idx < 1500 then 'valid' else 'test' end as split from p", "flag_daily"))
def c2(spark, sf_dir):
    return positions(splits.split_by_count(ends(spark, sf_dir), KEYS, 1500), "split")


@query("c4_information_span", sql(f"{ENDS} select series_id, \"end\", start as \"left\", \"end\" + 9 as \"right\" from p", "flag_daily"))
def c4(spark, sf_dir):
    return splits.information_span(ends(spark, sf_dir), 10).select("series_id", "end", "left", "right")


HOLDOUT = f"""{ENDS}, s as (select series_id, win_idx, start as l, "end" + 9 as r, case when win_idx < round_even(n * 0.72, 0) then 'train' when win_idx < round_even(n * 0.80, 0) then 'valid' else 'test' end as split from p),
    e as (select series_id, split, min(l) as l, max(r) as r, min(win_idx) as first, max(win_idx) as last from s group by 1, 2),
    k as (select s.* from s join e v on v.series_id = s.series_id and v.split = 'valid' join e t on t.series_id = s.series_id and t.split = 'test'
    where not (s.split = 'train' and (({NEAR.format('s', 'v')}) or ({NEAR.format('s', 't')}))) and not (s.split = 'valid' and ({NEAR.format('s', 't')})))"""


@query("c5_c6_c8_purged_holdout", sql(f"{HOLDOUT} select series_id, win_idx, split from k", "flag_daily"))
def c8(spark, sf_dir):
    return positions(splits.holdout(ends(spark, sf_dir), KEYS, 10, 5), "split")


FOLDS = f"""{ENDS}, b as (select *, start as l, "end" + 9 as r, ntile(5) over (partition by series_id order by win_idx) - 1 as block from p),
    t as (select series_id, block, min(win_idx) as lo, max(win_idx) as hi from b where block > 0 group by 1, 2),
    s as (select t.series_id, t.block, b.win_idx, b.l, b.r, case when win_idx >= lo then 'test' when win_idx >= lo - least(greatest(1, round_even(lo * 0.15, 0)), lo - 1) then 'valid' else 'train' end as split
        from t join b on b.series_id = t.series_id and b.win_idx <= t.hi where lo >= 64),
    e as (select series_id, block, split, min(l) as l, max(r) as r, min(win_idx) as first, max(win_idx) as last from s group by 1, 2, 3),
    k as (select s.* from s join e v on v.series_id = s.series_id and v.block = s.block and v.split = 'valid' join e t on t.series_id = s.series_id and t.block = s.block and t.split = 'test'
        where not (s.split = 'train' and (({NEAR.format('s', 'v')}) or ({NEAR.format('s', 't')}))) and not (s.split = 'valid' and ({NEAR.format('s', 't')}))),
    g as (select series_id, block from k group by 1, 2 having count(*) filter (where split = 'train') >= 64 and count(*) filter (where split = 'valid') > 0),
    f as (select k.series_id, dense_rank() over (partition by k.series_id order by k.block) - 1 as fold_id, win_idx, split from k join g using (series_id, block))"""


@query("c7_walk_forward", sql(f"{FOLDS} select * from f", "flag_daily"))
def c7(spark, sf_dir):
    out = splits.walk_forward(ends(spark, sf_dir), KEYS, 4, 10, 5)
    return positions(out, F.col("fold_id").cast("bigint").alias("fold_id"), "split")


@query("c9_fold_column", sql(f"{FOLDS} select p.series_id, p.win_idx, coalesce(f.split, 'none') as split from p left join f on f.series_id = p.series_id and f.win_idx = p.win_idx and f.fold_id = 1", "flag_daily"))
def c9(spark, sf_dir):
    all_ends = ends(spark, sf_dir)
    return positions(splits.fold_column(all_ends, splits.walk_forward(all_ends, KEYS, 4, 10, 5), 1, KEYS), "split")


@query("c10_date_split", sql("select series_id, ts, case when ts <= date '2000-08-20' then 'train' else 'test' end as split from brand_daily", "brand_daily"))
def c10(spark, sf_dir):
    return splits.split_by_date(brand_daily(spark, sf_dir), KEYS, "2000-08-20", date="ts", order="ts").drop("value")


@query("c11_standardize_by_train", sql("""s as (select l_orderkey, l_linenumber, probability, forecast, ts <= date '2000-08-20' as train from predictions),
    m as (select avg(probability) a, stddev_pop(probability) b, avg(forecast) c, stddev_pop(forecast) d from s where train)
    select l_orderkey, l_linenumber, round((probability - a) / b, 5) as probability, round((forecast - c) / d, 5) as forecast from s, m""", "predictions"))
def c11(spark, sf_dir):
    rows = splits.split_by_date(predictions(spark, sf_dir), KEYS, "2000-08-20", date="ts")
    return rounded(splits.standardize_by_train(rows, ["probability", "forecast"]).select("l_orderkey", "l_linenumber", "probability", "forecast"), 5)


LONG = "u as (unpivot (select truth as label, probability, forecast, outcome from predictions) on probability, forecast, outcome into name metric value v)"


@query("a1_template_fit", sql(f"{LONG} select label, metric, round(avg(v), 5) as mean, round(case when stddev_pop(v) <= 1e-8 then 1 else stddev_pop(v) end, 5) as std from u group by 1, 2", "predictions"))
def a1(spark, sf_dir):
    return rounded(outliers.fit_templates(predictions(spark, sf_dir), ["probability", "forecast", "outcome"], "truth"), 5)


@query("a1_pattern_templates", sql(f"""{shapes.shapes('brand_daily', 0.35)}, m as (select label, {', '.join(f'{x} as {name}' for name, x in shapes.METRICS.items())} from indexed where {shapes.TRAINED}),
    u as (unpivot m on {', '.join(f'{name}' for name in shapes.METRICS)} into name metric value v)
    select label, metric, round(avg(v), 4) as mean, round(case when stddev_pop(v) <= 1e-8 then 1 else stddev_pop(v) end, 4) as std from u group by 1, 2""", "brand_daily"))
def a1_patterns(spark, sf_dir):
    """Templates of the shape metrics by label over the training windows."""
    table_ = windows.training_windows(cal.resample_business(brand_daily(spark, sf_dir), KEYS, ["value"]), KEYS)
    return rounded(outliers.fit_templates(table_, patterns.METRICS), 4)


@query("o3_entropy", sql("""e as (select l_orderkey, l_linenumber, [least(greatest(p, 1e-12), 1) for p in [probability / 3, (1 - probability) / 3 + 0.1, 0.2]] as ps from predictions)
    select l_orderkey, l_linenumber, round(-list_sum([p * ln(p) for p in ps]) / ln(3), 5) as pattern_entropy from e""", "predictions"))
def o3(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumns({"a": F.col("probability") / 3, "b": (1 - F.col("probability")) / 3 + 0.1, "c": F.lit(0.2)})
    return rounded(outliers.with_entropy(rows, ["a", "b", "c"]).select("l_orderkey", "l_linenumber", "pattern_entropy"), 5)


@query("o4_j4_template_distance", sql(f"""{LONG}, t as (select label, metric, avg(v) as m, stddev_pop(v) as s from u where label <> 'N' group by 1, 2)
    select l_orderkey, l_linenumber, round(coalesce(sqrt((pow((probability - a.m) / (a.s + 1e-8), 2) + pow((forecast - b.m) / (b.s + 1e-8), 2)) / 2), 0), 5) as metric_distance
    from predictions left join t a on a.label = predicted and a.metric = 'probability' left join t b on b.label = predicted and b.metric = 'forecast'""", "predictions"))
def o4(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    templates = outliers.fit_templates(rows.where("truth <> 'N'"), ["probability", "forecast"], "truth")
    out = outliers.template_distance(rows, templates, ["probability", "forecast"], "predicted")
    return rounded(out.select("l_orderkey", "l_linenumber", "metric_distance"), 5)


def daily_predictions(spark, sf_dir):
    """Class shares and forecasts of each brand and day, as a model would give them."""
    p = predictions(spark, sf_dir).join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])
    p = p.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    share = lambda c: F.round(F.avg((F.col("predicted") == c).cast("double")), 6)
    return p.groupBy(F.col("p_brand").alias("series_id"), "ts").agg(
        share("A").alias("prob_A"), share("N").alias("prob_N"), share("R").alias("prob_R"), F.round(F.avg("forecast"), 6).alias("pred_return"),
        F.max("predicted").alias("predicted_pattern"), F.round(F.avg(F.abs("outcome")), 6).alias("metric_distance"), F.round(F.avg("outcome"), 9).alias("outcome"),
    )


CONTROL = """j as (select p_brand as series_id, x.ts, predicted, forecast, outcome from predictions x join lineitem l using (l_orderkey, l_linenumber) join part on l.l_partkey = p_partkey),
    d as (select series_id, ts, round(avg((predicted = 'A')::int), 6) as pa, round(avg((predicted = 'N')::int), 6) as pn, round(avg((predicted = 'R')::int), 6) as pr,
        round(avg(forecast), 6) as ret, max(predicted) as called, round(avg(abs(outcome)), 6) as distance from j group by 1, 2),
    e as (select *, -list_sum(list_transform([pa, pn, pr], lambda p: least(greatest(p, 1e-12), 1) * ln(least(greatest(p, 1e-12), 1)))) / ln(3) as h,
        case when count(ret) over b >= 5 then stddev_pop(ret) over b end as base from d window b as (partition by series_id order by ts rows between 19 preceding and current row)),
    s as (select *, coalesce(base / (case when count(base) over b >= 5 then avg(base) over b end + 1e-8), 1.0) as spike from e window b as (partition by series_id order by ts rows between 19 preceding and current row)),
    x as (select *, list({'pa': pa, 'pn': pn, 'pr': pr, 'd': 1 - exp(-distance), 'h': h, 's': 1 - 2 / (exp(2 * greatest(spike - 1, 0)) + 1), 'c': called}) over (partition by series_id order by ts rows between 9 preceding and current row) as past from s),
    r as (select *, list_transform(range(len(past)), lambda i: pow(0.01, i / 10.0)) as raw from x),
    w as (select *, list_transform(raw, lambda v: v / list_sum(raw)) as w from r),
    v as (select *, list_sum(list_transform(range(1, len(past) + 1), lambda i: w[i] * past[i].pa)) as va, list_sum(list_transform(range(1, len(past) + 1), lambda i: w[i] * past[i].pn)) as vn,
        list_sum(list_transform(range(1, len(past) + 1), lambda i: w[i] * past[i].pr)) as vr from w),
    t as (select *, greatest(va, vn, vr) as top from v),
    y as (select *, case when abs(va - top) < 1e-9 then 'A' when abs(vn - top) < 1e-9 then 'N' else 'R' end as dominant from t),
    z as (select *, list_sum(list_transform(range(1, len(past) + 1), lambda i: w[i] * (0.45 * past[i].d + 0.25 * past[i].h + 0.2 * past[i].s + 0.1 * (past[i].c <> dominant)::int))) as score from y)
    select series_id, ts, round(spike, 4) as volatility_spike, dominant as dominant_pattern_window, round(top, 4) as dominant_confidence_window, round(score, 4) as weighted_outlier_score,
        cast(score >= 0.68 or top < 0.55 or distance >= 2.5 as int) as outlier_flag from z"""


@query("o5_o6_outlier_control", sql(CONTROL, "predictions"))
def o5(spark, sf_dir):
    rows = outliers.with_entropy(daily_predictions(spark, sf_dir), ["prob_A", "prob_N", "prob_R"])
    out = outliers.control(rows, KEYS, ["A", "N", "R"], "ts")
    return rounded(out.select(*KEYS, "ts", "volatility_spike", "dominant_pattern_window", "dominant_confidence_window", "weighted_outlier_score", "outlier_flag"), 4)


@query("o6_spikes_of_outcomes", sql(CONTROL.replace("round(avg(forecast), 6) as ret", "round(avg(outcome), 9) as ret"), "predictions"))
def o6(spark, sf_dir):
    """Where the outcome is known, its volatility is the spikes' source, not the forecast's."""
    rows = outliers.with_entropy(daily_predictions(spark, sf_dir).withColumnRenamed("outcome", "future_return"), ["prob_A", "prob_N", "prob_R"])
    out = outliers.control(rows, KEYS, ["A", "N", "R"], "ts")
    return rounded(out.select(*KEYS, "ts", "volatility_spike", "dominant_pattern_window", "dominant_confidence_window", "weighted_outlier_score", "outlier_flag"), 4)


@query("o2_weighted_vote", sql("select series_id, predicted, round(sum(probability), 2) as vote from predictions group by 1, 2", "predictions"))
def o2(spark, sf_dir):
    return rounded(outliers.weighted_vote(predictions(spark, sf_dir), KEYS, "predicted", "probability"), 2)


def lives(spark, sf_dir):
    """Durations with an event flag and a risk, from line items."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("duration"), (F.col("l_returnflag") == "R").cast("int").alias("event"), F.floor(F.col("l_discount") * 50).alias("risk"), (F.col("l_orderkey") % 3).alias("part"),
        "l_extendedprice", "l_linenumber",
    )


LIVES = "lives as (select l_quantity as duration, cast(l_returnflag = 'R' as int) as event, floor(l_discount * 50) as risk, l_orderkey % 3 as part from lineitem)"
KM = """{0}_c as (select greatest(duration, 0.5) as t, count(*) as c, sum({1}) as deaths from lives {2} group by 1),
    {0}_r as (select t, deaths, sum(c) over (order by t desc) as at_risk from {0}_c),
    {0} as (select t, at_risk, deaths, exp(sum(ln(greatest(1 - deaths / at_risk, 1e-300))) over (order by t)) as survival from {0}_r)"""


@query("v2_kaplan_meier", f"with {LIVES}, {KM.format('k', 'event', '')} select cast(t as double) as t, cast(at_risk as bigint) as at_risk, cast(deaths as bigint) as deaths, round(survival, 6) as survival from k")
def v2(spark, sf_dir):
    return rounded(survival.kaplan_meier(lives(spark, sf_dir)))


@query("v2_survival_at_horizons", f"with {LIVES}, {KM.format('k', 'event', '')} select cast(h as double) as horizon, round((select arg_max(survival, t) from k where t <= h), 6) as survival from unnest([5, 10, 20]) u(h)")
def v2h(spark, sf_dir):
    return rounded(survival.survival_at(survival.kaplan_meier(lives(spark, sf_dir)), [5, 10, 20]))


@query("v5_j9_concordance", f"""with c as (select part, t, e, risk, count(*) as n from (select l_linenumber as part, l_quantity as t, cast(l_returnflag = 'R' as int) as e, l_extendedprice as risk from lineitem) group by all)
    select part, cast(sum(a.n * b.n) as bigint) as comparable, round(sum(a.n * b.n * case when a.risk > b.risk then 1 when a.risk = b.risk then 0.5 else 0 end) / sum(a.n * b.n), 6) as c_index
    from c a join c b using (part) where a.e = 1 and (b.t > a.t or (b.t = a.t and b.e = 0)) group by part""")
def v5(spark, sf_dir):
    rows = lives(spark, sf_dir).drop("part", "risk").withColumnsRenamed({"l_extendedprice": "risk", "l_linenumber": "part"})
    return rounded(survival.concordance(rows, keys=["part"]))


@query("v6_v7_integrated_brier", f"""with {LIVES}, {KM.format('g', '1 - event', 'where part <> 0')},
    x as (select duration, event, cast(h as double) as h, exp(-h * (1 + risk) / 100) as s from lives, unnest([5, 10, 20, 30]) u(h) where part = 0),
    y as (select h, case when duration <= h and event = 1 then s * s / (select arg_max(survival, t) from g where t <= duration)
        when duration > h then (1 - s) * (1 - s) / (select arg_max(survival, t) from g where t <= h) else 0 end as b from x),
    z as (select h, avg(b) as b from y group by 1)
    select count(*) as n_grid, round(sum(d * m) / (max(h) - min(h)), 6) as ibs from (select h, h - lag(h) over (order by h) as d, (b + lag(b) over (order by h)) / 2 as m from z)""")
def v6(spark, sf_dir):
    rows = lives(spark, sf_dir)
    test = rows.where("part = 0").withColumn("horizon", F.explode(F.array(*[F.lit(float(h)) for h in (5, 10, 20, 30)])))
    test = test.withColumn("survival", F.exp(-F.col("horizon") * (1 + F.col("risk")) / 100))
    return rounded(survival.integrated_brier(test, rows.where("part <> 0"), [5, 10, 20, 30]))


@query("a7_median_duration", f"with {LIVES} select part, median(duration) as median_duration, count(*) as n from lives where event = 1 group by 1")
def a7(spark, sf_dir):
    return lives(spark, sf_dir).where("event = 1").groupBy("part").agg(F.percentile("duration", 0.5).alias("median_duration"), F.count("*").alias("n"))


def channel_lives(spark, sf_dir):
    return survival.episodes(cal.resample_business(brand_daily(spark, sf_dir), KEYS, ["value"]), KEYS)


BEYOND = "abs({v} - (middle + slope * (15.5 + {j} - e0))) > 2 * rest + coalesce({atr}, rest)"
#: Every channel's life by itself, then the chain of those that start after the one before has ended.
EPISODES = f"""{shapes.shapes('brand_daily', 0.30)},
    r as (select series_id, "end" as j, end_date as day, price as v, atr, lag(price) over o as pv, lag(atr) over o as patr, max("end") over (partition by series_id) as n from rowed window o as (partition by series_id order by end_date)),
    c as (select *, "end" as e0 from indexed where label like '%channel'),
    b as (select c.series_id, e0, min(j) as broken from c join r on c.series_id = r.series_id and j > e0 + 1 where ({BEYOND.format(v='r.v', j='j', atr='r.atr')}) and ({BEYOND.format(v='pv', j='j - 1', atr='patr')}) group by 1, 2),
    l as (select c.*, coalesce(broken, n) as last, broken is not null as event from c left join b using (series_id, e0) join (select distinct series_id, n from r) using (series_id)),
    f as (select l.*, (select min(x.e0) from c x where x.series_id = l.series_id and x.e0 > l.last) as next from l),
    chain as (select series_id, min(e0) as e0 from c group by 1 union all select f.series_id, f.next from chain join f using (series_id, e0) where f.next is not null)
    select f.series_id, f.end_date as start_date, r.day as end_date, replace(label, '_channel', '') as direction, round(confidence, 5) as conf_detection, cast(last - f.e0 as int) as duration, event::int as event,
        case when not event then '' when r.v > middle + slope * (15.5 + last - f.e0) then 'up' else 'down' end as breakout_dir, {shapes.rounds({k: x.replace('atr', 'f.atr') for k, x in shapes.FEATURES.items()}, 5)}
    from chain join f using (series_id, e0) join r on r.series_id = f.series_id and r.j = f.last where event or last > f.e0"""


@query("v1_channel_episodes", sql(EPISODES, "brand_daily").replace("with ", "with recursive ", 1))
def v1(spark, sf_dir):
    return rounded(channel_lives(spark, sf_dir), 5)


def split_lives(spark, sf_dir):
    rows = splits.split_by_date(channel_lives(spark, sf_dir), KEYS, date="start_date", order="start_date").cache()
    scaled = splits.standardize_by_train(rows, patterns.CHANNEL_FEATURES)
    return scaled.where("split = 'train'"), scaled.where("split = 'test'")


#: The features whose columns are not collinear or constant.
RISKS = [c for c in patterns.CHANNEL_FEATURES if c not in ("band_width",)]


@query("v3_cox_hazards")
def v3(spark, sf_dir):
    train, test = split_lives(spark, sf_dir)
    if survival.enough(train, test):
        return spark.createDataFrame([], "model string, c_index double, comparable bigint")
    beta = survival.fit_cox(train, RISKS)
    return survival.concordance(survival.cox_risk(test, RISKS, beta)).select(F.lit("cox").alias("model"), "c_index", "comparable")


@query("v4_accelerated_failure_time")
def v4(spark, sf_dir):
    train, test = split_lives(spark, sf_dir)
    if survival.enough(train, test):
        return spark.createDataFrame([], "horizon double, survival double")
    model = models.fit_aft(train, RISKS)
    return models.aft_survival(model, test, RISKS, [5, 10, 20]).groupBy("horizon").agg(F.avg("survival").alias("survival"))


@query("v4_boosted_lives")
def v4_boosted(spark, sf_dir):
    """Boosted trees on the censored log-likelihood: concordance and mean survival, judged on later lives."""
    train, test = split_lives(spark, sf_dir)
    if survival.enough(train, test):
        return spark.createDataFrame([], "horizon double, survival double, c_index double")
    bounded = train.withColumn("ends_by", F.when(F.col("event") == 1, F.col("duration")))
    model = boosted_aft.fit(bounded, RISKS, "duration", "ends_by", rounds=12, depth=2)
    scored = store(boosted_aft.predict(test, model).withColumn("risk", -F.col("log_life")), "boosted-scores")
    index = survival.concordance(scored).select("c_index")
    return boosted_aft.survival(scored, model, [5, 10, 20]).groupBy("horizon").agg(F.avg("survival").alias("survival")).crossJoin(F.broadcast(index))


@query("m1_m2_pattern_heads")
def m1(spark, sf_dir):
    """Heads learned before a date, scores after it."""
    rows = windows.with_metrics(windows.label(windows.inference_windows(cal.resample_business(flag_daily(spark, sf_dir), KEYS, ["value"]), KEYS), 0.30))
    rows = splits.split_by_date(rows.drop("prices", "ts", "value", "confidence"), KEYS, "2000-08-20").cache()
    heads = models.fit_heads(rows.where("split = 'train'"), patterns.METRICS, list(patterns.CHANNELS))
    return models.score_heads(rows.where("split = 'test'"), heads, patterns.METRICS).drop(*patterns.METRICS)


def rising(matrix: np.ndarray) -> np.ndarray:
    """A stand-in for a trained model: pattern scores as probabilities, drift as forecast."""
    scores = patterns.scores(matrix) + 1e-9
    drift = matrix[:, -1] / matrix[:, 0] - 1
    return np.column_stack([scores / scores.sum(1, keepdims=True), drift, np.minimum(drift, 0), np.maximum(drift, 0)])


SHARES = {p: f"(score_{p} + 1e-9) / ({' + '.join(f'score_{q}' for q in patterns.PATTERNS)} + 8e-9)" for p in patterns.PATTERNS}
DRIFTS = {"pred_return": "drift", "pred_support": "least(drift, 0)", "pred_resistance": "greatest(drift, 0)"}


@query("m3_batch_scoring", sql(f"""{shapes.shapes('flag_daily', 0)}, x as (select *, p[32] / p[1] - 1 as drift from indexed)
    select series_id, "end", end_date, label as predicted_pattern, {shapes.rounds({f'prob_{p}': x for p, x in SHARES.items()} | DRIFTS, 6)}, {', '.join(f'cast(cast(price * (1 + {x}) as float) as double) as {n}_price' for n, x in DRIFTS.items())} from x""", "flag_daily"))
def m3(spark, sf_dir):
    rows = windows.inference_windows(cal.resample_business(flag_daily(spark, sf_dir), KEYS, ["value"]), KEYS)
    out = models.batch_score(rows, lambda: rising, patterns.PATTERNS)
    place = ["series_id", F.col("end").cast("bigint").alias("end"), "end_date", "predicted_pattern", *[F.round(c, 6).alias(c) for c in (*[f"prob_{p}" for p in patterns.PATTERNS], *DRIFTS)]]
    return out.select(*place, *[F.col(f"{c}_price").cast("float").cast("double").alias(f"{c}_price") for c in DRIFTS])


@query("m5_channel_formation")
def m5(spark, sf_dir):
    """Will a channel form within ten days where there is none? Features of the window, judged after a date."""
    from tidemark.operators.features import Rolling

    rows = windows.channel_windows(cal.resample_business(brand_daily(spark, sf_dir), KEYS, ["value"]), KEYS)
    rows = rows.withColumn("soon", Rolling(KEYS, "end").upcoming_flag(F.col("is_channel"), 10)).where("is_channel = 0")
    rows = splits.split_by_date(rows.select("series_id", "end", "end_date", "soon", *patterns.CHANNEL_FEATURES), KEYS, "2000-08-20").cache()
    return models.formation_report(rows.where("split = 'train'"), rows.where("split = 'test'"), patterns.CHANNEL_FEATURES, "soon")


@query("m6_breakout_direction")
def m6(spark, sf_dir):
    rows = channel_lives(spark, sf_dir).where("event = 1").withColumn("up", (F.col("breakout_dir") == "up").cast("int"))
    rows = splits.split_by_date(rows, KEYS, date="start_date", order="start_date").cache()
    return models.formation_report(rows.where("split = 'train'"), rows.where("split = 'test'"), patterns.CHANNEL_FEATURES, "up")


CUTOFFS = [f"{1995 + (k + 6) // 12}-{(k + 6) % 12 + 1:02d}-01" for k in range(65)]


def forming(spark, sf_dir):
    """Windows outside a channel, their features, and whether one forms within ten days."""
    from tidemark.operators.features import Rolling

    rows = windows.channel_windows(cal.resample_business(brand_daily(spark, sf_dir), KEYS, ["value"]), KEYS)
    rows = rows.withColumn("soon", Rolling(KEYS, "end").upcoming_flag(F.col("is_channel"), 10)).where("is_channel = 0")
    return store(rows.select("series_id", "end", "end_date", "soon", *patterns.CHANNEL_FEATURES), "forming-channels")


@query("x2_rolling_refits")
def x2_refits(spark, sf_dir):
    """65 monthly cutoffs, a model refitted at each, all in one pass a step: the scores' AUC by the model's age."""
    scored = many_models.rolling_refits(forming(spark, sf_dir), RISKS, "soon", CUTOFFS, gap_days=14)
    age = F.col("age")
    aged = scored.withColumn("age", F.when(age <= 1, "0-1m").when(age <= 3, "1-3m").when(age <= 6, "3-6m").otherwise("6-12m"))
    return evaluation.auc(aged, ["age"], "soon", "score").join(aged.groupBy("age").agg(F.count("*").alias("n"), F.countDistinct("cutoff").alias("models")), "age")


@query("x4_gated_heads")
def x4_heads(spark, sf_dir):
    """A head for each regime of volatility beside one for all, judged after a date, regime by regime."""
    from tidemark.operators import robustness

    rows = robustness.regime(forming(spark, sf_dir), KEYS, "vol20").where("vol20 is not null")
    scored = store(many_models.gated_scores(rows, RISKS, "soon", "regime", 3, F.col("end_date") < F.lit("2000-08-20").cast("date")), "gated-scores")
    gated, pooled = (evaluation.auc(scored, ["regime"], "soon", c).withColumnRenamed("auc", f"auc_{c}") for c in ("gated", "pooled"))
    return gated.join(pooled, "regime").join(scored.groupBy("regime").agg(F.count("*").alias("n")), "regime")
