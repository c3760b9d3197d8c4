"""Queries over metrics, backtests, reports and robustness."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import backtest, evaluation, robustness, windows
from tidemark.operators import calendar as cal
from tidemark.operators.features import Rolling

from . import shapes
from .panels import brand_daily, flag_daily, market_wide, predictions, sql, table
from .registry import query, rounded

KEYS = ["series_id"]
CLASSES = ["A", "N", "R"]
W = "over (partition by series_id order by ts)"

GRID = """g as (select t.c as truth, p.c as predicted from (values ('A'), ('N'), ('R')) t(c), (values ('A'), ('N'), ('R')) p(c)),
    m as (select g.truth, g.predicted, count(x.l_orderkey) as n from g left join predictions x on x.truth = g.truth and x.predicted = g.predicted group by 1, 2)"""
PER_CLASS = f"""{GRID}, c as (select label, sum(n) filter (where truth = label) as support, sum(n) filter (where predicted = label) as called, sum(n) filter (where truth = label and predicted = label) as hits
        from m, (values ('A'), ('N'), ('R')) l(label) group by 1),
    s as (select label, support, hits / called as p, hits / support as r from c)"""


@query("r1_confusion_matrix", sql(f"{GRID} select * from m", "predictions"))
def r1(spark, sf_dir):
    return evaluation.confusion(predictions(spark, sf_dir), CLASSES)


@query("r6_confusion_sheet", sql(f"{GRID} select truth, {', '.join(f'cast(sum(n) filter (where predicted = {chr(39)}{c}{chr(39)}) as bigint) as {chr(34)}{c}{chr(34)}' for c in 'ANR')}, cast(sum(n) as bigint) as total from m group by 1", "predictions"))
def r6_sheet(spark, sf_dir):
    return evaluation.confusion_sheet(evaluation.confusion(predictions(spark, sf_dir), CLASSES), CLASSES)


@query("r2_classification", sql(f"{PER_CLASS} select cast(sum(support) as bigint) as n, round(sum(r * support) / sum(support), 6) as accuracy, round(avg(r), 6) as balanced_accuracy, round(avg(2 * p * r / (p + r)), 6) as macro_f1 from s", "predictions"))
def r2(spark, sf_dir):
    return rounded(evaluation.classification(evaluation.confusion(predictions(spark, sf_dir), CLASSES)))


@query("r2_r6_per_class", sql(f"{PER_CLASS} select label, cast(support as bigint) as support, round(p, 6) as precision, round(r, 6) as recall, round(2 * p * r / (p + r), 6) as f1 from s", "predictions"))
def r6(spark, sf_dir):
    return rounded(evaluation.per_class(evaluation.confusion(predictions(spark, sf_dir), CLASSES)))


AUC = """r as (select {1}, actual, rank() over (partition by {1} order by {0}) + (count(*) over (partition by {1}, {0}) - 1) / 2.0 as rk from {2})"""


@query("r3_binary_metrics", sql(f"""{AUC.format('probability', 'series_id', 'predictions')},
    a as (select series_id, (sum(rk) filter (where actual = 1) - count(*) filter (where actual = 1) * (count(*) filter (where actual = 1) + 1) / 2.0) / (count(*) filter (where actual = 1) * count(*) filter (where actual = 0)) as auc from r group by 1),
    b as (select series_id, count(*) as n, avg(actual) as base_rate, avg(cast((probability >= 0.5) = (actual = 1) as int)) as accuracy, count(*) filter (where actual = 1 and probability >= 0.5) as h,
        count(*) filter (where probability >= 0.5) as c, count(*) filter (where actual = 1) as y from predictions group by 1)
    select series_id, n, round(base_rate, 6) as base_rate, round(accuracy, 6) as accuracy, round(coalesce(h / nullif(c, 0), 0), 6) as precision, round(coalesce(h / nullif(y, 0), 0), 6) as recall,
        round(coalesce(2 * h / nullif(c + y, 0), 0), 6) as f1, round(auc, 6) as auc from a join b using (series_id)""", "predictions"))
def r3(spark, sf_dir):
    return rounded(evaluation.binary(predictions(spark, sf_dir), KEYS, "actual", "probability"))


@query("r4_regression_metrics", sql("""select series_id, 'return' as target, count(*) as n, round(avg(abs(forecast - outcome)), 6) as mae, round(sqrt(avg(pow(forecast - outcome, 2))), 6) as rmse,
    round(avg(cast(sign(forecast) = sign(outcome) as int)), 6) as directional_accuracy from predictions group by 1""", "predictions"))
def r4(spark, sf_dir):
    return rounded(evaluation.regression(predictions(spark, sf_dir), KEYS, [("return", "forecast", "outcome")]))


@query("r5_j2_evaluation", sql("""t as (select l_orderkey, l_linenumber, truth, outcome from predictions)
    select count(*) as n, count(t.truth) as known, count(*) filter (where p.predicted = t.truth) as hits, round(avg(abs(p.forecast - t.outcome)), 6) as mae
    from predictions p left join t using (l_orderkey, l_linenumber)""", "predictions"))
def r5(spark, sf_dir):
    p = predictions(spark, sf_dir)
    truth = p.select("l_orderkey", "l_linenumber", F.col("truth").alias("t"), F.col("outcome").alias("o"))
    joined = p.join(truth, ["l_orderkey", "l_linenumber"], "left")
    return rounded(joined.agg(F.count("*").alias("n"), F.count("t").alias("known"), F.sum((F.col("predicted") == F.col("t")).cast("bigint")).alias("hits"), F.avg(F.abs(F.col("forecast") - F.col("o"))).alias("mae")))


@query("m4_class_weights", sql("""c as (select truth as label, count(*) as c from predictions group by 1), w as (select label, (select count(*) from predictions) / (4 * c) as w from c)
    select label, round(w / avg(w) over (), 6) as weight from w""", "predictions"))
def m4(spark, sf_dir):
    return rounded(evaluation.class_weights(predictions(spark, sf_dir), "truth", [*CLASSES, "X"]))


THRESHOLDS = """k as (select series_id, actual, least(greatest(floor(probability / 0.025 + 1e-9), 0), 40) as cell from predictions),
    t as (select k.series_id, g.cell, count(*) filter (where k.cell >= g.cell) as c, count(*) filter (where k.cell >= g.cell and actual = 1) as h, count(*) filter (where actual = 1) as y
        from k join (select distinct series_id, cell from k) g on g.series_id = k.series_id group by 1, 2)"""


@query("x3_threshold_choice", sql(f"""{THRESHOLDS} select series_id, round(cell * 0.025, 6) as threshold, round(2 * h / (c + y), 6) as f1 from t qualify row_number() over (partition by series_id order by 2 * h / (c + y) desc, cell) = 1""", "predictions"))
def x3(spark, sf_dir):
    return rounded(evaluation.threshold_grid(predictions(spark, sf_dir), KEYS, "actual", "probability"))


# Means of whole numbers, so that no engine's order of addition shows in a sign.
DAILY = """d as (select series_id, ts, cast(sum(cast(round(forecast * 10000) as bigint)) as double) / (10000 * count(*)) as forecast,
    cast(sum(cast(round(outcome * 1000000) as bigint)) as double) / (1000000 * count(*)) as outcome from predictions group by 1, 2)"""


def daily(spark, sf_dir):
    mean = lambda c, unit: (F.sum(F.round(F.col(c) * unit).cast("bigint")).cast("double") / (unit * F.count("*"))).alias(c)
    return predictions(spark, sf_dir).groupBy("series_id", "ts").agg(mean("forecast", 10000), mean("outcome", 1000000))


RULES = {
    "sign": "sign(forecast)",
    "long_only": "cast(forecast > 0.001 as int)::double",
    "threshold": "case when forecast > 0.003 then 1.0 when forecast < -0.003 then -1.0 else 0.0 end::double",
    "proportional": "greatest(least(forecast / (stddev_pop(forecast) over (partition by series_id) + 1e-8), 1), -1)",
}


def strategy_query(rule: str, threshold: float):
    body = f"""{DAILY}, p as (select *, {RULES[rule]} as position from d)
        select series_id, ts, round(position, 7) as position, round(position * outcome - abs(position - lag(position, 1, 0.0) {W}) * 0.0005, 7) as strategy_return from p"""

    @query(f"b1_b2_strategy_{rule}", sql(body, "predictions"))
    def run(spark, sf_dir):
        out = backtest.strategy(daily(spark, sf_dir), KEYS, "forecast", "outcome", rule, threshold, 5)
        return rounded(out.select("series_id", "ts", "position", "strategy_return"), 7)


for _rule, _threshold in (("sign", 0.0), ("long_only", 0.001), ("threshold", 0.003), ("proportional", 0.0)):
    strategy_query(_rule, _threshold)

RETURNS = f"{DAILY}, s as (select *, sign(forecast) * outcome as ret from d)"


@query("b3_b4_performance", sql(f"""{RETURNS}, e as (select *, exp(sum(ln(1 + ret)) {W}) as equity from s), f as (select *, equity / max(equity) {W} - 1 as dd from e)
    select series_id, count(*) as n, round(avg(ret) * 252, 4) as annualized_return, round(stddev_samp(ret) * sqrt(252), 4) as annualized_vol, round(avg(ret) / stddev_samp(ret) * sqrt(252), 4) as sharpe_annual,
        round(arg_max(equity, ts) - 1, 4) as cumulative_return, round(min(dd), 4) as max_drawdown, round(avg(cast(ret > 0 as int)) filter (where ret <> 0), 4) as hit_rate from f group by 1""", "predictions"))
def b3(spark, sf_dir):
    main = backtest.strategy(daily(spark, sf_dir), KEYS, "forecast", "outcome")
    return rounded(backtest.performance(main, KEYS, "strategy_return").drop("psr_vs_zero"), 4)


def normal(z: str) -> str:
    """The normal distribution function by its series of positive terms; beyond 8 it is 0 or 1."""
    x = f"least(abs({z}), 8)"
    terms = f"list_sum(list_transform(range(200), lambda k: exp((2 * k + 1) * ln({x}) - lgamma(k + 1.5) - (k + 1) * ln(2) + ln(pi()) / 2)))"
    return f"(case when {z} = 0 then 0.5 else 0.5 + sign({z}) * exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {terms} end)"


def inverse_normal(p: str) -> str:
    """The normal quantile by halving an interval."""
    half = f"case when {normal('(a[1] + a[2]) / 2')} < {p} then [(a[1] + a[2]) / 2, a[2]] else [a[1], (a[1] + a[2]) / 2] end"
    return f"list_reduce(list_transform(range(60), lambda i: [0::double, 0::double]), lambda a, x: {half}, [-8::double, 8::double])[1]"


def moments_sql(rows: str) -> str:
    """Moments of ``ret`` by series, from a table of it."""
    return f"""select series_id, count(*) as n, any_value(a) as mean, any_value(d) as sd, any_value(a / d) as sharpe, avg(pow(ret - a, 3)) / pow(any_value(d), 3) as skew, avg(pow(ret - a, 4)) / pow(any_value(d), 4) as kurt
        from {rows} join (select series_id, avg(ret) as a, stddev_samp(ret) as d from {rows} group by 1) using (series_id) group by 1"""


def z_of(above: str) -> str:
    return f"({above}) * sqrt(n - 1) / sqrt(greatest(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe, 1e-12))"


@query("b5_probabilistic_sharpe", sql(f"""{RETURNS}, m as ({moments_sql('s')}), z as (select *, {z_of('sharpe')} as z from m)
    select series_id, n, round(mean, 6) as mean, round(sd, 6) as sd, round(sharpe, 6) as sharpe, round(skew, 5) as skew, round(kurt, 5) as kurt, round({normal('z')}, 6) as psr from z""", "predictions"))
def b5(spark, sf_dir):
    main = backtest.strategy(daily(spark, sf_dir), KEYS, "forecast", "outcome")
    out = backtest.probabilistic_sharpe(backtest.moments(main, KEYS, "strategy_return"))
    return out.select("series_id", "n", *[F.round(c, 5 if c in ("skew", "kurt") else 6).alias(c) for c in ("mean", "sd", "sharpe", "skew", "kurt", "psr")])


def performance_sql(rows: str, order: str = "ts", periods: int = 252) -> str:
    """The performance of ``ret`` by series, from a table of it."""
    run = f"over (partition by series_id order by {order})"
    return f"""select series_id, any_value(m.n) as n, any_value(mean) * {periods} as annualized_return, any_value(sd) * sqrt({periods}) as annualized_vol, any_value(sharpe) * sqrt({periods}) as sharpe_annual, any_value({normal('z')}) as psr_vs_zero,
        arg_max(equity, {order}) - 1 as cumulative_return, min(dd) as max_drawdown, coalesce(avg(cast(ret > 0 as int)) filter (where ret <> 0), 0) as hit_rate
        from (select *, equity / max(equity) {run} - 1 as dd from (select *, case when min(abs(1 + ret)) {run} = 0 then 0 else pow(-1, count(*) filter (where ret < -1) {run}) * exp(sum(ln(nullif(abs(1 + ret), 0))) {run}) end as equity from {rows}))
        join (select *, {z_of('sharpe')} as z from ({moments_sql(rows)})) m using (series_id) group by 1"""


def report_sql(fee: float) -> str:
    """WITH items of a backtest: returns, their deflated Sharpe ratio against yearly trials, and overfitting of the variants."""
    variants = {"sign": RULES["sign"], "long_only": RULES["long_only"].replace("0.001", "0"), "thr_lo": RULES["threshold"].replace("0.003", "0.001"), "thr_hi": RULES["threshold"], "proportional": RULES["proportional"]}
    turn = f"abs({{0}} - lag({{0}}, 1, 0.0) {{1}}) * {fee}"
    k = len(variants)
    yearly = "over (partition by series_id, year(ts) order by ts)"
    halves = ", ".join(f"sum(r_{v}) filter (where side = 1) / sum(c) filter (where side = 1) as i{j}, sum(r_{v}) filter (where side = 0) / sum(c) filter (where side = 0) as o{j}" for j, v in enumerate(variants, 1))
    return f"""{DAILY}, p as (select *, {', '.join(f'{x} as p_{v}' for v, x in variants.items())} from d),
    s as (select *, p_sign * outcome - {turn.format('p_sign', W)} as ret, p_sign * outcome - {turn.format('p_sign', yearly)} as in_year, {', '.join(f"p_{v} * outcome - {turn.format(f'p_{v}', W)} as r_{v}" for v in variants)} from p),
    trials as (select series_id, year(ts) as y, coalesce(avg(in_year) / nullif(stddev_samp(in_year), 0), 0) * sqrt(252) as trial from s group by 1, 2),
    tried as (select series_id, count(*) as n_trials, coalesce(var_samp(trial), 0) as sharpe_variance from trials group by 1),
    expected as (select *, sqrt(sharpe_variance) * ((1 - {backtest.EULER_GAMMA}) * {inverse_normal('(1 - 1.0::double / n_trials)')} + {backtest.EULER_GAMMA} * {inverse_normal('(1 - 1 / (n_trials * exp(1)))')}) as expected_max_sharpe_annual from tried),
    above as (select *, {z_of('sharpe - expected_max_sharpe_annual / sqrt(252)')} as z from ({moments_sql('s')}) join expected using (series_id)),
    deflated as (select series_id, n_trials, sharpe_variance, expected_max_sharpe_annual, {normal('z')} as deflated_sharpe_ratio from above),
    blocks as (select series_id, b, count(*) as c, {', '.join(f'sum(r_{v}) as r_{v}' for v in variants)} from (select *, ntile(16) {W} - 1 as b from s) group by 1, 2),
    halves as (select series_id, mask, {halves} from (select *, (mask >> b) & 1 as side from blocks, (select range as mask from range(65536) where bit_count(range) = 8)) group by 1, 2),
    ranked as (select series_id, [{', '.join(f'i{j}' for j in range(1, k + 1))}] as ins, [{', '.join(f'o{j}' for j in range(1, k + 1))}] as outs from halves),
    chosen as (select *, list_position(ins, list_max(ins)) as best from ranked),
    logits as (select series_id, len(list_filter(generate_series(1, {k}), lambda j: outs[j] < outs[best] or (outs[j] = outs[best] and j <= best))) / {k + 1} as w from chosen),
    pbo as (select series_id, avg(cast(w <= 0.5 as int)) as pbo, count(*) as n_combinations, avg(ln(w / (1 - w))) as logit_mean, median(ln(w / (1 - w))) as logit_median from logits group by 1)"""


def rounded_sql(names: list[str], places: int = 4) -> str:
    return ", ".join(f"round({c}, {places}) as {c}" for c in names)


PERFORMANCE = ["annualized_return", "annualized_vol", "sharpe_annual", "psr_vs_zero", "cumulative_return", "max_drawdown", "hit_rate"]
DEFLATED = ["sharpe_variance", "expected_max_sharpe_annual", "deflated_sharpe_ratio"]
OVERFIT = ["pbo", "logit_mean", "logit_median"]


@query("b5_return_moments", sql(f"""{RETURNS}, m as (select series_id, avg(ret) a, stddev_samp(ret) d from s group by 1)
    select series_id, count(*) as n, round(any_value(a), 6) as mean, round(any_value(d), 6) as sd, round(any_value(a / d), 6) as sharpe, round(avg(pow(ret - a, 3)) / pow(any_value(d), 3), 5) as skew,
        round(avg(pow(ret - a, 4)) / pow(any_value(d), 4), 5) as kurt from s join m using (series_id) group by 1""", "predictions"))
def b5m(spark, sf_dir):
    main = backtest.strategy(daily(spark, sf_dir), KEYS, "forecast", "outcome")
    m = backtest.moments(main, KEYS, "strategy_return")
    return m.select("series_id", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "sharpe")], F.round("skew", 5).alias("skew"), F.round("kurt", 5).alias("kurt"))


def folded(spark, sf_dir):
    return daily(spark, sf_dir).withColumn("fold_id", F.year("ts"))


@query("b4_a8_sharpe_per_fold", sql(f"{RETURNS} select series_id, year(ts) as fold_id, round(avg(ret) / stddev_samp(ret) * sqrt(252), 4) as sharpe_annual from s group by 1, 2", "predictions"))
def b4(spark, sf_dir):
    main = backtest.strategy(folded(spark, sf_dir), [*KEYS, "fold_id"], "forecast", "outcome")
    out = rounded(backtest.sharpe(main, [*KEYS, "fold_id"], "strategy_return"), 4)
    return out.withColumn("fold_id", F.col("fold_id").cast("bigint"))


@query("b6_b7_deflated_sharpe", sql(f"{report_sql(0)} select series_id, n_trials, {rounded_sql(DEFLATED)} from deflated", "predictions"))
def b7(spark, sf_dir):
    return rounded(backtest.walk_forward_report(folded(spark, sf_dir), KEYS, "forecast", "outcome", "fold_id")["deflated_sharpe"], 4)


@query("b8_b9_overfitting", sql(f"{report_sql(0)} select series_id, n_combinations, {rounded_sql(OVERFIT)} from pbo", "predictions"))
def b8(spark, sf_dir):
    variants, names = backtest.variant_returns(daily(spark, sf_dir), KEYS, "forecast", "outcome")
    return rounded(backtest.overfitting(variants, KEYS, names), 4)


@query("b10_backtest_report", sql(f"""{report_sql(0.0001)}, held as (select series_id, ts, outcome as ret from d), both_paths as (select 'strategy' as path, * from ({performance_sql('s')}) union all select 'buy_and_hold', * from ({performance_sql('held')}))
    select series_id, path, n, {rounded_sql(PERFORMANCE)}, n_trials, {rounded_sql(DEFLATED)}, n_combinations, {rounded_sql(OVERFIT)} from both_paths join deflated using (series_id) join pbo using (series_id)""", "predictions"))
def b10(spark, sf_dir):
    """Strategy and buy-and-hold side by side, with the deflated Sharpe ratio."""
    report = backtest.walk_forward_report(folded(spark, sf_dir), KEYS, "forecast", "outcome", "fold_id", fee_bps=1)
    rows = report["strategy"].withColumn("path", F.lit("strategy")).unionByName(report["buy_and_hold"].withColumn("path", F.lit("buy_and_hold")))
    return rounded(rows.join(report["deflated_sharpe"], KEYS).join(report["pbo"], KEYS), 4)


@query("a2_counts", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2")
def a2(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("a3_feature_families", sql("""w as (select p_a, p_n, p_r, eurusd, inflation, ln(p_a) as p_a_logret1, p_n as p_n_ma520, p_r - p_a as spread_r_a from market_wide),
    u as (select * from w unpivot include nulls (v for feature in (p_a, p_n, p_r, eurusd, inflation, p_a_logret1, p_n_ma520, spread_r_a))),
    f as (select feature, case when ends_with(feature, '_logret1') then 'log return' when ends_with(feature, '_ma520') then 'average ratio' when starts_with(feature, 'spread_') then 'spread' else 'level' end as family, count(v) as c from u group by 1)
    select family, count(*) as n, cast(sum(c) as bigint) as filled from f group by 1""", "market_wide"))
def a3(spark, sf_dir):
    wide = market_wide(spark, sf_dir).withColumns({"p_a_logret1": F.ln("p_a"), "p_n_ma520": F.col("p_n"), "spread_r_a": F.col("p_r") - F.col("p_a")})
    return robustness.families(wide, [c for c in wide.columns if c not in ("ts", "series_id")])


@query("a4_a6_r8_profile", sql("""u as (unpivot (select ts, p_a, eurusd, case when ts > date '1997-01-01' then inflation end as inflation from market_wide) on p_a, eurusd, inflation into name feature value v)
    select feature, count(v) as n, min(ts) filter (where v is not null) as first, max(ts) filter (where v is not null) as last, round(avg(v), 5) as mean, round(stddev_samp(v), 5) as std from u group by 1""", "market_wide"))
def a4(spark, sf_dir):
    wide = market_wide(spark, sf_dir).withColumn("inflation", F.when(F.col("ts") > "1997-01-01", F.col("inflation")))
    return rounded(robustness.profile(wide, ["p_a", "eurusd", "inflation"]), 5)


@query("a5_bundle_validation", sql("""a as (select series_id, ts, value from flag_daily where day(ts) <> 3), b as (select series_id, ts, case when month(ts) = 2 then value + 1 else value end as value from flag_daily where day(ts) <> 4)
    select count(*) as rows, count(*) filter (where a.ts is null or b.ts is null) as missing, count(*) filter (where abs(a.value - b.value) > 1e-6) as different
    from a full join b on a.series_id = b.series_id and a.ts = b.ts""", "flag_daily"))
def a5(spark, sf_dir):
    d = flag_daily(spark, sf_dir)
    left = d.where(F.dayofmonth("ts") != 3)
    right = d.where(F.dayofmonth("ts") != 4).withColumn("value", F.when(F.month("ts") == 2, F.col("value") + 1).otherwise(F.col("value")))
    return robustness.bundle_differences(left, right, ["series_id", "ts"], ["value"])


@query("a10_top_rows", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def a10(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


def two_scores(spark, sf_dir):
    return predictions(spark, sf_dir).withColumn("other", F.col("probability") + F.col("forecast") * 0.3)


@query("x1_bootstrap_auc_gap")
def x1(spark, sf_dir):
    return robustness.bootstrap_auc_gap(two_scores(spark, sf_dir), "other", "probability")


GAP = "(sum({0}) filter (where actual = 1) - n1 * (n1 + 1) / 2.0) / (n1 * n0)"


@query("x1_auc_gap", sql(f"""x as (select actual, probability as a, probability + forecast * 0.3 as b from predictions where probability is not null and forecast is not null),
    r as (select actual, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb from x),
    n as (select count(*) filter (where actual = 1)::double as n1, count(*) filter (where actual = 0)::double as n0 from x)
    select round({GAP.format('rb')} - {GAP.format('ra')}, 6) as delta from r, n group by n1, n0""", "predictions"))
def x1_gap(spark, sf_dir):
    """The gap of the rows as they are, by the bootstrap's own ranges, without a replicate."""
    return rounded(robustness.bootstrap_auc_gap(two_scores(spark, sf_dir), "other", "probability", replicates=0).select("delta"))


CUTS = ["1996-01-01", "1997-01-01", "1998-01-01", "1999-01-01"]


LAST_CUT = "list_max(list_filter([" + ", ".join(f"date '{c}'" for c in CUTS) + "], lambda c: c < ts))"
AGES = "case when ts <= last + interval 1 month then '0-1m' when ts <= last + interval 3 month then '1-3m' when ts <= last + interval 6 month then '3-6m' when ts <= last + interval 12 month then '6-12m' end"


@query("x2_ageing", sql(f"""x as (select actual, probability, ts, {LAST_CUT} as last from predictions), y as (select * from (select actual, probability, {AGES} as age from x) where age is not null),
    {AUC.format('probability', 'age', 'y')}
    select age, count(*) as n, round((sum(rk) filter (where actual = 1) - count(*) filter (where actual = 1) * (count(*) filter (where actual = 1) + 1) / 2.0) / (count(*) filter (where actual = 1) * count(*) filter (where actual = 0)), 6) as auc from r group by 1""", "predictions"))
def x2(spark, sf_dir):
    """All rows: those before the first cutoff or a year after the last have no age, those of a cutoff's own day belong to the one before."""
    return rounded(robustness.ageing_auc(predictions(spark, sf_dir), CUTS, "ts", "actual", "probability"))


@query("x4_multi_scale_windows", sql(f"""n as (select series_id, ts, value, row_number() {W} as rn, ln(value) - lag(ln(value)) {W} as lr from brand_daily),
    v as (select *, case when count(lr) over (partition by series_id order by ts rows between 19 preceding and current row) >= 10 then stddev_pop(lr) over (partition by series_id order by ts rows between 19 preceding and current row) end as vol from n),
    t as (select *, ntile(3) over (partition by series_id, vol is null order by vol) - 1 as regime from v)
    select series_id, cast(regime as int) as regime, count(*) as n from t where rn >= 64 and vol is not null group by 1, 2""", "brand_daily"))
def x4(spark, sf_dir):
    r = Rolling(KEYS)
    panel = brand_daily(spark, sf_dir).withColumn("lr", r.log_return(F.col("value"))).withColumn("vol", r.std(F.col("lr"), 20, 10))
    panel = robustness.regime(panel, KEYS, "vol")
    scales = None
    for lookback in (16, 32, 64):
        part = windows.sliding(panel, KEYS, lookback=lookback).select("series_id", "end", F.col("prices").alias(f"prices_{lookback}"), *(["regime"] if lookback == 16 else []))
        scales = part if scales is None else scales.join(part, ["series_id", "end"])
    return scales.where("regime is not null").groupBy("series_id", "regime").agg(F.count("*").alias("n"))


@query("x5_cross_asset_block", sql(f"""q as (select series_id, ts, ln(p_a) - lag(ln(p_a)) {W} as a, ln(eurusd) - lag(ln(eurusd)) {W} as b from market_wide)
    select ts, round(a, 6) as p_a_logret1, round(b, 6) as eurusd_logret1,
    round(case when count(case when a is not null and b is not null then 1 end) over (partition by series_id order by ts rows between 19 preceding and current row) >= 10 then corr(a, b) over (partition by series_id order by ts rows between 19 preceding and current row) end, 5) as eurusd_corr from q""", "market_wide"))
def x5(spark, sf_dir):
    out = robustness.asset_block(market_wide(spark, sf_dir), KEYS, "p_a", ["eurusd"])
    return out.select("ts", F.round("p_a_logret1", 6).alias("p_a_logret1"), F.round("eurusd_logret1", 6).alias("eurusd_logret1"), F.round("eurusd_corr", 5).alias("eurusd_corr"))


@query("x7_channel_strategy", sql(f"""{shapes.shapes('flag_daily', 0.30)}, s as (select series_id, "end" as ts, future_return * case label when 'ascending_channel' then 1 when 'descending_channel' then -1 else 0 end as ret from indexed where "end" % 5 = 0 and future_return is not null)
    select series_id, n, {rounded_sql(PERFORMANCE)} from ({performance_sql('s', periods=50)})""", "flag_daily"))
def x7(spark, sf_dir):
    """Long ascending and short descending channels, one position per five days, without overlap."""
    rows = windows.label(windows.sliding(cal.resample_business(flag_daily(spark, sf_dir), KEYS, ["value"]), KEYS), 0.30)
    r = Rolling(KEYS, "end")
    rows = rows.withColumn("outcome", F.try_divide(F.lead("price", 5).over(r.w), F.col("price")) - 1).where("`end` % 5 = 0 and outcome is not null")
    rows = rows.withColumn("forecast", F.when(F.col("label") == "ascending_channel", 1.0).when(F.col("label") == "descending_channel", -1.0).otherwise(0.0))
    return rounded(backtest.performance(backtest.strategy(rows, KEYS, "forecast", "outcome", order="end"), KEYS, "strategy_return", "end", 50), 4)


@query("x8_volatility_persistence", sql(f"""q as (select series_id, ts, ln(value) - lag(ln(value)) {W} as lr from brand_daily),
    v as (select series_id, case when count(lr) over b = 10 then stddev_pop(lr) over b end as x, case when count(lr) over f = 10 then stddev_pop(lr) over f end as y from q
        window b as (partition by series_id order by ts rows between 9 preceding and current row), f as (partition by series_id order by ts rows between 1 following and 10 following)),
    m as (select series_id, median(x) mx, median(y) my from v where x is not null and y is not null group by 1)
    select series_id, count(*) as n, round(corr(x, y), 5) as corr, round(avg(cast((x > mx) = (y > my) as int)), 6) as hit from v join m using (series_id) where x is not null and y is not null group by 1""", "brand_daily"))
def x8(spark, sf_dir):
    r = Rolling(KEYS)
    out = robustness.volatility_persistence(brand_daily(spark, sf_dir).withColumn("lr", r.log_return(F.col("value"))), KEYS, "lr", 10)
    return out.select("series_id", "n", F.round("corr", 5).alias("corr"), F.round("hit", 6).alias("hit"))


@query("risk_tail", sql(f"""q as (select series_id, ln(value) - lag(ln(value)) {W} as lr from brand_daily), c as (select series_id, quantile_cont(lr, 0.01) as q from q group by 1)
    select series_id, count(lr) as n, round(-any_value(c.q), 5) as var, round(-avg(lr) filter (where lr <= c.q), 5) as es from q join c using (series_id) group by 1""", "brand_daily"))
def risk_tail(spark, sf_dir):
    r = Rolling(KEYS)
    return rounded(robustness.tail_risk(brand_daily(spark, sf_dir).withColumn("lr", r.log_return(F.col("value"))), KEYS, "lr"), 5)


@query("risk_ewma_volatility", sql("""q as (select series_id, ts, row_number() over (partition by series_id order by ts) as i, coalesce(pow(ln(value) - lag(ln(value)) over (partition by series_id order by ts), 2), 0) as s from flag_daily)
    select a.series_id, a.ts, round(sqrt(sum(0.06 * pow(0.94, a.i - b.i) * b.s)), 5) as ewma_vol from q a join q b on a.series_id = b.series_id and b.i <= a.i group by 1, 2""", "flag_daily"))
def risk_ewma(spark, sf_dir):
    r = Rolling(KEYS)
    out = robustness.ewma_volatility(flag_daily(spark, sf_dir).withColumn("lr", r.log_return(F.col("value"))), KEYS, "lr", rows=400)
    return rounded(out.select("series_id", "ts", "ewma_vol"), 5)


@query("risk_stability_index", sql("""c as (select cast(probability > 0.2 as int) + cast(probability > 0.4 as int) + cast(probability > 0.6 as int) as cell, count(*) filter (where ts <= date '2000-08-20') as a, count(*) filter (where ts > date '2000-08-20') as b from predictions group by 1),
    s as (select a / sum(a) over () as p, b / sum(b) over () as q from c) select round(sum((q - p) * ln(q / p)), 6) as psi from s""", "predictions"))
def risk_psi(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("recent", F.col("ts") > "2000-08-20")
    return rounded(robustness.stability_index(rows, "probability", "recent", [0.2, 0.4, 0.6]))
