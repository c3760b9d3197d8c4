"""SQL for windows of 32 business days: their turning points, pattern scores, metrics and channel features.

The expressions follow the definitions pair by pair and triple by triple, over lists of positions; the
operators go through whole matrices instead.
"""

from __future__ import annotations

from tidemark.functions import patterns

BIN = "cast(ts as date) - greatest(0, isodow(ts) - 5)::int"


def over(rows: int) -> str:
    return f"over (partition by series_id order by ts rows between {rows - 1} preceding and current row)"


W = "over (partition by series_id order by ts)"


def every(items: str, what: str, name: str = "i") -> str:
    return f"list_transform({items}, lambda {name}: {what})"


def positions(way: str) -> str:
    """Turns of one kind, from the left, those at least three after the last one kept."""
    raw = f"list_filter(generate_series(2, 31), lambda i: f[i] - f[i - 1] {way} 0)"
    return f"list_reduce({every(raw, '[i]')}, lambda a, x: case when x[1] - a[-1] >= 3 then a || x else a end, [-100::bigint])[2:]"


def neighbours(points: str, count: int) -> str:
    """Starts of runs of so many neighbouring points."""
    return f"generate_series(1, len({points}) - {count - 1})"


def best(scores: str) -> str:
    return f"least(greatest(coalesce(list_max({scores}), 0), 0), 1)"


def twin(v: str, highs: str, lows: str) -> str:
    """Pairs of neighbouring lows at least four apart with a high between them."""
    a, b = f"{v}[{lows}[k]]", f"{v}[{lows}[k + 1]]"
    top = f"list_max(list_transform(list_filter({highs}, lambda h: h > {lows}[k] and h < {lows}[k + 1]), lambda h: {v}[h]))"
    score = f"""0.45 * (1 - least(abs({a} - {b}) / scale, 1)) + 0.35 * least(({top} - greatest({a}, {b})) / scale, 1)
        + 0.2 * greatest(least(({v}[32] - {b}) / scale, 1), 0)"""
    return best(every(neighbours(lows, 2), f"case when {lows}[k + 1] - {lows}[k] >= 4 and {top} is not null then {score} end", "k"))


def shoulders(v: str, highs: str, lows: str) -> str:
    """Triples of neighbouring highs; the neckline is the mean of the lows between the outer ones."""
    a, b, c = (f"{v}[{highs}[k + {n}]]" for n in range(3))
    neck = f"list_avg(list_transform(list_filter({lows}, lambda h: h > {highs}[k] and h < {highs}[k + 2]), lambda h: {v}[h]))"
    score = f"""0.35 * (1 - least(abs({a} - {c}) / scale, 1)) + 0.35 * least(({b} - greatest({a}, {c})) / scale, 1)
        + 0.15 * coalesce(least((least({a}, {c}) - {neck}) / scale, 1), 0) + 0.15 * greatest(least(({b} - {v}[32]) / scale, 1), 0)"""
    return best(every(neighbours(highs, 3), score, "k"))


def channel(up: str) -> str:
    return f"least(greatest(0.4 * cast({up} as int) + 0.3 * greatest(r2, 0) + 0.2 * (1 - least(rest / scale, 1)) + 0.1 * least(turns / 8, 1), 0), 1)"


FLAG = """least(greatest(0.35 * least((list_max(v[1:16]) - list_min(v[1:16])) / scale, 1) + 0.3 * greatest((v[16] - v[1]) / scale, 0)
    + 0.2 * (1 - least((list_max(v[17:32]) - list_min(v[17:32])) / scale / 0.5, 1)) + 0.15 * greatest((v[32] - list_median(v[17:32])) / scale, 0), 0), 1)"""
SIDEWAYS = """least(greatest(0.5 * (1 - least(abs(slope) * 32 / scale, 1)) + 0.25 * (1 - greatest(r2, 0)) + 0.15 * least(rest / scale, 1)
    + 0.1 * least(turns / 6, 1), 0), 1)"""

SCORES = {
    "double_bottom": twin("v", "highs", "lows"),
    "double_top": twin("u", "lows", "highs"),
    "ascending_channel": channel("slope > 0"),
    "descending_channel": channel("slope < 0"),
    "high_tight_flag": FLAG,
    "head_shoulders": shoulders("v", "highs", "lows"),
    "inverse_head_shoulders": shoulders("u", "lows", "highs"),
    "range": SIDEWAYS,
}

APART = """case when len(highs) >= 2 then abs(v[highs[1]] - v[highs[-1]]) when len(lows) >= 2 then abs(v[lows[1]] - v[lows[-1]]) else 0 end"""
METRICS = {
    "trend_slope": "slope",
    "residual_std": "rest",
    "pattern_range": "scale",
    "n_maxima": "len(highs)::double",
    "n_minima": "len(lows)::double",
    "symmetry_score": f"greatest(1 - least({APART} / scale, 1), 0)",
    "drawdown": f"list_min({every('generate_series(1, 32)', 'v[i] / list_max(v[1:i]) - 1')})",
    "volatility_ratio": "list_stddev_pop(moves[17:32]) / (list_stddev_pop(moves[1:16]) + 1e-8)",
    "compression_ratio": "(list_max(v[17:32]) - list_min(v[17:32])) / (list_max(v[1:16]) - list_min(v[1:16]) + 1e-8)",
    "breakout_strength": "(v[32] - list_median(v)) / scale",
    "return_mean": "list_avg(moves)",
    "return_std": "list_stddev_pop(moves)",
}

FEATURES = {
    "dir_asc": "cast(label <> 'descending_channel' as double)",
    "slope_norm": "slope / list_avg(p)",
    "r2": "r2",
    "resid_norm": "rest / list_avg(p)",
    "band_width": "4 * rest / list_avg(p)",
    "atr_norm": "atr / p[32]",
    "vol20": "list_stddev_pop(rets[12:31])",
    "last_ret": "rets[31]",
    "accel": f"list_sum({every('generate_series(1, 10)', 'rets[21 + i] * (i - 5.5::double)')}) / 82.5",
    "n_turn": "turns::double",
    "pos_in_channel": "least(greatest((p[32] - (middle + slope * 15.5 - 2 * rest)) / case when rest = 0 then 1e-8 else 4 * rest end, 0), 1)",
}


def shapes(panel: str, threshold: float) -> str:
    """WITH items over ``panel``; ``shaped`` has a row per window with its lists, line, scores and label."""
    scores = ", ".join(f"{x} as score_{name}" for name, x in SCORES.items())
    names = [f"score_{p}" for p in patterns.PATTERNS]
    cases = " ".join(f"when score_{p} = top then '{p}'" for p in patterns.PATTERNS)
    index = " ".join(f"when '{p}' then {k}" for k, p in enumerate(patterns.PATTERNS))
    return f"""days as (select series_id, {BIN} as ts, arg_max(value, ts) as value from {panel} group by 1, 2),
    spans as (select series_id, min(ts) as lo, max(ts) as hi from days group by 1),
    dates as (select series_id, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as ts from spans),
    daily as (select series_id, ts, last_value(value ignore nulls) {W} as value from dates left join days using (series_id, ts) where isodow(ts) < 6),
    steps as (select *, coalesce(abs(value - lag(value) {W}), 0) as step from daily),
    rowed as (select series_id, ts as end_date, value as price, row_number() {W} as "end", list(value) {over(32)} as p, avg(step) {over(14)} as atr,
        lead(value, 5) {W} / value - 1 as future_return, min(value) over t as support_price, max(value) over t as resistance_price, count(value) over t as ahead from steps
        window t as (partition by series_id order by ts rows between 1 following and 10 following)),
    smooth as (select *, "end" - 32 as start, {every('generate_series(1, 32)', '(p[greatest(i - 1, 1)] + p[i] + p[least(i + 1, 32)]) / 3')} as v from rowed where "end" >= 32),
    signed as (select *, {every('v', '-x', 'x')} as u, {every('generate_series(1, 31)', 'sign(v[i + 1] - v[i])::int')} as d, list_avg(v) as middle,
        {every('generate_series(1, 32)', '(v[i] - v[greatest(i - 1, 1)]) / greatest(v[i], 1e-8)')} as moves, {every('generate_series(1, 31)', '(p[i + 1] - p[i]) / p[i]')} as rets from smooth),
    ways as (select *, {every('generate_series(1, 31)', 'coalesce(list_filter(d[1:i], lambda x: x <> 0)[-1], 0)')} as f,
        list_sum({every('generate_series(1, 32)', '(v[i] - middle) * (i - 16.5::double)')}) / 2728 as slope, list_max(v) - list_min(v) + 1e-8 as scale from signed),
    turned as (select *, {positions('<')} as highs, {positions('>')} as lows, {every('generate_series(1, 32)', 'v[i] - middle - slope * (i - 16.5::double)')} as off,
        list_sum({every('v', '(x - middle) * (x - middle)', 'x')}) as total from ways),
    lined as (select *, len(highs) + len(lows) as turns, list_stddev_pop(off) as rest, case when total > 0 then 1 - list_sum({every('off', 'x * x', 'x')}) / total else 0 end as r2 from turned),
    scored as (select *, {scores} from lined),
    topped as (select *, greatest({', '.join(names)}) as top from scored),
    shaped as (select *, top as confidence, case when top < {threshold} then '{patterns.UNCLASSIFIED}' {cases} end as label from topped),
    indexed as (select *, cast(case label {index} else -1 end as int) as pattern_idx from shaped)"""


def rounds(columns: dict[str, str], places: int) -> str:
    return ", ".join(f"round({x}, {places}) as {name}" for name, x in columns.items())


#: The columns of a label, as the queries give them.
LABELLED = rounds({f"score_{p}": f"score_{p}" for p in patterns.PATTERNS} | {"confidence": "confidence"}, 5) + ", label, pattern_idx"
PLACE = 'series_id, start, "end", end_date, cast(cast(price as float) as double) as price'
#: Windows with ten complete rows ahead and a label.
TRAINED = "ahead = 10 and future_return is not null and label <> 'unclassified'"
