"""Operators on small frames with hand-derived or plainly computed answers."""

import datetime as dt
import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import patterns as P
from tidemark.operators import backtest, calendar, encode, evaluation, features, models, outliers, robustness, splits, survival, windows
from tidemark.sources import series, sinks
from tidemark.streaming import latest

KEYS = ["series_id"]
DAY = dt.date(2024, 1, 1)  # a Monday


def panel(spark, n=120, names=("a", "b"), seed=0, gaps=()):
    rng = np.random.default_rng(seed)
    rows = []
    for s in names:
        v = 50 + np.cumsum(rng.normal(size=n))
        rows += [(s, DAY + dt.timedelta(days=i), None if i in gaps else float(v[i])) for i in range(n)]
    return spark.createDataFrame(rows, "series_id string, ts date, value double")


def test_weekends_fold_into_friday_or_drop_out(spark):
    rows = [("a", DAY + dt.timedelta(days=d), float(d)) for d in (5, 6, 8)] + [("a", DAY + dt.timedelta(days=11), None)]
    df = spark.createDataFrame(rows, "series_id string, ts date, value double")
    folded = [(r.ts.day, r.value) for r in calendar.resample_business(df, KEYS, ["value"]).orderBy("ts").collect()]
    assert folded == [(5, 6.0), (8, 6.0), (9, 8.0), (10, 8.0), (11, 8.0), (12, 8.0)]
    dropped = [(r.ts.day, r.value) for r in calendar.reindex_business(df, KEYS, ["value"]).orderBy("ts").collect()]
    assert dropped == [(8, None), (9, 8.0), (10, 8.0), (11, 8.0), (12, 8.0)]


def test_standardize_picks_known_columns(spark):
    df = spark.createDataFrame([("2024-01-02", "x", "1.5"), ("bad", "y", "2"), ("2024-01-03", "z", "NaN")], "DATE string, other string, OBS_VALUE string")
    assert [tuple(r) for r in calendar.standardize(df, "oil").orderBy("date").collect()] == [(dt.date(2024, 1, 2), 1.5), (dt.date(2024, 1, 3), None)]
    with pytest.raises(ValueError):
        calendar.standardize(df.select("DATE"), "oil")


def test_readers(spark, tmp_path):
    (tmp_path / "m.csv").write_text("day,a,b\n2024-01-02,1,x\nbad,2,3\n2024-01-01,inf,4\n")
    out = series.read_market_csv(spark, str(tmp_path / "m.csv"), rename={"day": "date"}).orderBy("date").collect()
    assert [tuple(r) for r in out] == [(dt.date(2024, 1, 1), None, 4.0), (dt.date(2024, 1, 2), 1.0, None)]
    with pytest.raises(ValueError):
        series.read_market_csv(spark, str(tmp_path / "m.csv"))
    (tmp_path / "i.csv").write_text("k,date,v\nx,2024-01-05,3\n")
    assert series.read_indexed_csv(spark, str(tmp_path / "i.csv")).first().date == dt.date(2024, 1, 5)
    (tmp_path / "n.csv").write_text("feature,value\na,1.5\n")
    assert series.read_named_values(spark, str(tmp_path / "n.csv")).first().value == 1.5


def test_permuted_and_stacked_series_change_nothing(spark):
    df = panel(spark, names=("a",))
    stacked = df.unionByName(df.withColumn("series_id", F.lit("b")))
    run = lambda x: {(r.end, r.label, round(r.confidence, 9)) for r in windows.label(windows.sliding(x, KEYS)).collect()}
    assert run(df) == run(df.orderBy(F.rand(3)).repartition(3))
    both = windows.label(windows.sliding(stacked, KEYS)).groupBy("end", "label").count().collect()
    assert all(r["count"] == 2 for r in both)


def test_training_windows_skip_what_is_incomplete(spark):
    df = panel(spark, n=80, names=("a",), gaps=(50,))
    out = windows.training_windows(df, KEYS, lookback=10, horizon=3, sr_horizon=5, keep_unclassified=True).select("end", "start").collect()
    ends = sorted(r.end for r in out)
    want = [e for e in range(10, 76) if not (e - 10 <= 50 < e) and not (e <= 50 < e + 5)]
    assert ends == want and all(r.end - r.start == 10 for r in out)


def test_equity_survives_losses_of_everything(spark):
    rows = [("a", i, r) for i, r in enumerate([0.5, -0.5, 0.2, -1.0, 0.3])]
    out = features.equity(spark.createDataFrame(rows, "series_id string, ts int, r double"), KEYS, "r").orderBy("ts").collect()
    assert [round(x.equity, 9) for x in out] == [1.5, 0.75, 0.9, 0.0, 0.0]
    assert round(out[1].drawdown, 9) == -0.5


def test_chunks_carry_their_neighbours(spark):
    df = calendar.row_index(panel(spark, n=50, names=("a",)), KEYS)
    chunks = calendar.chunk_with_halo(df, KEYS, 10, 3, 2)
    sizes = {r.chunk: (r.n, r.own) for r in chunks.groupBy("chunk").agg(F.count("*").alias("n"), F.sum(F.col("in_chunk").cast("int")).alias("own")).collect()}
    assert sizes == {0: (12, 10), 1: (15, 10), 2: (15, 10), 3: (15, 10), 4: (13, 10), 5: (3, 0)} or sizes == {0: (12, 10), 1: (15, 10), 2: (15, 10), 3: (15, 10), 4: (13, 10)}


def test_folds_never_leak(spark):
    df = panel(spark, n=300, names=("a",))
    ends = windows.sliding(df, KEYS, lookback=10).select("series_id", "start", "end")
    folds = splits.walk_forward(ends, KEYS, 4, 5, 3, min_train=20).collect()
    start = {i: (i, i + 10 - 1 + 5) for i in range(291)}
    assert {f.fold_id for f in folds} == {0, 1, 2}  # the first block's history leaves no validation
    for fold in range(3):
        part = {s: [f.win_idx for f in folds if f.fold_id == fold and f.split == s] for s in ("train", "valid", "test")}
        for early, late in (("train", "valid"), ("train", "test"), ("valid", "test")):
            assert max(part[early]) < min(part[late])
            assert max(start[i][1] for i in part[early]) < min(start[i][0] for i in part[late])
            assert max(part[early]) < min(part[late]) - 3


def plain_episodes(v, lookback, confirm, min_life):
    n, out, t = len(v), [], lookback
    step = [0.0] + [abs(b - a) if a is not None and b is not None else None for a, b in zip(v, v[1:])]
    atr = []
    for i in range(n):
        part = [s for s in step[max(0, i - 13) : i + 1] if s is not None]
        atr.append(sum(part) / len(part) if part else None)
    while t <= n:
        w = v[t - lookback : t]
        if any(x is None for x in w):
            t += 1
            continue
        s = P.scores(np.array([w]))[0]
        name = P.PATTERNS[int(s.argmax())]
        if s.max() < 0.30 or name not in P.CHANNELS:
            t += 1
            continue
        slope, icept, _, sd = (float(x[0]) for x in P.line(P.smooth(np.array([w]))))
        e0 = last = t - 1
        run, way = 0, ""
        for j in range(t, n):
            if v[j] is None:
                break
            mid = icept + slope * (lookback - 1 + j - e0)
            room = 2 * sd + (atr[j] if atr[j] is not None else sd)
            up, down = v[j] > mid + room, v[j] < mid - room
            run = run + 1 if up or down else 0
            last = j
            if run >= confirm:
                way = "up" if up else "down"
                break
        if way or last - e0 >= min_life:
            out.append((e0, last - e0, way))
        t = last + 2
    return out


@pytest.mark.parametrize("confirm,min_life", [(1, 0), (2, 1), (3, 3)])
def test_episodes_match_a_plain_scan(spark, confirm, min_life):
    df = panel(spark, n=260, names=("a", "b"), seed=9, gaps=(90, 91, 180))
    got = survival.episodes(df, KEYS, lookback=16, confirm=confirm, min_life=min_life).collect()
    for s in ("a", "b"):
        v = [r.value for r in df.where(F.col("series_id") == s).orderBy("ts").collect()]
        mine = sorted(((r.start_date - DAY).days, r.duration, r.breakout_dir) for r in got if r.series_id == s)
        assert mine == plain_episodes(v, 16, confirm, min_life)
        assert all((r.end_date - r.start_date).days == r.duration and r.event == int(r.breakout_dir != "") for r in got)


@pytest.mark.parametrize("chunk,block", [(8, None), (32, 60)])
def test_episodes_across_chunks_match_a_plain_scan(spark, chunk, block):
    df = panel(spark, n=300, names=("a", "b"), seed=9, gaps=(90, 91, 180))
    got = survival.episodes(df, KEYS, lookback=16, chunk=chunk, block=block).collect()
    for s in ("a", "b"):
        v = [r.value for r in df.where(F.col("series_id") == s).orderBy("ts").collect()]
        assert sorted(((r.start_date - DAY).days, r.duration, r.breakout_dir) for r in got if r.series_id == s) == plain_episodes(v, 16, 2, 1)


def test_a_life_goes_on_over_many_chunks(spark):
    """One window's channel holds for 100 rows of chunks of 8, beside one that ends with the series and one at its last row."""
    rows = [("a", k, 10.0 + (30.0 if k in (120, 121) else 0.0), 1.0) for k in range(125)]
    series = spark.createDataFrame(rows, "series_id string, row_idx bigint, _v double, atr double")
    windows = spark.createDataFrame([("a", 20, 0.0, 10.0, 1.0), ("a", 122, 0.0, 10.0, 1.0), ("a", 124, 0.0, 10.0, 1.0)], "series_id string, row_idx bigint, _slope double, _icept double, _sd double")
    got = survival.lives(series, windows, KEYS, 16, 2.0, 1.0, 2, 8).orderBy("row_idx").collect()
    assert [(r["_last"], r["duration"], r["event"], r["breakout_dir"]) for r in got] == [(121, 101, 1, "up"), (124, 2, 0, ""), (124, 0, 0, "")]


@pytest.mark.parametrize("chunk", [2, 16, 10_000])
def test_reached_windows_are_those_of_a_walk(spark, chunk):
    rng = np.random.default_rng(chunk)
    rows = [(s, int(k), int(k + rng.integers(0, 9))) for s in ("a", "b", None) for k in np.flatnonzero(rng.random(400) < 0.3)]
    got = {(r["series_id"], r["row_idx"]) for r in survival.reached(spark.createDataFrame(rows, "series_id string, row_idx bigint, _last bigint"), KEYS, chunk).collect()}
    want = set()
    for s in ("a", "b", None):
        last = -1
        for _, k, end in [r for r in rows if r[0] == s]:
            if k > last:
                want.add((s, k))
                last = end
    assert got == want


@pytest.mark.parametrize("block", [2, 50_000])
def test_cox_finds_the_maximum_of_its_likelihood(spark, block):
    rng = random.Random(5)
    rows = [(float(rng.randint(1, 6)), int(rng.random() < 0.7), rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(80)]
    df = spark.createDataFrame(rows, "duration double, event int, x double, y double")
    beta = survival.fit_cox(df, ["x", "y"], block=block)

    def likelihood(b):
        out = -0.05 * len(rows) * float(b @ b)
        for t in sorted({r[0] for r in rows if r[1]}):
            died = [r for r in rows if r[0] == t and r[1]]
            risk = sum(math.exp(b @ r[2:]) for r in rows if r[0] >= t)
            own = sum(math.exp(b @ r[2:]) for r in died)
            out += sum(float(b @ r[2:]) for r in died) - sum(math.log(risk - k / len(died) * own) for k in range(len(died)))
        return out

    top = likelihood(beta)
    assert all(likelihood(beta + np.array(d)) <= top + 1e-9 for d in ([0.02, 0], [-0.02, 0], [0, 0.02], [0, -0.02]))


def test_efron_sums_of_any_number_of_ties():
    deaths = np.array([1, 2, 31, 33, 200, 5000])
    at_risk, died = np.array([3.0, 2.0, 40.0, 33.1, 900.0, 1e9]), np.array([0.1, 2.0, 9.0, 33.0, 80.0, 4e3])
    d, one, two = survival.efron(at_risk, died, deaths)
    for k in range(len(deaths)):
        u = at_risk[k] - np.arange(deaths[k]) / deaths[k] * died[k]
        assert d[k] == deaths[k] and one[k] == pytest.approx((1 / u).sum(), rel=1e-10) and two[k] == pytest.approx((1 / u**2).sum(), rel=1e-10)


@pytest.mark.parametrize("block", [3, 50_000])
def test_survival_curves_by_ranges(spark, block):
    rng = random.Random(12)
    rows = [(rng.choice(["a", "b", None]), float(rng.choice([0, 1, 4, rng.randint(1, 30)])), rng.randint(0, 1), rng.random() + 0.5) for _ in range(120)]
    df = spark.createDataFrame(rows, "k string, duration double, event int, risk double")
    curve = {(r.k, r.t): r for r in survival.kaplan_meier(df, ["k"], block=block).collect()}
    hazard = {r.t: r.hazard for r in survival.baseline_hazard(df, block=block).collect()}
    for key in ("a", "b", None):
        s = 1.0
        mine = [(max(t, 0.5), e) for k, t, e, _ in rows if k == key]
        for t in sorted({t for t, _ in mine}):
            at_risk, died = sum(u >= t for u, _ in mine), sum(e for u, e in mine if u == t)
            s *= 1 - died / at_risk
            assert (curve[key, t].at_risk, curve[key, t].deaths) == (at_risk, died) and curve[key, t].survival == pytest.approx(s)
    total = 0.0
    for t in sorted({max(r[1], 0.5) for r in rows}):
        total += sum(r[2] for r in rows if max(r[1], 0.5) == t) / sum(r[3] for r in rows if max(r[1], 0.5) >= t)
        assert hazard[t] == pytest.approx(total)
    test = df.withColumn("horizon", F.explode(F.array(*map(F.lit, (2.0, 5.0, 11.0))))).withColumn("survival", F.exp(-F.col("horizon") * F.col("risk") / 20))
    got = survival.integrated_brier(test, df, [2.0, 5.0, 11.0], block=block).first()
    whole = [(max(t, 0.5), e, r) for _, t, e, r in rows]

    def free(at):
        out = 1.0
        for t in sorted({t for t, _, _ in whole if t <= at}):
            out *= 1 - sum(1 - e for u, e, _ in whole if u == t) / sum(u >= t for u, _, _ in whole)
        return out

    def brier(h):
        parts = [math.exp(-h * r / 20) ** 2 / free(t) if t <= h and e else (1 - math.exp(-h * r / 20)) ** 2 / free(h) if t > h else 0.0 for t, e, r in whole]
        return sum(parts) / len(parts)

    b = [brier(h) for h in (2.0, 5.0, 11.0)]
    assert got.n_grid == 3 and got.ibs == pytest.approx((3 * (b[0] + b[1]) / 2 + 6 * (b[1] + b[2]) / 2) / 9)


def test_classification_of_a_published_kind_of_matrix(spark):
    rows = [("a", "a")] * 5 + [("a", "b")] * 3 + [("b", "b")] * 2 + [("x", "a")] * 4
    m = evaluation.confusion(spark.createDataFrame(rows, "truth string, predicted string"), ["a", "b", "c"])
    r = evaluation.classification(m).first()
    assert r.n == 10 and r.accuracy == pytest.approx(0.7) and r.balanced_accuracy == pytest.approx((5 / 8 + 1) / 2)


def test_expected_maximum_and_deflated_sharpe(spark):
    df = spark.createDataFrame([(0.5343819556850886, 3), (0.0, 5), (1.0, 1)], "v double, n int")
    out = [r[0] for r in df.select(backtest.expected_max_sharpe("v", "n")).collect()]
    assert out[0] == pytest.approx(0.623412310301679, abs=1e-6) and out[1:] == [0.0, 0.0]


def test_overfitting_matches_all_combinations(spark):
    rng = np.random.default_rng(6)
    m = np.round(rng.normal(size=(50, 4)), 2)
    df = spark.createDataFrame([("a", i, *map(float, r)) for i, r in enumerate(m)], "series_id string, ts int, p double, q double, r double, s double")
    out = backtest.overfitting(df, KEYS, ["p", "q", "r", "s"], partitions=8).first()
    blocks, logits = np.array_split(np.arange(50), 8), []
    for half in combinations(range(8), 4):
        rows = np.concatenate([blocks[b] for b in half])
        other = np.concatenate([blocks[b] for b in range(8) if b not in half])
        best = int(np.argmax(m[rows].mean(0)))
        outs = m[other].mean(0)
        w = sum((outs[k], k) <= (outs[best], best) for k in range(4)) / 5
        logits.append(math.log(w / (1 - w)))
    assert out.n_combinations == 70 and out.pbo == pytest.approx(np.mean(np.array(logits) <= 0)) and out.logit_mean == pytest.approx(np.mean(logits))


def test_combinations_are_all_halves_in_order():
    from itertools import combinations

    for size in (2, 6, 10):
        got = backtest.combinations(size, np.arange(math.comb(size, size // 2)))
        masks = [int(sum(1 << k for k in np.flatnonzero(r))) for r in got]
        assert masks == sorted(sum(1 << k for k in c) for c in combinations(range(size), size // 2))


def test_overfitting_of_many_blocks_sends_no_masks(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([("a", k, *map(float, rng.normal(size=3))) for k in range(90)], "series_id string, ts int, p double, q double, r double")
    out = backtest.overfitting(df, KEYS, ["p", "q", "r"], partitions=20)
    assert "Range (" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.first().n_combinations == math.comb(20, 10)



def test_outlier_control_matches_a_plain_loop(spark):
    rng = random.Random(7)
    rows = []
    for i in range(40):
        a = rng.random()
        rows.append(("k", i, a, 1 - a, rng.choice("ab"), rng.random(), rng.random() * 3, rng.gauss(0, 0.01)))
    df = spark.createDataFrame(rows, "series_id string, ts int, prob_a double, prob_b double, predicted_pattern string, pattern_entropy double, metric_distance double, pred_return double")
    got = {r.ts: r for r in outliers.control(df, KEYS, ["a", "b"], "ts").collect()}
    weights = outliers.decay_weights()
    assert weights[0] == pytest.approx(0.3728, abs=1e-4) and sum(weights) == pytest.approx(1)
    for i in range(40):
        h = rows[max(0, i - 9) : i + 1]
        w = np.array(weights[-len(h) :])
        w /= w.sum()
        votes = [sum(x[2 + k] * y for x, y in zip(h, w)) for k in range(2)]
        name = "ab"[int(np.argmax(votes))]
        spike = [got[x[1]].volatility_spike for x in h]
        score = sum(y * (0.45 * (1 - math.exp(-x[6])) + 0.25 * x[5] + 0.2 * math.tanh(max(s - 1, 0)) + 0.1 * (x[4] != name)) for x, y, s in zip(h, w, spike))
        assert got[i].dominant_pattern_window == name and got[i].weighted_outlier_score == pytest.approx(min(max(score, 0), 1))
        assert got[i].outlier_flag == int(score >= 0.68 or max(votes) < 0.55 or rows[i][6] >= 2.5)


def test_images_match_their_formulas():
    v = np.array([[1.0, 3.0, 2.0, 5.0]])
    phi = np.arccos(encode.to_unit_band(v)[0])
    assert np.allclose(encode.angular_field(v)[0], np.cos(phi[:, None] + phi[None, :]))
    assert np.allclose(encode.angular_field(v, True)[0], np.sin(phi[:, None] - phi[None, :]))
    assert (encode.to_unit_band(np.full((1, 4), 2.0)) == 0).all()
    x = np.arange(12.0).reshape(1, 3, 4)
    want = np.stack([np.interp(np.linspace(0, 1, 7), np.linspace(0, 1, 4), r) for r in x[0]])
    want = np.stack([np.interp(np.linspace(0, 1, 5), np.linspace(0, 1, 3), c) for c in want.T], axis=1)
    assert np.allclose(encode.resize(x, 5, 7)[0], want)
    image = encode.image(np.abs(np.random.default_rng(1).normal(size=(2, 8))) + 1, np.random.default_rng(2).normal(size=(2, 8, 3)), 6)
    assert image.shape == (2, 6, 6, 3) and image.min() >= 0 and image.max() <= 255


def test_heads_are_saved_and_score_alike(spark, tmp_path):
    rng = random.Random(8)
    rows = [(x := rng.gauss(0, 1), rng.gauss(0, 1), "ascending_channel" if x > 0.3 else "descending_channel" if x < -0.3 else "range") for _ in range(150)]
    df = spark.createDataFrame(rows, "x double, y double, label string")
    heads = models.fit_heads(df, ["x", "y"], list(P.CHANNELS))
    models.save_heads(heads, str(tmp_path / "heads"))
    again = models.load_heads(str(tmp_path / "heads"), list(heads))
    a, b = (models.score_heads(df, h, ["x", "y"]).select("pred", "confidence").collect() for h in (heads, again))
    assert a == b


def test_bootstrap_interval_holds_the_gap(spark):
    rng = random.Random(9)
    rows = [(y := int(rng.random() < 0.4), min(max(rng.gauss(0.4 + 0.3 * y, 0.2), 0.0), 0.999), rng.random()) for _ in range(600)]
    out = robustness.bootstrap_auc_gap(spark.createDataFrame(rows, "actual int, good double, poor double"), "good", "poor", replicates=60).first()
    assert out.low < out.delta < out.high and out.p_better == 1.0 and out.replicates == 60


def test_sinks_and_latest_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 5, 1)], "series_id string, end int, outlier_flag int")
    sinks.write_predictions(rows, str(tmp_path / "p"), KEYS)
    assert spark.read.parquet(str(tmp_path / "p/outliers")).count() == 2
    assert {(r.series_id, r.end) for r in spark.read.json(str(tmp_path / "p/latest")).collect()} == {("a", 2), ("b", 5)}


def test_keyed_stream_tells_of_touched_series_only(spark, tmp_path):
    df = panel(spark, n=60, names=("a", "b", "c")).withColumn("ts", F.col("ts").cast("timestamp"))
    early, late = df.where("dayofyear(ts) <= 40"), df.where("dayofyear(ts) > 40 and series_id <> 'b'")
    told = 0
    for days, part in ((40, early.unionByName(early)), (60, late)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        latest.start_keyed(stream, KEYS, str(tmp_path / "out")).awaitTermination()
        got = {r.series_id: r for r in latest.newest(spark, str(tmp_path / "out"), KEYS).collect()}
        seen = early if days == 40 else df.where("dayofyear(ts) <= 40 or series_id <> 'b'")
        want = {r.series_id: r for r in latest.latest_signals(seen, KEYS).collect()}
        assert {s: (r.end_date, r.label, round(r.confidence, 9)) for s, r in got.items()} == {s: (r.end_date, r.label, round(r.confidence, 9)) for s, r in want.items()}
        rows = spark.read.parquet(str(tmp_path / "out/signals")).count()
        assert rows - told == (3 if days == 40 else 2)
        told = rows


def test_stream_keeps_the_latest_signal(spark, tmp_path):
    df = panel(spark, n=60).withColumn("ts", F.col("ts").cast("timestamp"))
    for k, part in enumerate((df.where("dayofyear(ts) <= 40"), df.where("dayofyear(ts) > 40"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        latest.start(stream, KEYS, str(tmp_path / "out")).awaitTermination()
        got = {r.series_id: r for r in latest.current(spark, str(tmp_path / "out"), KEYS).collect()}
        want = {r.series_id: r for r in latest.latest_signals(df.where(f"dayofyear(ts) <= {40 if k == 0 else 60}"), KEYS).collect()}
        assert {s: (r.end_date, r.label) for s, r in got.items()} == {s: (r.end_date, r.label) for s, r in want.items()}
        state = spark.read.parquet(str(tmp_path / f"out/state/turn={k}")).groupBy(*KEYS).count().collect()
        assert len(state) == len(want) and all(r["count"] == 32 for r in state)


@pytest.mark.parametrize("block", [15, 60, 50_000])
def test_concordance_counts_pairs_without_forming_them(spark, block):
    import itertools

    rng = random.Random(31)
    rows = [(rng.choice("ab"), rng.choice([0, 1, 2, 5, 5, 5, rng.randint(1, 90)]), rng.randint(0, 1), rng.choice([1.5, 2.5, rng.random() * 4])) for _ in range(300)]
    out = survival.concordance(spark.createDataFrame(rows, "k string, duration int, event int, risk double"), keys=["k"], block=block).collect()
    for key in "ab":
        pairs = good = 0
        for (_, t, e, r), (_, u, f, q) in itertools.permutations([x for x in rows if x[0] == key], 2):
            t, u = max(t, 0.5), max(u, 0.5)
            if e == 1 and (u > t or (u == t and f == 0)):
                pairs += 1
                good += 1.0 if r > q else 0.5 if r == q else 0.0
        (got,) = [r for r in out if r.k == key]
        assert got.comparable == pairs and got.c_index == pytest.approx(good / pairs)


def test_bootstrap_of_exact_scores(spark):
    rng = np.random.default_rng(5)
    rows = [(int(y), float(np.round(y * 0.5 + rng.normal(), 2)), float(y * 0.4 + rng.normal())) for y in rng.integers(0, 2, 300)]
    got = robustness.bootstrap_auc_gap(spark.createDataFrame(rows, "actual int, a double, b double"), "a", "b", replicates=400).first()
    y, a, b = (np.array(x) for x in zip(*rows, strict=True))
    area = lambda s, y: np.mean([(p > q) + (p == q) / 2 for p in s[y == 1] for q in s[y == 0]])
    assert got.delta == pytest.approx(area(a, y) - area(b, y))
    gaps = []
    for _ in range(150):
        at = np.concatenate([rng.choice(np.flatnonzero(y == k), (y == k).sum()) for k in (0, 1)])
        gaps.append(area(a[at], y[at]) - area(b[at], y[at]))
    assert got.replicates == 400 and got.low < got.delta < got.high
    assert got.high - got.low == pytest.approx(np.subtract(*np.percentile(gaps, [97.5, 2.5])), rel=0.25)


def test_ewma_carries_the_whole_history(spark):
    rng = random.Random(3)
    rows = [(k, rng.random() if rng.random() < 0.9 else None) for k in range(57)]
    out = robustness.ewma_volatility(spark.createDataFrame(rows, "ts int, r double").withColumn("k", F.lit(1)), ["k"], "r", rows=10).orderBy("ts").collect()
    v = 0.0
    for r, (_, x) in zip(out, rows, strict=True):
        v = v * 0.94 + 0.06 * (x or 0.0) ** 2
        assert r.ewma_vol == pytest.approx(v**0.5)
