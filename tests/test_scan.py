"""Segmented scans: equal to plain windows, and no task above its range."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import calendar, features, scan

KEYS = ["series_id"]


@pytest.fixture(scope="module")
def series(spark):
    """A long series, one whose times crowd at its end, a short one, one without a key; nulls all over."""
    rng = random.Random(4)
    rows = []
    for key, n in (("long", 2000), ("late", 700), ("short", 3), (None, 120)):
        at = 0
        for k in range(n):
            at += rng.randint(1, 1000) if key != "late" or k < 20 else 1
            rows.append((key, at, rng.choice([None, None, rng.random() - 0.4]), rng.choice([None, k]), f"row {k}"))
    rows.append(("long", None, 0.5, 7, "no time"))
    return spark.createDataFrame(rows, "series_id string, ts bigint, x double, y int, note string").repartition(5)


def rows_of(df):
    return sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [40, 333, 100_000])
def test_fills_and_places_are_those_of_a_window(series, block):
    w = Window.partitionBy("series_id").orderBy("ts")
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    want = series.withColumns({c: F.last(c, ignorenulls=True).over(up) for c in ("x", "y")})
    assert rows_of(calendar.fill_forward(series, KEYS, ["x", "y"], block=block)) == rows_of(want)
    want = series.withColumns({c: F.first(c, ignorenulls=True).over(down) for c in ("x", "y")})
    assert rows_of(calendar.fill_backward(series, KEYS, ["x", "y"], block=block)) == rows_of(want)
    want = series.withColumn("row_idx", F.row_number().over(w) - 1)
    assert rows_of(calendar.row_index(series, KEYS, block=block)) == rows_of(want)


@pytest.mark.parametrize("block", [40, 100_000])
def test_running_results_are_those_of_a_window(series, block):
    up = Window.partitionBy("series_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    steps = {"most": (scan.MAXIMUM, F.col("x")), "least": (scan.MINIMUM, F.col("x")), "sum": (scan.TOTAL, F.col("y"))}
    want = series.withColumns({"most": F.max("x").over(up), "least": F.min("x").over(up), "sum": F.sum("y").over(up)})
    assert rows_of(scan.run(series, KEYS, "ts", steps, block)) == rows_of(want)
    whole = features.equity(series.withColumn("x", F.coalesce("x", F.lit(0.0)) / 50), KEYS, "x", block=10**9)
    assert rows_of(features.equity(series.withColumn("x", F.coalesce("x", F.lit(0.0)) / 50), KEYS, "x", block=block)) == rows_of(whole)


def test_equity_ends_at_zero_across_ranges(spark):
    rows = [("a", k, -1.0 if k == 50 else 0.01) for k in range(200)]
    got = features.equity(spark.createDataFrame(rows, "series_id string, ts int, r double"), KEYS, "r", block=20).collect()
    assert all((r["equity"] == 0) == (r["ts"] >= 50) for r in got)
    assert max(r["peak"] for r in got if r["ts"] > 60) == pytest.approx(1.01**50)


def test_ranges_are_bounded_however_times_crowd(series):
    cut = scan.ranged(series, KEYS, "ts", 50)
    sizes = {(r["series_id"], r[scan.PART]): r["count"] for r in cut.groupBy("series_id", scan.PART).count().collect()}
    assert max(sizes.values()) <= 100 and {k for k, _ in sizes} == {"long", "late", "short", None}
    assert sum(1 for k, _ in sizes if k == "long") >= 20 and sum(1 for k, _ in sizes if k == "short") == 1
    assert scan.ranged(series, KEYS, "ts", 5000) is None


def test_no_window_holds_a_series(series):
    plan = calendar.fill_forward(series, KEYS, ["x"], block=50)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2
    rows = [w for w in windows if "last(x" in w]  # over rows: by range; the other runs over the ranges' totals
    assert len(rows) == 1 and "_part" in rows[0].split("windowspecdefinition(")[1].split("ASC")[0]
    dates = series.select("series_id", F.date_from_unix_date(F.col("ts").cast("int")).alias("ts"), "x")
    assert "_part" not in calendar.fill_forward(dates, KEYS, ["x"])._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [30, 400])
def test_bounded_frames_by_chunk(series, block):
    dated = series.where("ts is not null")

    def means(df, keys):
        return df.withColumn("m", features.Rolling(keys).mean(F.col("y"), 10, 3)).withColumn("next", features.Rolling(keys).ahead(F.max, F.col("y"), 4))

    assert rows_of(scan.bounded(dated, KEYS, "ts", 9, 4, means, block)) == rows_of(means(dated, KEYS))


def test_empty_series(spark, series):
    none = series.limit(0)
    assert calendar.fill_forward(none, KEYS, ["x"], block=10).count() == 0
    assert calendar.row_index(none, KEYS, block=10).count() == 0


def test_volatility_of_many_blocks_is_the_plain_recursion(spark):
    rng = random.Random(2)
    rows = [("a", k, None if k % 17 == 3 else rng.gauss(0, 0.02)) for k in range(1500)]
    df = spark.createDataFrame(rows, "series_id string, ts bigint, r double")
    from tidemark.operators import robustness

    got = {r["ts"]: r["ewma_vol"] for r in robustness.ewma_volatility(df, KEYS, "r", rows=20, block=200).collect()}
    v = 0.0
    for _, k, r in rows:
        v = 0.94 * v + 0.06 * (r or 0.0) ** 2
        assert got[k] == pytest.approx(v**0.5, rel=1e-9)
    with pytest.raises(ValueError, match="no weight"):
        robustness.ewma_volatility(df, KEYS, "r", rows=100_000)


def test_bundles_are_compared_by_their_sums(spark):
    from tidemark.operators import robustness

    rows = [(k if k else None, float(k), None if k % 9 == 0 else k) for k in range(500)]
    left = spark.createDataFrame(rows, "key int, x double, y int")
    same = robustness.bundle_differences(left, left.repartition(7), ["key"], ["x", "y"])
    assert tuple(same.first()) == (500, 0, 0)
    joined = [n for n in same._jdf.queryExecution().optimizedPlan().toString().splitlines() if "FullOuter" in n]
    assert len(joined) == 1
    other = left.where("key is null or key <> 44").withColumn("x", F.when(F.col("key") == 7, F.col("x") + 1).when(F.col("key") == 8, F.col("x") + 1e-9).otherwise(F.col("x")))
    other = other.withColumn("y", F.when(F.col("key") == 10, None).otherwise(F.col("y"))).unionByName(spark.createDataFrame([(900, 1.0, 1)], left.schema))
    assert tuple(robustness.bundle_differences(left, other, ["key"], ["x", "y"]).first()) == (501, 2, 2)
    assert tuple(robustness.bundle_differences(left.limit(0), left.limit(0), ["key"], ["x", "y"]).first()) == (0, 0, 0)
