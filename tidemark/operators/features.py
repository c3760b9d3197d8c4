"""Rolling, lagged and cross-series features; all frames are rows of one series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .calendar import by_time, fill_backward, fill_forward, finite


class Rolling:
    """Column builders over the series of ``keys`` in the order of ``ts``."""

    def __init__(self, keys: list[str], ts: str = "ts"):
        self.keys, self.ts = keys, ts

    @property
    def w(self):
        return by_time(self.keys, self.ts)

    def frame(self, rows: int):
        return self.w.rowsBetween(1 - rows, 0)

    def least(self, x: Column, rows: int, enough: int, value: Column) -> Column:
        """``value`` once the frame has ``enough`` non-null x."""
        return F.when(F.count(x).over(self.frame(rows)) >= enough, value)

    def log_return(self, x: Column) -> Column:
        return F.ln(x) - F.ln(F.lag(x).over(self.w))

    def change(self, x: Column, lag: int = 1) -> Column:
        return F.try_divide(x, F.lag(x, lag).over(self.w)) - 1

    def mean(self, x: Column, rows: int, enough: int) -> Column:
        return self.least(x, rows, enough, F.avg(x).over(self.frame(rows)))

    def std(self, x: Column, rows: int, enough: int) -> Column:
        return self.least(x, rows, enough, F.stddev_pop(x).over(self.frame(rows)))

    def maximum(self, x: Column, rows: int, enough: int) -> Column:
        return self.least(x, rows, enough, F.max(x).over(self.frame(rows)))

    def gap(self, x: Column, rows: int, enough: int) -> Column:
        return F.try_divide(x, self.mean(x, rows, enough)) - 1

    def drawdown(self, x: Column, rows: int = 60, enough: int = 10) -> Column:
        return F.try_divide(x, self.maximum(x, rows, enough)) - 1

    def zscore(self, x: Column, rows: int) -> Column:
        enough = max(3, rows // 4)
        return F.try_divide(x - self.mean(x, rows, enough), F.nullif(self.std(x, rows, enough), F.lit(0.0)))

    def correlation(self, x: Column, y: Column, rows: int = 20, enough: int = 10) -> Column:
        both = F.when(x.isNotNull() & y.isNotNull(), 1)
        return finite(self.least(both, rows, enough, F.corr(x, y).over(self.frame(rows))))

    def spike(self, x: Column, rows: int) -> tuple[Column, callable]:
        """The volatility of x, and from its column the ratio to its own rolling mean; none: 1."""
        enough = max(3, rows // 4)
        return self.std(x, rows, enough), lambda base: F.coalesce(base / (self.mean(base, rows, enough) + 1e-8), F.lit(1.0))

    def average_range(self, x: Column, rows: int = 14) -> tuple[Column, callable]:
        """The absolute change, 0 on the first row, and from its column the rolling mean."""
        step = F.when(F.row_number().over(self.w) == 1, F.lit(0.0)).otherwise(F.abs(x - F.lag(x).over(self.w)))
        return step, lambda s: self.mean(s, rows, 1)

    def ahead(self, agg, x: Column, rows: int) -> Column:
        return agg(x).over(self.w.rowsBetween(1, rows))

    def upcoming_flag(self, flag: Column, rows: int) -> Column:
        return F.coalesce(self.ahead(F.max, flag, rows), F.lit(0))


def equity(df: DataFrame, keys: list[str], returns: str, ts: str = "ts", block: int | None = None) -> DataFrame:
    """Add equity (the running product of 1 + r), its peak and the drawdown; a return of -1 ends at zero.

    The product is two sums and a maximum, of signs, logarithms and zeros, so series longer than
    ``block`` run by ranges, see :mod:`.scan`.
    """
    growth = 1 + F.col(returns)
    df = scan.run(
        df, keys, ts,
        {"_turns": (scan.TOTAL, F.when(growth < 0, 1).otherwise(0)), "_logs": (scan.TOTAL, F.ln(F.abs(growth))), "_gone": (scan.MAXIMUM, F.when(growth == 0, 1).otherwise(0))},
        block,
    )
    worth = F.coalesce(F.exp("_logs"), F.lit(1.0)) * F.pow(F.lit(-1.0), F.col("_turns"))
    df = df.withColumn("equity", F.when(F.col("_gone") == 1, 0.0).otherwise(worth)).drop("_turns", "_logs", "_gone")
    df = scan.run(df, keys, ts, {"peak": (scan.MAXIMUM, F.col("equity"))}, block)
    return df.withColumn("drawdown", F.try_divide(F.col("equity"), F.col("peak")) - 1)


def future_targets(df: DataFrame, keys: list[str], value: str, horizon: int, sr_horizon: int, ts: str = "ts") -> DataFrame:
    """Return at ``horizon``, and the low and high over ``sr_horizon`` rows, as ratios and as prices."""
    r = Rolling(keys, ts)
    v = F.col(value)
    low, high = r.ahead(F.min, v, sr_horizon), r.ahead(F.max, v, sr_horizon)
    enough = F.count(v).over(r.w.rowsBetween(1, sr_horizon)) == sr_horizon
    return df.withColumns(
        {
            "future_return": F.try_divide(F.lead(v, horizon).over(r.w), v) - 1,
            "support_price": F.when(enough, low),
            "resistance_price": F.when(enough, high),
            "support_ratio": F.when(enough, F.try_divide(low, v) - 1),
            "resistance_ratio": F.when(enough, F.try_divide(high, v) - 1),
        }
    )


def market_features(df: DataFrame, keys: list[str], value: str = "value", eurusd: str | None = None, inflation: str | None = None, ts: str = "ts", warmup: str = "bfill") -> DataFrame:
    """The full feature set of one target series, beside an optional currency and price-index series.

    ``warmup``: "bfill" fills the first rows from later ones, which lets the future into them;
    "drop" leaves rows with a missing feature out. All features share one partitioning and order,
    so the plan has one shuffle and one sort.
    """
    r = Rolling(keys, ts)
    given = [c for c in df.columns if c not in (*keys, ts)]
    df = fill_backward(fill_forward(df, keys, given, ts), keys, given, ts)
    v = F.col(value)
    df = df.withColumns({"log_return": r.log_return(v), "pct_change": r.change(v)})
    lr = F.col("log_return")
    cols = {
        "vol_10": r.std(lr, 10, 5),
        "vol_20": r.std(lr, 20, 10),
        "ma_10": r.mean(v, 10, 5),
        "ma_30": r.mean(v, 30, 10),
        "gap_10": r.gap(v, 10, 5),
        "gap_30": r.gap(v, 30, 10),
        "max_60": r.maximum(v, 60, 10),
        "drawdown_60": r.drawdown(v),
        "zscore_20": r.zscore(v, 20),
    }
    if eurusd:
        df = df.withColumn("eurusd_return", r.log_return(F.col(eurusd)))
        df = df.withColumn("return_spread", lr - F.col("eurusd_return"))
        cols |= {"eurusd_corr_20": r.correlation(lr, F.col("eurusd_return")), "spread_zscore": r.zscore(F.col("return_spread"), 20)}
    else:
        cols |= {c: F.lit(0.0) for c in ("eurusd_return", "return_spread", "eurusd_corr_20", "spread_zscore")}
    if inflation:
        cols |= {
            "inflation_21": r.change(F.col(inflation), 21),
            "inflation_126": r.change(F.col(inflation), 126),
            "real_return": lr - F.coalesce(r.change(F.col(inflation), 21), F.lit(0.0)) / 21,
        }
    else:
        cols |= {"inflation_21": F.lit(0.0), "inflation_126": F.lit(0.0), "real_return": lr}
    df = df.withColumns(cols)
    names = [c for c in df.columns if c not in (*keys, ts)]
    df = df.withColumns({c: finite(F.col(c).cast("double")) for c in names})
    if warmup == "bfill":
        df = fill_backward(df, keys, names, ts)
    return df.dropna(subset=names)


def rename_target(df: DataFrame, target: str, name: str = "value") -> DataFrame:
    """The column ``target`` under the name that the library's operators take for it; another column of that name is an error."""
    if target not in df.columns or name in df.columns and name != target:
        raise ValueError(f"no column {target}, or another one named {name}")
    return df.withColumnRenamed(target, name)


def latest_starters(df: DataFrame, columns: list[str], top: int, ts: str = "ts") -> DataFrame:
    """(feature, first_valid): the columns whose first value comes latest; columns without any count as latest of all."""
    long = df.select(F.col(ts), F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("feature", "v"))
    firsts = long.groupBy("feature").agg(F.min(F.when(F.col("v").isNotNull(), F.col(ts))).alias("first_valid"))
    return firsts.orderBy(F.coalesce("first_valid", F.to_date(F.lit("9999-12-31"))).desc(), "feature").limit(top)
