"""Positions, strategy returns, Sharpe statistics and overfitting."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .calendar import by_time
from .features import equity

#: The signals whose returns are compared for overfitting: name, rule, threshold.
VARIANTS = [("sign", "sign", 0.0), ("long_only", "long_only", 0.0), ("thr_lo", "threshold", 0.001), ("thr_hi", "threshold", 0.003), ("proportional", "proportional", 0.0)]
EULER_GAMMA = 0.5772156649015329


def position(rule: str, forecast: Column, keys: list[str], threshold: float = 0.0) -> Column:
    """The position a forecast calls for; "proportional" scales by the deviation of the key's forecasts."""
    if rule == "sign":
        return F.signum(forecast)
    if rule == "long_only":
        return F.when(forecast > threshold, 1.0).otherwise(0.0)
    if rule == "threshold":
        return F.when(forecast > threshold, 1.0).when(forecast < -threshold, -1.0).otherwise(0.0)
    if rule == "proportional":
        scaled = forecast / (F.stddev_pop(forecast).over(Window.partitionBy(*keys)) + 1e-8)
        return F.greatest(F.least(scaled, F.lit(1.0)), F.lit(-1.0))
    raise ValueError(f"unknown rule {rule}")


def strategy(df: DataFrame, keys: list[str], forecast: str, realized: str, rule: str = "sign", threshold: float = 0.0, fee_bps: float = 0.0, order: str = "ts") -> DataFrame:
    """Add ``position`` and ``strategy_return``: position times outcome less a fee on the change, from a position of 0."""
    df = df.withColumn("position", position(rule, F.col(forecast), keys, threshold))
    change = F.abs(F.col("position") - F.lag("position", 1, 0.0).over(by_time(keys, order)))
    return df.withColumn("strategy_return", F.col("position") * F.col(realized) - change * (fee_bps / 1e4))


def moments(df: DataFrame, keys: list[str], returns: str) -> DataFrame:
    """(keys, n, mean, sd, sharpe, skew, kurt): per period; population moments over the sample deviation."""
    x = F.col(returns)
    sums = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    spread = F.col("sd") > 0
    share = (F.col("n") - 1) / F.col("n")  # of the sample variance that is the population's
    return sums.select(
        *keys, "n", "mean", "sd", F.coalesce(F.try_divide(F.col("mean"), F.col("sd")), F.lit(0.0)).alias("sharpe"),
        F.coalesce(F.when(spread, F.col("g1") * F.pow(share, 1.5)), F.lit(0.0)).alias("skew"), F.coalesce(F.when(spread, (F.col("g2") + 3) * F.pow(share, 2)), F.lit(3.0)).alias("kurt"),
    )


@F.udf(DoubleType())
def normal_cdf(z):
    """Spark SQL has no error function; this runs on one row per key."""
    return None if z is None else NormalDist().cdf(z)


@F.udf(DoubleType())
def expected_max_sharpe(variance, trials):
    """What the best of some skill-less trials is expected to reach; 0 for fewer than two or no variance."""
    if not trials or trials < 2 or not variance or variance <= 0:
        return 0.0
    inverse = NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - EULER_GAMMA) * inverse(1 - 1 / trials) + EULER_GAMMA * inverse(1 - 1 / (trials * math.e)))


def probabilistic_sharpe(stats: DataFrame, benchmark: Column | None = None, name: str = "psr") -> DataFrame:
    """Add the probability that the true Sharpe ratio per period exceeds ``benchmark``; null below four rows."""
    spread = 1 - F.col("skew") * F.col("sharpe") + (F.col("kurt") - 1) / 4 * F.pow("sharpe", 2)
    above = F.col("sharpe") if benchmark is None else F.col("sharpe") - benchmark
    z = above * F.sqrt(F.col("n") - 1) / F.sqrt(F.greatest(spread, F.lit(1e-12)))
    return stats.withColumn(name, normal_cdf(F.when(F.col("n") >= 4, z)))


def performance(df: DataFrame, keys: list[str], returns: str, order: str = "ts", periods: int = 252) -> DataFrame:
    """(keys, n, cumulative and annual return, annual volatility, Sharpe, PSR, drawdown, hit rate)."""
    curve = equity(df, keys, returns, order)
    moving = F.col(returns) != 0
    path = curve.groupBy(*keys).agg(
        (F.max_by("equity", order) - 1).alias("cumulative_return"),
        F.min("drawdown").alias("max_drawdown"),
        F.coalesce(F.avg(F.when(moving, (F.col(returns) > 0).cast("double"))), F.lit(0.0)).alias("hit_rate"),
    )
    stats = probabilistic_sharpe(moments(df, keys, returns), name="psr_vs_zero")
    stats = stats.select(
        *keys, "n", (F.col("mean") * periods).alias("annualized_return"), (F.coalesce("sd", F.lit(0.0)) * math.sqrt(periods)).alias("annualized_vol"),
        (F.col("sharpe") * math.sqrt(periods)).alias("sharpe_annual"), "psr_vs_zero",
    )
    return stats.join(path, keys) if keys else stats.join(F.broadcast(path))


def sharpe(df: DataFrame, keys: list[str], returns: str, periods: int = 252) -> DataFrame:
    """(keys, sharpe_annual): 0 below two rows or without deviation."""
    ratio = F.coalesce(F.try_divide(F.avg(returns), F.stddev_samp(returns)), F.lit(0.0)) * math.sqrt(periods)
    return df.groupBy(*keys).agg(ratio.alias("sharpe_annual"))


def deflated_sharpe(df: DataFrame, keys: list[str], returns: str, trials: DataFrame, trial: str = "sharpe_annual", periods: int = 252) -> DataFrame:
    """(keys, n_trials, sharpe_variance, expected_max_sharpe_annual, deflated_sharpe_ratio).

    ``trials`` are the annual Sharpe ratios tried, by key; those that are not finite are left out.
    """
    finite = F.when(~F.isnan(trial) & (F.abs(F.col(trial)) != float("inf")), F.col(trial))
    tried = trials.groupBy(*keys).agg(F.count(finite).alias("n_trials"), F.coalesce(F.var_samp(finite), F.lit(0.0)).alias("sharpe_variance"))
    tried = tried.withColumn("expected_max_sharpe_annual", expected_max_sharpe("sharpe_variance", "n_trials"))
    stats = moments(df, keys, returns)
    joined = stats.join(tried, keys) if keys else stats.join(F.broadcast(tried))
    out = probabilistic_sharpe(joined, F.col("expected_max_sharpe_annual") / math.sqrt(periods), "deflated_sharpe_ratio")
    return out.select(*keys, "n_trials", "sharpe_variance", "expected_max_sharpe_annual", "deflated_sharpe_ratio")


def overfitting(df: DataFrame, keys: list[str], returns: list[str], order: str = "ts", partitions: int = 16) -> DataFrame:
    """(keys, pbo, n_combinations, logit_mean, logit_median) by combinatorially symmetric cross-validation.

    Periods form an even number of blocks. Every half of them picks its best column (the first among
    equals), whose rank on the other half, equals ranked in column order, gives a logit. Only block
    sums, a few numbers, meet the combinations: those are numbered, and a task makes its range of
    numbers into combinations by itself and hands on how often each rank came up.
    """
    blocks = partitions + partitions % 2
    size = Window.partitionBy(*keys)
    placed = df.withColumns({"_n": F.count("*").over(size), "_i": F.row_number().over(size.orderBy(order)) - 1})
    blocks_of = F.greatest(F.lit(2), F.least(F.lit(blocks), F.col("_n")))
    blocks_of = (blocks_of - blocks_of % 2).cast("int")
    # Blocks of equal length but for the first ones, which have one row more.
    long, short = F.col("_n") % F.col("_s"), F.floor(F.col("_n") / F.col("_s"))
    edge = long * (short + 1)
    block = F.when(F.col("_i") < edge, F.floor(F.col("_i") / (short + 1))).otherwise(long + F.floor((F.col("_i") - edge) / F.greatest(short, F.lit(1))))
    sums = placed.withColumn("_s", blocks_of).groupBy(*keys, "_s", block.cast("int").alias("_b")).agg(F.count("*").alias("_c"), *[F.sum(r).alias(r) for r in returns])
    items = sums.groupBy(*keys, "_s").agg(F.sort_array(F.collect_list(F.struct("_b", F.col("_c").cast("double").alias("_c"), F.array(*[F.coalesce(F.col(r).cast("double"), F.lit(0.0)) for r in returns]).alias("v")))).alias("blocks"))
    ranges = F.ceil(_halves("_s", blocks) / COMBINATIONS).cast("bigint")
    parts = items.where("_s >= 2").select(
        *keys, F.transform("blocks", lambda b: b["_c"]).alias("counts"), F.flatten(F.transform("blocks", lambda b: b["v"])).alias("values"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), ranges - 1)).alias("_part"),
    )
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def ranks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                counts = np.array(row["counts"], float)
                values = np.array(row["values"], float).reshape(len(counts), -1)
                low = int(row["_part"]) * COMBINATIONS
                chosen = combinations(len(counts), np.arange(low, min(low + COMBINATIONS, math.comb(len(counts), len(counts) // 2))))
                inside, outside = (_means(mask, counts, values) for mask in (chosen, ~chosen))
                best = inside.argmax(axis=1)
                own = outside[np.arange(len(best)), best][:, None]
                below = ((outside < own) | ((outside == own) & (np.arange(len(returns)) <= best[:, None]))).sum(axis=1)
                for k, n in enumerate(np.bincount(below, minlength=len(returns) + 1)):
                    if n:
                        yield pd.DataFrame([[*(row[c] for c in keys), k, n]], columns=[*keys, "below", "n"])

    found = parts.repartition(F.xxhash64(*keys, "_part")).mapInPandas(ranks, (kinds + ", " if kinds else "") + "below int, n bigint")
    w = F.least(F.greatest(F.col("below") / (len(returns) + 1), F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = found.groupBy(*keys, "below").agg(F.sum("n").alias("n")).select(*keys, "n", F.ln(w / (1 - w)).alias("logit"))
    total = F.sum("n")
    return logit.groupBy(*keys).agg(
        (F.sum(F.when(F.col("logit") <= 0, F.col("n")).otherwise(0)) / total).alias("pbo"), total.alias("n_combinations"),
        (F.sum(F.col("logit") * F.col("n")) / total).alias("logit_mean"), F.percentile("logit", 0.5, F.col("n")).alias("logit_median"),
    )


#: Combinations that a task makes at a time.
COMBINATIONS = 1 << 14


def _halves(size: str, most: int) -> Column:
    """How many halves so many blocks have."""
    return F.coalesce(*[F.when(F.col(size) == k, F.lit(math.comb(k, k // 2))) for k in range(2, most + 1, 2)])


def combinations(size: int, numbers: np.ndarray) -> np.ndarray:
    """The halves of ``size`` blocks with these numbers, in the order of their bit masks, as rows of booleans."""
    left, numbers = np.full(len(numbers), size // 2), numbers.copy()
    out = np.zeros((len(numbers), size), bool)
    table = np.array([[math.comb(n, k) for k in range(size // 2 + 1)] for n in range(size)])
    for block in range(size - 1, -1, -1):
        below = table[block][left]  # halves of the blocks before this one alone
        out[:, block] = (left > 0) & (numbers >= below)
        numbers = numbers - np.where(out[:, block], below, 0)
        left = left - out[:, block]
    return out


def _means(chosen: np.ndarray, counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Each column's mean over the chosen blocks, added up in their order."""
    total = np.zeros((len(chosen), values.shape[1]))
    for k in range(len(counts)):
        total += np.where(chosen[:, k, None], values[k], 0.0)
    return total / (chosen @ counts)[:, None]


def variant_returns(df: DataFrame, keys: list[str], forecast: str, realized: str, fee_bps: float = 0.0, order: str = "ts") -> tuple[DataFrame, list[str]]:
    """A column of returns for each of the signal variants."""
    for name, rule, threshold in VARIANTS:
        df = strategy(df, keys, forecast, realized, rule, threshold, fee_bps, order).withColumnRenamed("strategy_return", f"r_{name}").drop("position")
    return df, [f"r_{name}" for name, _, _ in VARIANTS]


def walk_forward_report(df: DataFrame, keys: list[str], forecast: str, realized: str, fold: str, fee_bps: float = 0.0, order: str = "ts") -> dict[str, DataFrame]:
    """Strategy and buy-and-hold performance, Sharpe per fold, deflated Sharpe and overfitting, by key."""
    df = df.dropna(subset=[forecast, realized])
    main = strategy(df, keys, forecast, realized, fee_bps=fee_bps, order=order)
    by_fold = sharpe(strategy(df, [*keys, fold], forecast, realized, fee_bps=fee_bps, order=order), [*keys, fold], "strategy_return")
    variants, names = variant_returns(df, keys, forecast, realized, fee_bps, order)
    return {
        "strategy": performance(main, keys, "strategy_return", order),
        "buy_and_hold": performance(df, keys, realized, order),
        "sharpe_per_fold": by_fold,
        "deflated_sharpe": deflated_sharpe(main, keys, "strategy_return", by_fold),
        "pbo": overfitting(variants, keys, names, order),
    }
