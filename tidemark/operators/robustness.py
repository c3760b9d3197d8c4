"""Bootstrap, ageing, regime and risk statistics of scored series."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .calendar import row_index
from .evaluation import auc
from .features import Rolling
from .tables import store


#: Cells whose weights are drawn at a time, and cells of a bin of the tree, about; bins are at most 2 ** TOP.
CELLS, BIN_CELLS, TOP = 1024, 512, 16


def splits_of(places: np.ndarray, counts: np.ndarray, depth: int) -> list[list[float]]:
    """For each cell, at ``depth`` and below, the share of rows on the left side of each node on its way, until it is alone.

    ``places`` are sorted unsigned 64-bit numbers; a node parts them by their next bit.
    """
    out: list[list[float]] = [[] for _ in places]
    todo = [(0, len(places), depth)]
    while todo:
        lo, hi, bit = todo.pop()
        if hi - lo < 2 or bit > 63:
            continue
        cut = lo + int((((places[lo:hi] >> np.uint64(63 - bit)) & np.uint64(1)) == 0).sum())
        share = float(counts[lo:cut].sum() / counts[lo:hi].sum())
        for k in range(lo, hi):
            out[k].append(share)
        todo += [(lo, cut, bit + 1), (cut, hi, bit + 1)]
    return out


def dealt(total: int, places: np.ndarray, shares: list[list[float]], replicates: int, salt: int) -> np.ndarray:
    """How many of ``total`` draws with replacement each cell gets, a row a cell and a column a replicate.

    The draws of a node go left by a binomial count, made from the node's own counter-based generator,
    so whoever asks for a cell's draws finds the same, and all cells' draws add up to ``total``. Cells
    are asked for in the order of their places; what they share of the way is drawn once.
    """
    out = np.empty((len(places), replicates), np.int64)
    path: list[tuple[int, np.ndarray]] = []  # prefix, and the draws that come to that node
    for k, (place, way) in enumerate(zip(places.tolist(), shares, strict=True)):
        same = 0
        while same < min(len(path), len(way)) and path[same][0] == place >> (63 - same):
            same += 1
        del path[same:]
        for depth in range(same, len(way)):
            above = path[-1][1] if path else np.full(replicates, total, np.int64)
            node = (place >> (64 - depth)) if depth else 0
            left = np.random.Generator(np.random.Philox(key=np.array([node, salt << 6 | depth], np.uint64))).binomial(above, way[depth])
            path.append((place >> (63 - depth), above - left if place >> (63 - depth) & 1 else left))
        out[k] = path[len(way) - 1][1] if way else total
    return out


def bootstrap_cells(df: DataFrame, first: str, second: str, actual: str, seed: int) -> tuple[DataFrame, dict[int, int]]:
    """Rows counted by class and exact scores, with each cell's place in its class's tree and the shares on its way; and the classes' rows.

    A cell's place is a hash. The tree's upper levels come from sums by bins, of which there are at most
    2 ** TOP at any size; below, each bin is a group of its own.
    """
    counts = df.dropna(subset=[actual, first, second]).groupBy(F.col(actual).cast("int").alias("actual"), F.col(first).cast("double").alias("first"), F.col(second).cast("double").alias("second"))
    counts = store(counts.agg(F.count("*").alias("n")).withColumn("place", F.xxhash64(F.lit(seed), "actual", "first", "second")), "bootstrap-counts")
    top = min(TOP, max(0, (counts.count() // BIN_CELLS).bit_length()))
    binned = counts.withColumn("bin", F.shiftrightunsigned("place", 64 - top).cast("int") if top else F.lit(0))
    held = {}
    for r in binned.groupBy("actual", "bin").agg(F.sum("n").alias("n"), F.count("*").alias("cells")).collect():
        held.setdefault(r["actual"], np.zeros(1 << top))[r["bin"]] = r["n"]
    sums = {y: [x.reshape(1 << d, -1).sum(axis=1) for d in range(top + 1)] for y, x in held.items()}

    def ways(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        y, number = int(key[0]), int(key[1])
        places = frame["place"].to_numpy(np.int64).view(np.uint64)
        frame = frame.iloc[np.argsort(places)]
        above = []
        for d in range(top):
            node = number >> (top - d)
            above.append(float(sums[y][d + 1][2 * node] / sums[y][d][node]))
        below = splits_of(np.sort(places), frame["n"].to_numpy(), top)
        return frame.assign(shares=[above + x for x in below])[["actual", "first", "second", "n", "place", "shares"]]

    schema = "actual int, first double, second double, n bigint, place bigint, shares array<double>"
    return store(binned.groupBy("actual", "bin").applyInPandas(ways, schema), "bootstrap-cells"), {y: int(x.sum()) for y, x in held.items()}


def bootstrap_auc_gap(df: DataFrame, first: str, second: str, actual: str = "actual", replicates: int = 3000, seed: int = 7) -> DataFrame:
    """(replicates, delta, low, high, p_better): AUC(first) - AUC(second) with a 95 % interval.

    Each replicate draws as many positives and as many negatives as there are, with replacement, the
    same rows for both models. Rows are counted by class and exact scores; the draws of a class are
    dealt down a tree by binomial counts (:func:`dealt`), so totals are exact and tasks need not talk
    to each other. Tasks go through ranges of the scores once, for all replicates as matrices, and
    ranges meet in sums. ``delta`` is the gap of the rows as they are. Null scores are left out;
    without replicates only ``delta`` is told.
    """
    cells, totals = bootstrap_cells(df, first, second, actual, seed)

    def ranged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wins, below, hits = (np.zeros(replicates + 1) for _ in range(3))
        pos, neg = np.zeros(replicates + 1), np.zeros(replicates + 1)
        score = part = None
        for whole in frames:
            for at in range(0, len(whole), CELLS):
                frame = whole.iloc[at : at + CELLS]
                part = int(frame["part"].iloc[0])
                weights = np.empty((len(frame), replicates + 1))
                weights[:, 0] = frame["n"]
                places = frame["place"].to_numpy(np.int64).view(np.uint64)
                for y in frame["actual"].unique():
                    mine = np.flatnonzero(frame["actual"].to_numpy() == y)
                    mine = mine[np.argsort(places[mine])]
                    weights[mine, 1:] = dealt(totals[int(y)], places[mine], [list(x) for x in frame["shares"].iloc[mine]], replicates, seed << 1 | int(y == 1))
                values, positive = frame["score"].to_numpy(), frame["actual"].to_numpy() == 1
                for lo, hi in _equal_runs(values):
                    if values[lo] != score:  # equal scores count half
                        wins += pos * (below + neg / 2)
                        below += neg
                        hits += pos
                        pos, neg, score = np.zeros(replicates + 1), np.zeros(replicates + 1), values[lo]
                    pos += weights[lo:hi][positive[lo:hi]].sum(axis=0)
                    neg += weights[lo:hi][~positive[lo:hi]].sum(axis=0)
        if part is not None:
            wins += pos * (below + neg / 2)
            yield pd.DataFrame({"part": part, "replicate": np.arange(replicates + 1), "wins": wins, "pos": hits + pos, "neg": below + neg})

    def areas(score: str) -> DataFrame:
        ranges = cells.withColumn("score", F.col(score)).repartitionByRange("score").withColumn("part", F.spark_partition_id()).sortWithinPartitions("score")
        sums = ranges.select("score", "actual", "n", "place", "shares", "part").mapInPandas(ranged, "part int, replicate int, wins double, pos double, neg double")
        before = F.coalesce(F.sum("neg").over(Window.partitionBy("replicate").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        met = sums.withColumn("wins", F.col("wins") + F.col("pos") * before)
        return met.groupBy("replicate").agg(F.try_divide(F.sum("wins"), F.sum("pos") * F.sum("neg")).alias(score))

    drawn = F.when(F.col("replicate") > 0, F.col("d"))
    return areas("first").join(areas("second"), "replicate").withColumn("d", F.col("first") - F.col("second")).agg(
        F.count(drawn).alias("replicates"), F.max(F.when(F.col("replicate") == 0, F.col("d"))).alias("delta"),
        F.percentile(drawn, 0.025).alias("low"), F.percentile(drawn, 0.975).alias("high"), F.avg((drawn > 0).cast("double")).alias("p_better"),
    )


def _equal_runs(values: np.ndarray) -> list[tuple[int, int]]:
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(values)], strict=True))


def ageing_auc(df: DataFrame, cutoffs: list[str], date: str = "ts", actual: str = "actual", score: str = "score") -> DataFrame:
    """(age, n, auc): the AUC of rows by the age of the last model before them, in months: 0-1, 1-3, 3-6, 6-12."""
    last = F.array_max(F.filter(F.array(*[F.to_date(F.lit(c)) for c in cutoffs]), lambda c: c < F.col(date)))
    months = F.months_between(date, last)
    age = F.when(months <= 1, "0-1m").when(months <= 3, "1-3m").when(months <= 6, "3-6m").when(months <= 12, "6-12m")
    aged = df.withColumn("age", age).where("age is not null")
    return auc(aged, ["age"], actual, score).join(aged.groupBy("age").agg(F.count("*").alias("n")), "age")


def asset_block(df: DataFrame, keys: list[str], target: str, assets: list[str], rows: int = 20, enough: int = 10, ts: str = "ts") -> DataFrame:
    """Log returns of the target and the assets, and each asset's rolling correlation with the target."""
    r = Rolling(keys, ts)
    out = df.withColumns({f"{c}_logret1": r.log_return(F.col(c)) for c in (target, *assets)})
    return out.withColumns({f"{a}_corr": r.correlation(F.col(f"{target}_logret1"), F.col(f"{a}_logret1"), rows, enough) for a in assets})


def regime(df: DataFrame, keys: list[str], volatility: str, classes: int = 3) -> DataFrame:
    """Add ``regime``, the n-tile of the volatility in its series, from 0; null without one."""
    w = Window.partitionBy(*keys, F.col(volatility).isNull()).orderBy(volatility)
    return df.withColumn("regime", F.when(F.col(volatility).isNotNull(), F.ntile(classes).over(w) - 1))


def volatility_persistence(df: DataFrame, keys: list[str], returns: str, horizon: int, ts: str = "ts") -> DataFrame:
    """(keys, n, corr, hit): trailing against forward realised volatility; a hit is the same side of the series' median."""
    r = Rolling(keys, ts)
    x = F.col(returns)
    back = r.least(x, horizon, horizon, F.stddev_pop(x).over(r.frame(horizon)))
    ahead_frame = r.w.rowsBetween(1, horizon)
    ahead = F.when(F.count(x).over(ahead_frame) == horizon, F.stddev_pop(x).over(ahead_frame))
    both = df.withColumns({"_back": back, "_ahead": ahead}).dropna(subset=["_back", "_ahead"])
    medians = both.groupBy(*keys).agg(F.percentile("_back", 0.5).alias("_mb"), F.percentile("_ahead", 0.5).alias("_ma"))
    same = (F.col("_back") > F.col("_mb")) == (F.col("_ahead") > F.col("_ma"))
    return both.join(medians, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_back", "_ahead").alias("corr"), F.avg(same.cast("double")).alias("hit"))


def ewma_volatility(df: DataFrame, keys: list[str], returns: str, decay: float = 0.94, rows: int = 1000, ts: str = "ts", block: int | None = None) -> DataFrame:
    """Add ``ewma_vol`` and ``inverse_vol``: the exponentially weighted volatility over all returns so far.

    A series is cut into blocks of ``rows``. A block's running sum weighs each return by its place, and
    what the blocks before leave, one number each, is carried over their whole length: of so many of
    them as have a weight above zero in double precision, so the work is in proportion to the rows.
    ``decay`` is below 1 and ``rows`` short enough that ``decay ** rows`` is above zero.
    """
    if not 0 < decay**rows < 1:
        raise ValueError("decay and rows leave no weight")
    reach = int(745 / (-math.log(decay) * rows)) + 1
    q = F.pow(F.coalesce(F.col(returns), F.lit(0.0)), 2) * (1 - decay)
    df = row_index(df, keys, ts, "_i", block)
    df = df.withColumns({"_b": F.floor(F.col("_i") / rows), "_k": (F.col("_i") % rows).cast("double"), "_q": q})
    inside = F.sum(F.col("_q") * F.pow(F.lit(decay), -F.col("_k"))).over(Window.partitionBy(*keys, "_b").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0))
    left = df.groupBy(*keys, "_b").agg(F.sum(F.col("_q") * F.pow(F.lit(decay), rows - 1 - F.col("_k"))).alias("_v"))
    before = F.collect_list("_v").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(-reach, -1))
    carry = F.aggregate(before, F.lit(0.0), lambda a, v: a * decay**rows + v)
    df = df.join(left.select(*keys, "_b", carry.alias("_carry")), [*keys, "_b"])
    variance = F.pow(F.lit(decay), F.col("_k")) * (inside + F.col("_carry") * decay)
    df = df.withColumn("ewma_vol", F.sqrt(variance)).drop("_i", "_b", "_k", "_q", "_carry")
    return df.withColumn("inverse_vol", F.try_divide(F.lit(1.0), F.col("ewma_vol")))


def tail_risk(df: DataFrame, keys: list[str], returns: str, level: float = 0.99) -> DataFrame:
    """(keys, n, var, es): historical value at risk and expected shortfall, as losses."""
    cut = df.groupBy(*keys).agg(F.percentile(returns, 1 - level).alias("_q"))
    tail = F.when(F.col(returns) <= F.col("_q"), F.col(returns))
    return df.join(cut, keys).groupBy(*keys).agg(F.count(returns).alias("n"), (-F.first("_q")).alias("var"), (-F.avg(tail)).alias("es"))


def stability_index(df: DataFrame, column: str, recent: str, edges: list[float]) -> DataFrame:
    """(psi): the population stability index of ``column`` between rows where ``recent`` is false and true."""
    cell = F.lit(0)
    for e in edges:
        cell = cell + (F.col(column) > e).cast("int")
    counts = df.where(F.col(column).isNotNull()).groupBy(cell.alias("cell")).agg(F.sum((~F.col(recent)).cast("int")).alias("a"), F.sum(F.col(recent).cast("int")).alias("b"))
    w = Window.partitionBy()  # one row a cell
    p, q = (F.greatest(F.col(c) / F.sum(c).over(w), F.lit(1e-6)) for c in "ab")
    return counts.select(((q - p) * F.ln(q / p)).alias("x")).agg(F.sum("x").alias("psi"))


def checksums(df: DataFrame, keys: list[str], columns: list[str], buckets: int, side: str) -> DataFrame:
    """(bucket, rows and two sums of row hashes of a side): sums do not depend on the rows' order."""
    whole = lambda seed: F.sum(F.xxhash64(F.lit(seed), *keys, *columns).cast("decimal(38,0)"))
    return df.groupBy(bucket(keys, buckets)).agg(F.count("*").alias(f"{side}_n"), whole(1).alias(f"{side}_1"), whole(2).alias(f"{side}_2"))


def bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")


def bundle_differences(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-6, buckets: int = 4096) -> DataFrame:
    """(rows, missing, different): how far two frames agree: keys on one side only, values apart.

    Keys do not repeat on a side. Each side is added up by buckets of its keys, partially in every
    task; only rows of buckets whose sums differ are joined and compared value by value. So equal
    frames move nothing but the sums, and a few changes move as many buckets.
    """
    sums = store(checksums(left, keys, columns, buckets, "l").join(checksums(right, keys, columns, buckets, "r"), "bucket", "full"), "bundle-sums")
    equal = F.col("l_n").eqNullSafe(F.col("r_n")) & F.col("l_1").eqNullSafe(F.col("r_1")) & F.col("l_2").eqNullSafe(F.col("r_2"))
    odd = F.broadcast(sums.where(~equal).select("bucket"))  # at most ``buckets`` rows
    rows_of = lambda df, side: df.withColumn("bucket", bucket(keys, buckets)).join(odd, "bucket", "left_semi").select(
        *[F.col(k).alias(f"{side}k_{k}") for k in keys], F.lit(1).alias(f"_{side}"), *[F.col(c).alias(f"{side}_{c}") for c in columns]
    )
    same = scan.alike([f"lk_{k}" for k in keys], [f"rk_{k}" for k in keys])
    joined = rows_of(left, "l").join(rows_of(right, "r"), same, "full")
    apart = F.lit(False)
    for c in columns:
        apart = apart | F.coalesce(F.abs(F.col(f"l_{c}") - F.col(f"r_{c}")) > tolerance, F.lit(False)) | (F.col(f"l_{c}").isNull() != F.col(f"r_{c}").isNull())
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    found = joined.agg(F.count("*").alias("n"), F.sum((~both).cast("int")).alias("missing"), F.sum((both & apart).cast("int")).alias("different"))
    agreed = sums.where(equal).agg(F.coalesce(F.sum("l_n"), F.lit(0)).alias("agreed"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    return found.crossJoin(F.broadcast(agreed)).select((F.col("n") + F.col("agreed")).alias("rows"), count("missing").alias("missing"), count("different").alias("different"))  # one row beside one


def profile(df: DataFrame, columns: list[str], ts: str = "ts") -> DataFrame:
    """(feature, n, first, last, mean, std) of each column's non-null values."""
    long = df.select(F.col(ts).alias("_ts"), F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("feature", "v"))
    at = F.when(F.col("v").isNotNull(), F.col("_ts"))
    return long.groupBy("feature").agg(F.count("v").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))


def families(df: DataFrame, columns: list[str]) -> DataFrame:
    """(family, n, filled): the columns by the family their name tells, and how many values they hold."""
    long = df.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("name", "v"))
    n = F.col("name")
    family = (
        F.when(n.endswith("_logret1"), "log return").when(n.endswith("_vol20"), "volatility").when(n.endswith("_rangepct"), "range")
        .when(n.endswith("_ma520"), "average ratio").when(n.startswith("spread_") | n.startswith("ratio_"), "spread").otherwise("level")
    )
    by_name = long.groupBy("name").agg(F.count("v").alias("filled"))
    return by_name.groupBy(family.alias("family")).agg(F.count("*").alias("n"), F.sum("filled").alias("filled"))
