"""Life of price channels: episodes, survival curves, proportional hazards, concordance and Brier scores."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import patterns

from . import scan
from .calendar import row_index
from .features import Rolling
from .tables import store
from .windows import channel_line, channel_shape, label, sliding


#: Rows of a chunk in which lives are followed by one task.
CHUNK = 4096
#: Windows whose lives are followed at a time, and rows that they look ahead at a time.
TOGETHER, AHEAD = 256, 64


def episodes(
    df: DataFrame,
    keys: list[str],
    value: str = "value",
    lookback: int = 32,
    threshold: float = 0.30,
    band: float = 2.0,
    tolerance: float = 1.0,
    confirm: int = 2,
    min_life: int = 1,
    ts: str = "ts",
    chunk: int = CHUNK,
    block: int | None = None,
) -> DataFrame:
    """Non-overlapping lives of price channels, one row each.

    A window labelled as a channel freezes its line and bands. The channel breaks after ``confirm``
    rows in a row beyond a band by more than ``tolerance`` average ranges of that row; it is
    censored at a null or the end of the series. The next window may end two rows after the last.

    A series may have any length: ``chunk`` rows of it are a group. Every window's life is followed to
    its end, from chunk to chunk where it is long (:func:`lives`); the window that may start next is
    looked up for all at once by a scan; and which windows are reached from the first one is found
    by doubling pointers (:func:`reached`). With ``block``, windows too are made by ranges.
    """

    def with_range(frame: DataFrame, keys: list[str]) -> DataFrame:
        r = Rolling(keys, ts)
        step, average = r.average_range(F.col(value))
        return frame.withColumn("_step", step).withColumn("atr", average(F.col("_step"))).drop("_step")

    def labelled(frame: DataFrame, keys: list[str]) -> DataFrame:
        rows = label(sliding(frame, keys, value, lookback, ts=ts), threshold).where(F.col("label").isin(*patterns.CHANNELS))
        rising = F.col("label") == patterns.CHANNELS[0]
        return rows.withColumns({"_l": channel_line("prices"), "_f": channel_shape("prices", "atr", rising)}).drop("prices")

    # The average range of a row needs the change of the row before its frame.
    series = row_index(scan.bounded(df.select(*keys, ts, value), keys, ts, 15, 0, with_range, block), keys, ts, block=block)
    series = store(series.select(*keys, "row_idx", F.col(ts).alias("_ts"), F.col(value).alias("_v"), "atr"), "channel-rows")
    plain = series.select(*keys, "row_idx", F.col("_ts").alias(ts), F.col("_v").alias(value), "atr")
    found = scan.bounded(plain.withColumnRenamed("row_idx", "_place"), keys, ts, lookback - 1, 0, labelled, block)
    windows = found.select(*keys, F.col("_place").alias("row_idx"), F.col(ts).alias("start_date"), "label", "confidence", F.col("_l.slope").alias("_slope"), F.col("_l.intercept").alias("_icept"), F.col("_l.resid_std").alias("_sd"), "_f")
    windows = store(windows, "channel-windows")
    ends = lives(series, windows, keys, lookback, band, tolerance, confirm, chunk)
    chosen = reached(ends, keys, chunk).where((F.col("breakout_dir") != "") | (F.col("duration") >= min_life))
    at = [*keys, "row_idx"]
    chosen = chosen.withColumnsRenamed({c: f"_c_{c}" for c in at})
    told = windows.drop("_slope", "_icept", "_sd").join(chosen, scan.alike(at, [f"_c_{c}" for c in at]))
    dates = series.select(*[F.col(c).alias(f"_d_{c}") for c in at], F.col("_ts").alias("end_date"))
    met = told.join(dates, scan.alike([*keys, "_last"], [f"_d_{c}" for c in at]))
    return met.select(
        *keys, "start_date", "end_date", F.regexp_replace("label", "_channel", "").alias("direction"), F.col("confidence").alias("conf_detection"),
        "duration", "event", "breakout_dir", *[F.col(f"_f.{c}").alias(c) for c in patterns.CHANNEL_FEATURES],
    )


def kinds_of(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def lives(series: DataFrame, windows: DataFrame, keys: list[str], lookback: int, band: float, tolerance: float, confirm: int, chunk: int) -> DataFrame:
    """(keys, row_idx, _last, duration, event, breakout_dir): the end of each window's channel, of stored tables.

    A round follows the open channels through the chunk they have come to, all windows of a chunk as
    matrices; those still open go on to the next chunk with the rows that they were outside for.
    """
    rows = series.select(*keys, "row_idx", "_v", "atr").withColumn("_chunk", F.floor(F.col("row_idx") / chunk))
    open_lives = windows.select(*keys, "row_idx", "_slope", "_icept", "_sd", F.lit(0).alias("_run"), (F.col("row_idx") + 1).alias("_at"))
    carried = [*keys, "row_idx", "_slope", "_icept", "_sd", "_run", "_at"]
    schema = f"{kinds_of(open_lives, carried)}, _last bigint, _way string"

    def follow(found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = wanted[carried].copy()
        if not len(found):  # the chunk after the last one
            return out.assign(_last=out["_at"] - 1, _way="").reset_index(drop=True)
        if not len(wanted):
            return out.assign(_last=pd.Series(dtype="int64"), _way=pd.Series(dtype=object))
        found = found.sort_values("row_idx")
        first = int(found["row_idx"].iloc[0])
        v, atr = found["_v"].to_numpy(float), found["atr"].to_numpy(float)
        parts = [_follow(v, atr, first, out.iloc[a : a + TOGETHER], lookback, band, tolerance, confirm) for a in range(0, len(out), TOGETHER)]
        out["_run"], out["_at"], out["_last"], out["_way"] = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(v) < chunk:  # the series ends in this chunk
            out["_last"] = np.where(out["_last"] < 0, out["_at"] - 1, out["_last"])
        # Whole numbers with none for the open ones.
        out["_last"] = out["_last"].astype("Int64").where(out["_last"] >= 0)
        return out.reset_index(drop=True)

    done = None
    while True:
        asked = open_lives.withColumn("_chunk", F.floor(F.col("_at") / chunk))
        told = store(asked.groupBy(*keys, "_chunk").cogroup(rows.groupBy(*keys, "_chunk")).applyInPandas(lambda wanted, found: follow(found, wanted), schema), "channel-lives")
        ended = told.where("_last is not null")
        done = ended if done is None else done.unionByName(ended)
        open_lives = told.where("_last is null").select(*carried)
        if open_lives.isEmpty():
            break
    return done.select(*keys, "row_idx", "_last", (F.col("_last") - F.col("row_idx")).cast("int").alias("duration"), (F.col("_way") != "").cast("int").alias("event"), F.col("_way").alias("breakout_dir"))


def _follow(v, atr, first, wanted, lookback, band, tolerance, confirm) -> tuple[np.ndarray, ...]:
    """Follow channels through a chunk of rows: rows outside so far, the next row, the last row or -1 if open, and the side of the break."""
    e0, at = wanted["row_idx"].to_numpy(), wanted["_at"].to_numpy().copy()
    slope, start, sd = (wanted[c].to_numpy(float) for c in ("_slope", "_icept", "_sd"))
    run, last, way = wanted["_run"].to_numpy().copy(), np.full(len(e0), -1), np.full(len(e0), "", dtype=object)
    todo, end = np.arange(len(e0)), first + len(v)
    while len(todo):
        j = at[todo, None] + np.arange(AHEAD)
        here = j < end
        k = np.where(here, j - first, 0)
        off = v[k] - (start[todo, None] + slope[todo, None] * (lookback - 1 + j - e0[todo, None]))
        room = band * sd[todo, None] + tolerance * np.where(np.isnan(atr[k]), sd[todo, None], atr[k])
        gone, outside = here & np.isnan(off), here & (np.abs(off) > room)
        # Rows outside up to here: since the last row inside, or since before this look.
        inside = np.maximum.accumulate(np.where(outside, -1, np.arange(AHEAD)), axis=1)
        runs = np.where(inside < 0, run[todo, None] + np.arange(1, AHEAD + 1), np.arange(AHEAD) - inside)
        stops = gone | (outside & (runs >= confirm))
        stop = np.where(stops.any(axis=1), stops.argmax(axis=1), AHEAD)
        hit = np.flatnonzero(stop < AHEAD)
        broke = ~gone[hit, stop[hit]]
        last[todo[hit]] = j[hit, stop[hit]] - ~broke
        way[todo[hit]] = np.where(broke, np.where(off[hit, stop[hit]] > 0, "up", "down"), "")
        left = np.flatnonzero(stop == AHEAD)
        seen = here[left].sum(axis=1)
        run[todo[left]] = np.where(seen > 0, np.where(outside[left, np.maximum(seen - 1, 0)], runs[left, np.maximum(seen - 1, 0)], 0), run[todo[left]])
        at[todo[left]] += seen
        todo = todo[left][at[todo[left]] < end]
    return run, at, last, way


def reached(ends: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """The rows of ``ends`` (keys, row_idx, _last and others) that follow one another from the first: each starts after the last one's end.

    The window after each one is the next in order, found by a scan back over starts and ends. Within
    a chunk these pointers are followed by a task, to the window where they leave it; between chunks
    they are doubled, so a series of n chunks needs about log2 n rounds of joins.
    """
    ends = store(ends, "channel-ends")
    starts = ends.select(*keys, (F.col("row_idx") * 2).alias("_pos"), F.col("row_idx").alias("_next"), F.lit(None).cast("bigint").alias("row_idx"))
    after = ends.select(*keys, (F.col("_last") * 2 + 1).alias("_pos"), F.lit(None).cast("bigint").alias("_next"), "row_idx")
    follows = scan.run(starts.unionByName(after), keys, "_pos", {"_next": (scan.LAST, F.col("_next"))}, backward=True).where("row_idx is not null")
    follows = store(follows.select(*keys, "row_idx", "_next", F.floor(F.col("row_idx") / chunk).alias("_chunk")), "channel-next")

    def leave(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row_idx")
        place, after = frame["row_idx"].tolist(), frame["_next"].tolist()
        exits: dict[int, float] = {}
        for a, b in zip(reversed(place), reversed(after), strict=True):
            exits[a] = b if pd.isna(b) else exits.get(int(b), b)
        frame["_exit"] = pd.array([exits[a] for a in place], dtype="Int64")
        return frame[[*keys, "row_idx", "_exit"]]

    jumps = store(follows.groupBy(*keys, "_chunk").applyInPandas(leave, f"{kinds_of(follows, [*keys, 'row_idx'])}, _exit bigint"), "channel-jumps")
    marked = store(follows.groupBy(*keys).agg(F.min("row_idx").alias("row_idx")), "channel-marks")
    left = lambda df, names: df.select(*[F.col(c).alias(f"_r_{c}") for c in names])
    pair = lambda a: scan.alike([*keys, a], [f"_r_{k}" for k in (*keys, "row_idx")])
    while not jumps.where("_exit is not null").isEmpty():
        far = left(jumps, [*keys, "row_idx", "_exit"])
        more = marked.join(far, pair("row_idx")).where("_r__exit is not null").select(*keys, F.col("_r__exit").alias("row_idx"))
        marked = store(marked.unionByName(more).distinct(), "channel-marks")
        jumps = store(jumps.where("_exit is not null").join(far, pair("_exit"), "left").select(*keys, "row_idx", F.col("_r__exit").alias("_exit")), "channel-jumps")
    entered = marked.withColumn("_entry", F.lit(1)).select(*[F.col(c).alias(f"_r_{c}") for c in (*keys, "row_idx")], "_entry")

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row_idx")
        after = dict(zip(frame["row_idx"].tolist(), frame["_next"].tolist(), strict=True))
        seen = set()
        for at in frame.loc[frame["_entry"].notna(), "row_idx"].tolist():
            while at in after and at not in seen:
                seen.add(at)
                at = after[at]
        return frame.loc[frame["row_idx"].isin(seen), [*keys, "row_idx"]]

    walked = follows.join(entered, pair("row_idx"), "left").groupBy(*keys, "_chunk").applyInPandas(walk, kinds_of(follows, [*keys, "row_idx"]))
    met = left(walked, [*keys, "row_idx"])
    return ends.join(met, pair("row_idx"), "left_semi")


def ranged(df: DataFrame, column: str, out: str, block: int = 50_000) -> tuple[DataFrame, int]:
    """``df`` with the number of the range of ``column`` that each row falls into, and how many ranges there are.

    A range holds about ``block`` distinct values. Values need not be spread evenly: cuts are quantiles of them.
    """
    values = df.select(F.col(column).alias("v")).distinct()
    ranges = max(1, -(-values.count() // block))
    found = values.agg(F.percentile_approx("v", [k / ranges for k in range(1, ranges)], max(10_000, 100 * ranges))).first()[0] if ranges > 1 else []
    splits = [-float("inf"), *sorted(set(found or [])), float("inf")]
    if len(splits) == 2:
        return df.withColumn(out, F.lit(0.0)), 1
    return Bucketizer(splits=splits, inputCol=column, outputCol=out, handleInvalid="keep").transform(df), len(splits) - 1


def running(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column], down: bool = False, part: str = "_part", ranges: int | None = None) -> DataFrame:
    """Add running sums along ``order``, from the least value up or from the greatest down.

    ``part`` numbers the ranges of ``order`` (see :func:`ranged`). A window runs within a range; what the
    ranges before it hold, one row each, is added to it, so no task gets all rows of a key. Where
    there is one range, as ``ranges`` may tell, the window is all.
    """
    way = F.desc if down else F.asc
    if ranges == 1:
        alone = Window.partitionBy(*keys, part).orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.coalesce(F.sum(x).over(alone), F.lit(0)) for c, x in sums.items()})
    df = df.withColumns({f"_x_{c}": x for c, x in sums.items()})
    inside = Window.partitionBy(*keys, part).orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(way(part)).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, part).agg(*[F.sum(f"_x_{c}").alias(f"_t_{c}") for c in sums])
    offsets = [F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums]
    totals = totals.select(*[F.col(c).alias(f"_k_{c}") for c in (*keys, part)], *offsets)
    same = F.lit(True)
    for c in (*keys, part):
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    met = df.join(totals, same).drop(*[f"_k_{c}" for c in (*keys, part)])
    added = {c: F.col(f"_o_{c}") + F.coalesce(F.sum(f"_x_{c}").over(inside), F.lit(0)) for c in sums}
    return met.withColumns(added).drop(*[f"{x}{c}" for c in sums for x in ("_x_", "_o_")])


def kaplan_meier(df: DataFrame, keys: list[str] = (), duration: str = "duration", event: str = "event", block: int = 50_000) -> DataFrame:
    """(keys, t, at_risk, deaths, survival): one row per duration, those under 0.5 counted as 0.5.

    Durations are counted first, so the sums run over distinct durations, by ranges of ``block`` of them.
    """
    keys = list(keys)
    t = F.greatest(F.col(duration).cast("double"), F.lit(0.5))
    counts = df.groupBy(*keys, t.alias("t")).agg(F.count("*").alias("_c"), F.sum(event).alias("deaths"))
    counts, ranges = ranged(counts, "t", "_part", block)
    counts = running(counts, keys, "t", {"at_risk": F.col("_c")}, down=True, ranges=ranges)
    left = 1 - F.col("deaths") / F.col("at_risk")
    counts = running(counts, keys, "t", {"_log": F.when(left > 0, F.ln(left)).otherwise(0.0), "_none": (left <= 0).cast("int")}, ranges=ranges)
    s = F.when(F.col("_none") > 0, 0.0).otherwise(F.exp("_log"))
    return counts.withColumn("survival", s).select(*keys, "t", "at_risk", "deaths", "survival")


def survival_at(curve: DataFrame, horizons: list[float], keys: list[str] = ()) -> DataFrame:
    """(keys, horizon, survival): the curve's last value at or before each horizon, 1 before the first."""
    grid = curve.withColumn("horizon", F.explode(F.array(*[F.lit(float(h)) for h in horizons])))
    return grid.groupBy(*keys, "horizon").agg(F.coalesce(F.max_by("survival", F.when(F.col("t") <= F.col("horizon"), F.col("t"))), F.lit(1.0)).alias("survival"))


def dominance(order: np.ndarray, risk: np.ndarray, count: np.ndarray, first: np.ndarray) -> tuple[float, float]:
    """Pairs of a row marked ``first`` with one of greater ``order``, and those of them of lower risk, ties half.

    The orders' bits are gone through: two orders first differ in one bit, so at each bit the rows
    of one parent that have it are ranked by risk among those that have it not. The work is
    n log n for each bit, and no pair is formed.
    """
    order = np.unique(order, return_inverse=True)[1]
    total = good = 0.0
    for bit in range(int(order.max(initial=0)).bit_length()):
        parent, upper = order >> (bit + 1), (order >> bit) & 1
        by_risk = np.lexsort((risk, parent))
        p, r, c = parent[by_risk], risk[by_risk], np.where(upper[by_risk] == 1, count[by_risk], 0.0)
        sums = np.r_[0.0, np.cumsum(c)]
        new_parent = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        new_value = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (r[1:] != r[:-1])])
        place = lambda heads: np.searchsorted(heads, np.arange(len(p)), side="right") - 1
        ends = lambda heads: np.r_[heads[1:], len(p)]
        base = sums[new_parent][place(new_parent)]
        below, up_to = sums[new_value][place(new_value)] - base, sums[ends(new_value)][place(new_value)] - base
        mine = np.where((upper[by_risk] == 0) & first[by_risk], count[by_risk], 0.0)
        total += float(mine @ (sums[ends(new_parent)][place(new_parent)] - base))
        good += float(mine @ ((below + up_to) / 2))
    return total, good


def concordance(df: DataFrame, risk: str = "risk", duration: str = "duration", event: str = "event", keys: list[str] = (), block: int = 50_000) -> DataFrame:
    """(keys, comparable, c_index): Harrell's index; ties of risk count half.

    A pair compares if the shorter life ended in an event; of equally long lives the event comes
    first. Rows are counted by (duration, event, risk) first and dealt into ranges of duration and
    of risk of about ``block`` of these cells. Pairs within a range of duration are counted there,
    those of two such ranges within a range of risk there (see :func:`dominance`), and all others
    from the ranges' counts alone. So no pairs are joined and no task gets more than a range.
    A range grows with the root of the cells where that is more than ``block``, so the grid of ranges
    never has more rows than there are cells. Rows without risk or duration do not compare.
    """
    keys = list(keys)
    cells = df.groupBy(*keys, F.greatest(F.col(duration).cast("double"), F.lit(0.5)).alias("t"), F.col(event).cast("int").alias("e"), F.col(risk).cast("double").alias("risk"))
    cells = cells.agg(F.count("*").cast("double").alias("c")).dropna(subset=["t", "e", "risk"])
    found = cells.count()
    ranges = max(1, -(-found // max(block, math.isqrt(found))))
    cuts = cells.agg(*[F.percentile_approx(c, [k / ranges for k in range(1, ranges)], max(10_000, 100 * ranges)) for c in ("t", "risk")]).first() if ranges > 1 else (None, None)
    for c, out, found in zip(("t", "risk"), ("bt", "br"), cuts, strict=True):
        splits = [-float("inf"), *sorted(set(found or [])), float("inf")]
        cells = Bucketizer(splits=splits, inputCol=c, outputCol=out).transform(cells) if len(splits) > 2 else cells.withColumn(out, F.lit(0.0))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = (kinds + ", " if kinds else "") + "comparable double, good double"

    def within(column: str):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            order = frame["bt"].to_numpy()
            if column == "bt":
                order = np.unique(np.stack([frame["t"].to_numpy(), frame["e"].to_numpy() == 0], axis=1), axis=0, return_inverse=True)[1].ravel()
            found = dominance(order, frame["risk"].to_numpy(), frame["c"].to_numpy(), frame["e"].to_numpy() == 1)
            return pd.DataFrame([[*(frame[k].iloc[0] for k in keys), *found]], columns=[*keys, "comparable", "good"])

        return run

    parts = cells.groupBy(*keys, "bt").applyInPandas(within("bt"), schema)
    if ranges > 1:
        parts = parts.unionByName(cells.groupBy(*keys, "br").applyInPandas(within("br"), schema))
        grid = cells.groupBy(*keys, "bt", "br").agg(F.sum("c").alias("c"), F.sum(F.when(F.col("e") == 1, F.col("c")).otherwise(0.0)).alias("d"))
        # A full grid of ranges; its rows and columns are windows of ``ranges`` cells.
        numbers = F.sequence(F.lit(0), F.lit(ranges)).cast("array<double>")
        full = grid.select(*keys, "bt").distinct().withColumn("br", F.explode(numbers)).join(grid, [*keys, "bt", "br"], "left").fillna(0.0, ["c", "d"])
        along = Window.partitionBy(*keys, "bt").orderBy("br")
        later = Window.partitionBy(*keys, "br").orderBy(F.desc("bt")).rowsBetween(Window.unboundedPreceding, -1)
        full = full.withColumn("low", F.coalesce(F.sum("c").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        full = full.withColumn("other", F.sum("c").over(Window.partitionBy(*keys, "bt")) - F.col("c"))
        sums = full.withColumns({"low": F.coalesce(F.sum("low").over(later), F.lit(0.0)), "other": F.coalesce(F.sum("other").over(later), F.lit(0.0))})
        parts = parts.unionByName(sums.select(*keys, (F.col("d") * F.col("other")).alias("comparable"), (F.col("d") * F.col("low")).alias("good")))
    out = parts.groupBy(*keys).agg(F.sum("comparable").cast("bigint").alias("comparable"), F.sum("good").alias("good"))
    return out.select(*keys, "comparable", F.try_divide("good", F.col("comparable").cast("double")).alias("c_index"))


def efron(at_risk: np.ndarray, died: np.ndarray, deaths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each duration its deaths and the sums of 1 / u and 1 / u**2 over Efron's total weights u, in closed form.

    With a weight W at risk, D of it dying in d deaths, u is W - (l / d) D for l = 0 .. d - 1. A mean weighted like
    that is a / u + b for two numbers a and b of its duration, so these sums are all that ties need.
    """
    d = deaths.astype(float)
    x = at_risk / died * d
    near = np.minimum(d, 32)
    k = np.arange(32)
    direct = x[:, None] - d[:, None] + 1 + k
    counted = k < near[:, None]
    many = d - near
    low, high = x - d + near + 0.5, x + 0.5
    # The rest of a harmonic sum by the midpoint rule and its first two corrections.
    one = (counted / direct).sum(1) + np.log1p(many / low) - (low**-2.0 - high**-2.0) / 24 + 7 / 960 * (low**-4.0 - high**-4.0)
    two = (counted / direct**2).sum(1) + many / (low * high) - (low**-3.0 - high**-3.0) / 12 + 7 / 240 * (low**-5.0 - high**-5.0)
    return d, one * d / died, two * (d / died) ** 2


def fit_cox(df: DataFrame, features: list[str], duration: str = "duration", event: str = "event", penalty: float = 0.1, steps: int = 25, block: int = 50_000) -> np.ndarray:
    """Coefficients of a proportional-hazards model with Efron's ties and an L2 penalty per row.

    Every Newton step is one aggregation by duration of exp(xb), its moments and those of the
    events. Tasks go through ranges of durations, each from what longer ranges hold, and sum the
    terms of all ties in closed form (see :func:`efron`); the driver gets a row per range and
    solves a system of as many unknowns as features.
    """
    p = len(features)
    beta = np.zeros(p)
    t = F.greatest(F.col(duration).cast("double"), F.lit(0.5)).alias("t")
    base = df.select(t, F.col(event).cast("double").alias("e"), *[F.col(f).cast("double").alias(f"x{k}") for k, f in enumerate(features)])
    base, ranges = ranged(base, "t", "part", block)
    base = base.cache()
    i, j = np.triu_indices(p)
    n = base.count()
    products = [F.lit(1.0), *[F.col(f"x{k}") for k in range(p)], *[F.col(f"x{a}") * F.col(f"x{b}") for a, b in zip(i, j, strict=True)]]
    width = len(products)

    def square(flat: np.ndarray) -> np.ndarray:
        out = np.zeros((p, p))
        out[i, j] = out[j, i] = flat
        return out

    def terms_of(longer: dict[float, np.ndarray]):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("t", ascending=False)
            held = np.stack(frame["held"].to_numpy())
            at_risk = np.cumsum(held, axis=0) + longer.get(float(frame["part"].iloc[0]), 0.0)
            died, own, deaths = np.stack(frame["died"].to_numpy()), np.stack(frame["own"].to_numpy()), frame["d"].to_numpy()
            some = deaths > 0
            gradient, hessian = own[some].sum(0), np.zeros((p, p))
            if some.any():
                w, v = at_risk[some], died[some]
                d, one, two = efron(w[:, 0], v[:, 0], deaths[some])
                b = v[:, 1:] / v[:, :1]
                a = w[:, 1:] - b * w[:, :1]
                means = a * one[:, None] + b * d[:, None]
                gradient = gradient - means[:, :p].sum(0)
                a1, b1 = a[:, :p], b[:, :p]
                cross = (a1 * one[:, None]).T @ b1
                outer = (a1 * two[:, None]).T @ a1 + cross + cross.T + (b1 * d[:, None]).T @ b1
                hessian = outer - square(means[:, p:].sum(0))
            return pd.DataFrame({"g": [gradient.tolist()], "h": [hessian.ravel().tolist()]})

        return run

    for _ in range(steps):
        xb = F.lit(0.0)
        for k in range(p):
            xb = xb + F.col(f"x{k}") * F.lit(float(beta[k]))
        weighed, dead = base.withColumn("w", F.exp(xb)), F.col("e") == 1
        held = F.array(*[F.sum(F.col("w") * x) for x in products]).alias("held")
        longer, so_far = {}, np.zeros(width)
        if ranges > 1:
            for row in weighed.groupBy("part").agg(held).orderBy(F.desc("part")).collect():
                longer[row["part"]] = so_far
                so_far = so_far + np.array(row["held"])
        died = F.array(*[F.sum(F.when(dead, F.col("w") * x).otherwise(0.0)) for x in products]).alias("died")
        own = F.array(*[F.sum(F.when(dead, x).otherwise(0.0)) for x in products[1 : 1 + p]]).alias("own")
        by_time = weighed.groupBy("part", "t").agg(held, died, own, F.sum(dead.cast("bigint")).alias("d"))
        parts = by_time.groupBy("part").applyInPandas(terms_of(longer), "g array<double>, h array<double>").collect()
        gradient = np.sum([r["g"] for r in parts], axis=0) - penalty * n * beta
        hessian = np.sum([r["h"] for r in parts], axis=0).reshape(p, p) - penalty * n * np.eye(p)
        move = np.linalg.solve(hessian, gradient)
        beta = beta - move
        if np.abs(move).max() < 1e-9:
            break
    base.unpersist()
    return beta


def cox_risk(df: DataFrame, features: list[str], beta: np.ndarray) -> DataFrame:
    """Add ``risk``, the partial hazard exp(xb)."""
    xb = F.lit(0.0)
    for f, b in zip(features, beta, strict=True):
        xb = xb + F.col(f) * F.lit(float(b))
    return df.withColumn("risk", F.exp(xb))


def baseline_hazard(df: DataFrame, duration: str = "duration", event: str = "event", block: int = 50_000) -> DataFrame:
    """(t, hazard): Breslow's cumulative baseline hazard from rows with a ``risk``, by ranges of ``block`` durations."""
    t = F.greatest(F.col(duration).cast("double"), F.lit(0.5))
    counts = df.groupBy(t.alias("t")).agg(F.sum("risk").alias("_r"), F.sum(event).alias("_d"))
    counts = running(ranged(counts, "t", "_part", block)[0], [], "t", {"_at": F.col("_r")}, down=True)
    return running(counts, [], "t", {"hazard": F.col("_d") / F.col("_at")}).select("t", "hazard")


def cox_survival(df: DataFrame, hazard: DataFrame, horizons: list[float]) -> DataFrame:
    """Rows of ``df`` for each horizon with their survival there."""
    grid = hazard.withColumn("horizon", F.explode(F.array(*[F.lit(float(h)) for h in horizons])))
    steps = grid.groupBy("horizon").agg(F.coalesce(F.max(F.when(F.col("t") <= F.col("horizon"), F.col("hazard"))), F.lit(0.0)).alias("_h"))
    return df.join(F.broadcast(steps)).withColumn("survival", F.exp(-F.col("_h") * F.col("risk"))).drop("_h")


def integrated_brier(test: DataFrame, train: DataFrame, horizons: list[float], duration: str = "duration", event: str = "event", block: int = 50_000) -> DataFrame:
    """(n_grid, ibs) of test rows with ``horizon`` and ``survival``; null with fewer than two usable horizons.

    Rows are weighted by the train rows' censoring curve; the score is the trapezoid over the
    horizons strictly within the test durations.
    """
    censoring = kaplan_meier(train.withColumn("_censored", 1 - F.col(event)), duration=duration, event="_censored", block=block).select(F.col("t").alias("_t"), F.col("survival").alias("_g"))
    spans = test.agg(F.min(duration).alias("_lo"), F.max(duration).alias("_hi"))
    rows = test.join(F.broadcast(spans)).where((F.col("horizon") > F.col("_lo")) & (F.col("horizon") < F.col("_hi")))
    t = F.greatest(F.col(duration).cast("double"), F.lit(0.5))
    # The curve at all times that are asked for, joined by time. A curve never rises, so its last value is its least so far.
    asked = rows.select(t.alias("_t")).union(rows.select(F.col("horizon").cast("double"))).distinct().withColumn("_g", F.lit(None).cast("double"))
    both, _ = ranged(censoring.unionByName(asked), "_t", "_part", block)
    least = both.groupBy("_part").agg(F.min("_g").alias("_least"))
    carried = least.select("_part", F.min("_least").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_least"))  # one row a range
    inside = Window.partitionBy("_part").orderBy("_t", F.col("_g").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    curve = both.join(carried, "_part").select("_t", F.coalesce(F.least(F.min("_g").over(inside), "_least"), F.lit(1.0)).alias("_at"), F.col("_g").isNull().alias("_asked"))
    curve = curve.where("_asked").drop("_asked")
    rows = rows.withColumn("_t", t).join(curve.withColumnRenamed("_at", "_at_end"), "_t", "left").drop("_t")
    rows = rows.withColumn("_t", F.col("horizon").cast("double")).join(curve.withColumnRenamed("_at", "_at_horizon"), "_t", "left").drop("_t")
    died = (t <= F.col("horizon")) & (F.col(event) == 1)
    part = F.when(died, F.try_divide(F.pow("survival", 2), F.col("_at_end"))).when(t > F.col("horizon"), F.try_divide(F.pow(1 - F.col("survival"), 2), F.col("_at_horizon"))).otherwise(0.0)
    by_horizon = rows.groupBy("horizon").agg(F.avg(F.coalesce(part, F.lit(0.0))).alias("bs"))
    w = Window.partitionBy().orderBy("horizon")  # one row a horizon
    area = by_horizon.withColumns({"_dx": F.col("horizon") - F.lag("horizon").over(w), "_y": (F.col("bs") + F.lag("bs").over(w)) / 2})
    return area.agg(F.count("*").alias("n_grid"), F.try_divide(F.sum(F.col("_dx") * F.col("_y")), F.max("horizon") - F.min("horizon")).alias("ibs"))


def enough(train: DataFrame, test: DataFrame, event: str = "event") -> str | None:
    """Why there are too few episodes to fit and judge a model, or None."""
    counts = [df.agg(F.count("*").alias("n"), F.coalesce(F.sum(event), F.lit(0)).alias("d")).first() for df in (train, test)]
    (n_train, d_train), (n_test, d_test) = counts
    if n_train + n_test < 20:
        return f"too few episodes ({n_train + n_test})"
    if n_train < 15 or n_test < 8 or d_train < 8 or d_test < 4:
        return "too few episodes or events after the split"
    return None
