"""Leakage-safe splits: ratios, cut-off dates, purged and embargoed folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positioned(windows: DataFrame, keys: list[str], order: str = "end") -> DataFrame:
    """Add ``win_idx``, the window's place in its series, and ``n_windows``, the series' count."""
    w = Window.partitionBy(*keys)
    return windows.withColumns({"win_idx": F.row_number().over(w.orderBy(order)) - 1, "n_windows": F.count("*").over(w)})


def by_bounds(train_end: Column, valid_end: Column) -> Column:
    at = F.col("win_idx")
    return F.when(at < train_end, "train").when(at < valid_end, "valid").otherwise("test")


def split_by_ratio(windows: DataFrame, keys: list[str], train: float, valid: float, order: str = "end") -> DataFrame:
    """Add ``split``: the first int(n * train) windows, those up to int(n * (train + valid)), the rest."""
    n = F.col("n_windows")
    bounds = by_bounds(F.floor(n * F.lit(train)), F.floor(n * F.lit(train + valid)))
    return positioned(windows, keys, order).withColumn("split", bounds)


def split_by_count(windows: DataFrame, keys: list[str], train_count: int, valid_part: float = 0.10, order: str = "end") -> DataFrame:
    """Add ``split`` where the first ``train_count`` windows are given: their tail is for validation."""
    valid = min(max(round(train_count * valid_part), 1), max(train_count - 1, 1))
    return positioned(windows, keys, order).withColumn("split", by_bounds(F.lit(max(0, train_count - valid)), F.lit(train_count)))


def split_by_date(rows: DataFrame, keys: list[str], cutoff=None, part: float = 0.70, date: str = "end_date", order: str = "end") -> DataFrame:
    """Add ``split``: train up to ``cutoff``, test after it; without one the first int(part * n) rows are train."""
    if cutoff is not None:
        return rows.withColumn("split", F.when(F.col(date) <= F.lit(cutoff), "train").otherwise("test"))
    placed = positioned(rows, keys, order)
    return placed.withColumn("split", F.when(F.col("win_idx") < F.floor(F.col("n_windows") * F.lit(part)), "train").otherwise("test")).drop("win_idx", "n_windows")


def information_span(windows: DataFrame, max_future: int) -> DataFrame:
    """Add ``left`` and ``right``, the first and last row a window and its target look at."""
    return windows.withColumns({"left": F.col("start"), "right": F.col("end") - 1 + max_future})


def _near(subject: Column, split: str, embargo: int) -> Column:
    """Whether a ``subject`` window's span meets the span of ``split``, or it lies within the embargo around it."""
    overlap = (F.col("left") <= F.col(f"{split}_right")) & (F.col("right") >= F.col(f"{split}_left"))
    at = F.col("win_idx")
    around = ((at > F.col(f"{split}_last")) & (at <= F.col(f"{split}_last") + embargo)) | ((at < F.col(f"{split}_first")) & (at >= F.col(f"{split}_first") - embargo))
    return subject & (overlap | (around if embargo > 0 else F.lit(False)))


def purge(rows: DataFrame, group: list[str], embargo: int) -> DataFrame:
    """Drop train windows near valid or test, and valid windows near test.

    ``rows`` have split, win_idx, left and right. What a split spans is the envelope of all its
    windows before any is dropped, one row per group, joined back.
    """
    part = lambda s, c: F.when(F.col("split") == s, F.col(c))
    w = Window.partitionBy(*group)
    marked = rows.withColumns(
        {f"{s}_{n}": f(part(s, c)).over(w) for s in ("valid", "test") for n, f, c in (("left", F.min, "left"), ("right", F.max, "right"), ("first", F.min, "win_idx"), ("last", F.max, "win_idx"))}
    )
    train, valid = F.col("split") == "train", F.col("split") == "valid"
    bad = F.coalesce(_near(train, "valid", embargo), F.lit(False)) | F.coalesce(_near(train, "test", embargo), F.lit(False)) | F.coalesce(_near(valid, "test", embargo), F.lit(False))
    return marked.where(~bad).select(*rows.columns)


def walk_forward(
    windows: DataFrame, keys: list[str], n_splits: int, max_future: int, embargo: int = 0, valid_fraction: float = 0.15, min_train: int = 64, rolling: int | None = None, order: str = "end"
) -> DataFrame:
    """(keys, fold_id, win_idx, split): walk-forward folds, purged and embargoed.

    Windows in order form ``n_splits`` + 1 blocks; each block but the first is tested after a
    history of all windows before it, or of the last ``rolling``, whose tail is for validation.
    Folds with too little history or training left, or without validation, are left out and the
    others numbered from 0. Only positions are multiplied by the folds; join them to the windows.
    """
    placed = information_span(positioned(windows, keys, order), max_future).select(*keys, "win_idx", "left", "right")
    w = Window.partitionBy(*keys).orderBy("win_idx")
    placed = placed.withColumn("block", F.ntile(n_splits + 1).over(w) - 1)
    blocks = placed.groupBy(*keys, "block").agg(F.min("win_idx").alias("test_from"), F.max("win_idx").alias("test_to")).where("block > 0")
    history = F.least(F.col("test_from"), F.lit(rolling)) if rolling else F.col("test_from")
    blocks = blocks.withColumn("history", history).where(F.col("history") >= min_train)
    n_valid = F.least(F.greatest(F.lit(1), F.bround(F.col("history") * F.lit(valid_fraction)).cast("int")), F.col("history") - 1)
    blocks = blocks.withColumn("n_valid", n_valid)
    spread = placed.drop("block").join(blocks, keys).where((F.col("win_idx") <= F.col("test_to")) & (F.col("win_idx") >= F.col("test_from") - F.col("history")))
    at = F.col("win_idx")
    spread = spread.withColumn("split", F.when(at >= F.col("test_from"), "test").when(at >= F.col("test_from") - F.col("n_valid"), "valid").otherwise("train"))
    kept = purge(spread.select(*keys, "block", "win_idx", "left", "right", "split"), [*keys, "block"], embargo)
    fold = Window.partitionBy(*keys, "block")
    kept = kept.withColumns({"_train": F.sum((F.col("split") == "train").cast("int")).over(fold), "_valid": F.sum((F.col("split") == "valid").cast("int")).over(fold)})
    kept = kept.where((F.col("_train") >= min_train) & (F.col("_valid") > 0))
    number = F.dense_rank().over(Window.partitionBy(*keys).orderBy("block")) - 1
    return kept.withColumn("fold_id", number).select(*keys, "fold_id", "win_idx", "split")


def holdout(windows: DataFrame, keys: list[str], max_future: int, embargo: int = 0, train: float = 0.72, valid: float = 0.08, order: str = "end") -> DataFrame:
    """(keys, win_idx, split): one purged and embargoed split at rounded bounds."""
    placed = information_span(positioned(windows, keys, order), max_future)
    n = F.col("n_windows")
    split = by_bounds(F.bround(n * F.lit(train)), F.bround(n * F.lit(train + valid)))
    return purge(placed.withColumn("split", split).select(*keys, "win_idx", "left", "right", "split"), keys, embargo).select(*keys, "win_idx", "split")


def fold_column(windows: DataFrame, folds: DataFrame, fold_id: int, keys: list[str], order: str = "end") -> DataFrame:
    """Add ``split`` of one fold to the windows; those outside it get "none"."""
    one = folds.where(F.col("fold_id") == fold_id).select(*keys, "win_idx", "split")
    return positioned(windows, keys, order).join(one, [*keys, "win_idx"], "left").withColumn("split", F.coalesce("split", F.lit("none"))).drop("n_windows")


def standardize_by_train(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation of the train rows; a deviation of 0 counts as 1."""
    one = rows.where("split = 'train'").agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return rows.join(F.broadcast(one)).withColumns(scaled).select(*rows.columns)
