"""What the operators of this subpackage share: written tables, exact weighted cuts, gapless ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Tables written and not yet swept, and the names of those that the catalog knows.
WRITTEN: list[str] = []
NAMED: list[str] = []
#: Rows that a window's task gets when :func:`gapless_rank` deals a group into buckets.
BUCKET_ROWS = 200_000
#: Whole texts that an Arrow batch carries to a Python worker at a time.
BATCH_TEXTS = 512
#: Tables up to this many bytes may be broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is ``spark.checkpoint.dir``. A session without it gets a temporary one if it runs on one
    machine; on a cluster that would be another folder on every executor, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def short_batches(texts: DataFrame) -> DataFrame:
    """``texts``, in a session whose Arrow batches hold few rows.

    Spark's 10,000 rows are tens of MB of whole texts, held by the JVM and by the worker at once, in
    every task. The setting is the session's, since batches are made when the result is read.
    """
    conf, name = texts.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_TEXTS:
        conf.set(name, BATCH_TEXTS)
    return texts


def store(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage in a way that outlives lost executors.
    """
    # With the schema an empty table of partitions can be read too.
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name, partition_by))


def write_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> str:
    path = f"{shared_dir(df.sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def sweep(spark: SparkSession) -> int:
    """Delete the tables that this driver's operators have written so far, and say how many.

    Call it when the results that read them are written.
    """
    paths, WRITTEN[:] = list(WRITTEN), []
    names, NAMED[:] = list(NAMED), []
    for name in names:
        spark.sql(f"drop table if exists {name}")
    for path in paths:
        drop_table(spark, path)
    return len(paths)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`write_table` wrote and nothing reads any more."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, bound: int, salt: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label): all rows of ``docs`` whose id has a label, or a sample of about 0.95 * ``bound`` if they are more.

    Labels are drawn by a hash of their id, so that few enough are left to be broadcast; an id with
    several labels has the largest. Where ids repeat so often that their rows are still more than
    ``bound``, different ones are drawn by a hash of id and text, and alike ones count once.
    """
    part = lambda share, *cols: F.pmod(F.xxhash64(F.lit(salt), *cols), F.lit(1 << 30)) < int(share * (1 << 30))
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    n = usable.count()
    chosen = usable.where(part(min(1.0, 0.95 * bound / max(1, n)), id_col))
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col)
    found = rows.count()
    if found > bound:
        rows = rows.where(part(0.95 * bound / found, id_col, "text")).dropDuplicates([id_col, "text"])
    return rows.select("text", "label")


def whole_row(docs: DataFrame) -> Column:
    """All columns of a row as one, so that added columns never clash with its own; see :func:`keep_rows`."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def row_hash(docs: DataFrame) -> Column:
    """A hash of the whole row. Columns of kinds that Spark does not hash, such as maps, count as their JSON."""
    odd = lambda kind: "map<" in kind or "variant" in kind
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if odd(kind) else F.col(f"`{c}`") for c, kind in docs.dtypes])


def keep_rows(keyed: DataFrame, contested: DataFrame) -> DataFrame:
    """Rows (``_row``, ``_key``, ``_hash``) as they were: all whose key is not contested, and one for each contested key that is ``kept``.

    ``contested`` is a stored table (_key, kept). While it is small enough to be broadcast, only
    the rows of its kept keys are moved.
    """
    small = contested.count() * 128 <= BROADCAST_BYTES
    sent = F.broadcast if small else lambda df: df.hint("merge")
    one = Window.partitionBy("_key").orderBy("_hash")
    fought = keyed.join(sent(contested.where("kept").select("_key")), "_key", "left_semi")
    fought = fought.withColumn("_n", F.row_number().over(one)).where("_n = 1").select("_row.*")
    return keyed.join(sent(contested.select("_key")), "_key", "left_anti").select("_row.*").unionByName(fought)


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, part: int = 1000) -> DataFrame:
    """``rows`` left-joined with ``groups`` (one row a key, of ``size`` rows each) without a hot key.

    Groups that hold over one ``part``-th of all rows are fewer than ``part``, so they are
    broadcast; the others are joined by a shuffle, in which no key is hot. Both tables should be stored.
    """
    hot = groups.where(F.col(size) * part > rows.count())
    hot_keys = F.broadcast(hot.select(*keys))
    few = rows.join(F.broadcast(hot), keys)
    many = rows.join(hot_keys, keys, "left_anti").join(groups.join(hot_keys, keys, "left_anti"), keys, "left")
    return few.unionByName(many)


def gapless_rank(df: DataFrame, group: str, order: list[Column], name: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Number the rows of each group from 0 without gaps, however large a group is.

    Each group is dealt into hash buckets, as many as its rows make at ``bucket_rows`` each and 64; a
    bucket's offset is the number of rows in the buckets before it, so no task ever holds a whole
    group. Rows alike in ``order`` get numbers in any order among themselves. ``group`` is never
    null and has few values, so its counts are broadcast; the offsets, one for each bucket, are
    left to Spark to broadcast by their size. ``df`` is read three times, so it should be a stored table.
    """
    sizes = df.groupBy(F.col(group).alias("_g")).agg((F.count("*") / bucket_rows + 64).cast("bigint").alias("_buckets"))
    spread = df.join(F.broadcast(sizes), F.col(group) == F.col("_g")).withColumn("_b", F.pmod(F.xxhash64(*order), F.col("_buckets"))).drop("_buckets", "_g")
    counts = spread.groupBy(F.col(group).alias("_g"), F.col("_b").alias("_gb")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_g").orderBy("_gb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_g", "_gb", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy(group, "_b").orderBy(*order)
    return (
        spread.withColumn("_r", F.row_number().over(within) - 1)
        .join(offsets, (F.col(group) == F.col("_g")) & (F.col("_b") == F.col("_gb")))
        .withColumn(name, F.col("_off") + F.col("_r"))
        .drop("_b", "_g", "_gb", "_off", "_r")
    )


def weighted_cuts(
    df: DataFrame, group: str, keys: list[str], weight: str, needs: dict, slack: dict | None = None, fanout: int = 512
) -> dict:
    """For each group, where to cut its rows, ordered by ``keys``, so that the part below weighs its need.

    ``keys`` are non-null long columns. Each pass sums the weight of ``fanout`` equal intervals of the
    current key, combined on the map side, and goes on inside the interval that holds the cut, so
    the driver gets ``fanout`` rows for each group and no task a whole group. A group is done when
    a boundary lies within its ``slack`` or the cut is at one key; then the nearer side is taken.
    Returns group -> (key values, inclusive): rows with keys below those values, or equal to them
    where inclusive, are below the cut. A prefix of values means that later keys do not matter.
    """
    slack = slack or {}
    spark = df.sparkSession
    bounds = df.where(F.col(group).isin(list(needs))).groupBy(group).agg(
        *[f(k).alias(f"{n}_{k}") for k in keys for n, f in (("lo", F.min), ("hi", F.max))], F.sum(weight).alias("w")
    )
    state, done = {}, {}
    for row in bounds.collect():
        state[row[group]] = {"fixed": [], "acc": 0, "lo": row[f"lo_{keys[0]}"], "hi": row[f"hi_{keys[0]}"], "w": row["w"], "row": row}
    for g in needs:
        if g not in state:
            done[g] = ([0], False)
    while state:
        for g, s in list(state.items()):
            need = needs[g] - s["acc"]
            if len(s["fixed"]) == len(keys) - 1 and s["lo"] == s["hi"]:
                done[g] = ([*s["fixed"], s["lo"]], abs(s["w"] - need) < abs(need))
                del state[g]
            elif abs(need) <= slack.get(g, 0):
                done[g] = ([*s["fixed"], s["lo"]], False)
                del state[g]
            elif abs(s["w"] - need) <= slack.get(g, 0):
                done[g] = ([*s["fixed"], s["hi"]], True)
                del state[g]
        if not state:
            break
        steps = []
        for g, s in state.items():
            if s["lo"] == s["hi"]:
                s["fixed"].append(s["lo"])
                k = keys[len(s["fixed"])]
                s["lo"], s["hi"] = s["row"][f"lo_{k}"], s["row"][f"hi_{k}"]
            step = (s["hi"] - s["lo"]) // fanout + 1
            s["step"] = step
            steps.append((g, len(s["fixed"]), s["lo"], s["hi"], step, *(s["fixed"] + [0] * len(keys))[: len(keys)]))
        kind = df.schema[group].dataType.simpleString()
        table = spark.createDataFrame(
            steps, f"_g {kind}, _c int, _lo bigint, _hi bigint, _step bigint, " + ", ".join(f"_f{i} bigint" for i in range(len(keys)))
        )
        current = F.coalesce(*[F.when(F.col("_c") == i, F.col(k)) for i, k in enumerate(keys)])
        fits = F.lit(True)
        for i, k in enumerate(keys):
            fits = fits & ((F.col("_c") <= i) | (F.col(k) == F.col(f"_f{i}")))
        sums = (
            df.join(F.broadcast(table), F.col(group) == F.col("_g"))
            .where(fits)
            .withColumn("_k", current)
            .where(F.col("_k").between(F.col("_lo"), F.col("_hi")))
            # Not counted from _lo: the difference of two longs may not be one.
            .groupBy("_g", F.expr("_k div _step").alias("_i"))
            .agg(F.sum(weight).alias("_w"), F.min("_k").alias("_min"), F.max("_k").alias("_max"))
        )
        found: dict = {}
        for row in sums.collect():
            found.setdefault(row["_g"], []).append((row["_i"], row["_w"], row["_min"], row["_max"]))
        for g, s in state.items():
            need = needs[g]
            parts = sorted(found[g])
            for _, w, low, high in parts:
                s["lo"], s["hi"], s["w"] = low, high, w
                if s["acc"] + w >= need or low == parts[-1][2]:
                    break
                s["acc"] += w
    return done


def below(cut: tuple[list[int], bool], keys: list[str]) -> Column:
    """The condition for rows below a cut of :func:`weighted_cuts`."""
    values, inclusive = cut
    use = keys[: len(values)]
    out = F.lit(inclusive)
    for k, v in reversed(list(zip(use, values, strict=True))):
        out = (F.col(k) < F.lit(v)) | ((F.col(k) == F.lit(v)) & out)
    return out
