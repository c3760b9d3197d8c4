"""Writers of window tables, predictions, templates, encoded windows and report tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT_ROWS = 1_000_000


def write_windows(windows: DataFrame, path: str, keys: list[str] = ()) -> None:
    """Parquet, partitioned by ``keys``."""
    windows.write.mode("overwrite").partitionBy(*keys).parquet(path)


def latest_rows(rows: DataFrame, keys: list[str], order: str = "end") -> DataFrame:
    """The last row of each key."""
    own = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(own, order).alias("r")).select("r.*")


def write_predictions(rows: DataFrame, path: str, keys: list[str], order: str = "end") -> None:
    """All rows, the flagged ones, and each key's latest one as JSON."""
    rows.write.mode("overwrite").parquet(f"{path}/predictions")
    rows.where("outlier_flag = 1").write.mode("overwrite").parquet(f"{path}/outliers")
    latest_rows(rows, keys, order).write.mode("overwrite").json(f"{path}/latest")


def write_folds(folds: list[DataFrame], path: str, order: str = "end") -> None:
    """The union of the folds' predictions, sorted within files."""
    out = folds[0]
    for f in folds[1:]:
        out = out.unionByName(f)
    out.sortWithinPartitions(order).write.mode("overwrite").parquet(path)


def write_templates(templates: DataFrame, path: str) -> None:
    templates.write.mode("overwrite").json(path)


def write_encoded(windows: DataFrame, path: str, config: str) -> None:
    """Encoded windows under the hash of their configuration."""
    windows.withColumn("config", F.lit(config)).write.mode("overwrite").partitionBy("config").parquet(path)


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """A table per name, at most a million rows each: these are sheets for people."""
    for name, df in tables.items():
        df.limit(REPORT_ROWS).write.mode("overwrite").csv(f"{path}/{name}", header=True)


def published_parts(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The newest manifest's number and the parts that it lists; 0 and none if there is none."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [int(f.getPath().getName()) for f in files.listStatus(where)] if files.exists(where) else []
    whole = [v for v in found if files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{v}/_SUCCESS"))]
    return max(found, default=0), [r["part"] for r in spark.read.json(f"{path}/manifests/{max(whole)}").collect()] if whole else []


def read_encoded(spark: SparkSession, path: str, config: str) -> DataFrame | None:
    """All published windows of a configuration; None if there are none."""
    _, parts = published_parts(spark, f"{path}/{config}")
    return spark.read.parquet(*[f"{path}/{config}/{p}" for p in parts]) if parts else None


def encode_unseen(windows: DataFrame, keys: list[str], path: str, config: str, encode: Callable[[DataFrame], DataFrame]) -> int:
    """Encode those of ``windows`` whose keys are not yet stored under ``config``, and say how many.

    A run's windows are a part of their own; a new manifest, written last, publishes it, so a failed run
    changes nothing that readers see. Another configuration has another folder. Keys are not null.
    """
    spark, folder = windows.sparkSession, f"{path}/{config}"
    version, parts = published_parts(spark, folder)
    if parts:
        windows = windows.join(read_encoded(spark, path, config).select(*keys), keys, "left_anti")
    part = f"part-{uuid.uuid4().hex}"
    encode(windows.dropDuplicates(keys)).write.parquet(f"{folder}/{part}")
    made = spark.read.parquet(f"{folder}/{part}").count()
    if made or not parts:
        listed = spark.createDataFrame([(p,) for p in [*parts, part]], "part string")
        listed.coalesce(1).write.json(f"{folder}/manifests/{version + 1}")
    return made
