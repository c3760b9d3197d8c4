"""Encoded windows that are only encoded once."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import encode
from tidemark.sources import sinks

KEYS = ["series_id", "ts"]


def windows_of(spark, n):
    return spark.createDataFrame([("a", k, [float(k), 1.0, 2.0 * k + 3]) for k in range(n)], "series_id string, ts int, prices array<double>")


def test_only_unseen_windows_are_encoded(spark, tmp_path):
    path, seen = str(tmp_path / "encoded"), spark.sparkContext.accumulator(0)

    def counted(df):
        def count(rows):
            for batch in rows:
                seen.add(batch.num_rows)
                yield batch

        return encode.encode(df.mapInArrow(count, df.schema), "scaled").drop("prices")

    small = encode.config_hash("scaled", 3)
    assert sinks.read_encoded(spark, path, small) is None
    assert sinks.encode_unseen(windows_of(spark, 10), KEYS, path, small, counted) == 10 and seen.value == 10
    assert sinks.encode_unseen(windows_of(spark, 10), KEYS, path, small, counted) == 0 and seen.value == 10
    assert sinks.encode_unseen(windows_of(spark, 14).unionByName(windows_of(spark, 14)), KEYS, path, small, counted) == 4 and seen.value == 14
    assert sinks.encode_unseen(windows_of(spark, 14), KEYS, path, encode.config_hash("scaled", 4), counted) == 14
    got = sinks.read_encoded(spark, path, small)
    assert got.count() == 14 and got.select("ts").distinct().count() == 14


def test_a_failed_run_publishes_nothing(spark, tmp_path):
    path = str(tmp_path / "encoded")
    scaled = lambda df: encode.encode(df, "scaled").drop("prices")
    sinks.encode_unseen(windows_of(spark, 3), KEYS, path, "c", scaled)
    with pytest.raises(Exception, match="no such luck"):
        sinks.encode_unseen(windows_of(spark, 6), KEYS, path, "c", lambda df: df.withColumn("image", F.raise_error(F.lit("no such luck"))))
    assert sinks.read_encoded(spark, path, "c").count() == 3
    assert sinks.encode_unseen(windows_of(spark, 6), KEYS, path, "c", scaled) == 3
