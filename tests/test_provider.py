"""The provider data source: headers of any kind, filters, atomic jobs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.sources import provider


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_headers_dates_and_numbers(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/gold.csv").write_text("observation_date,GOLD\n2020-01-02,1.5\nbad,2\n2020-01-03,.\n")
    (tmp_path / "in/sub/oil%2Fus.csv").write_text('﻿note,TIME_PERIOD,OBS_VALUE\n"a, b",2020-01-02T00:00:00,inf\nx,2021-05-06,-3\n', encoding="utf-8")
    (tmp_path / "in/_draft.csv").write_text("date,value\n2020-01-01,9\n")
    (tmp_path / "in/empty.csv").write_text("date,value\n")
    got = rows_of(provider.read_provider(spark, str(tmp_path / "in"), "GOLD").fillna(-1.0))
    assert got == [("gold", dt.date(2020, 1, 2), 1.5), ("gold", dt.date(2020, 1, 3), -1.0), ("oil/us", dt.date(2020, 1, 2), -1.0), ("oil/us", dt.date(2021, 5, 6), -3.0)]


@pytest.fixture
def panel(spark):
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=k), None if k == 3 else float(k)) for s in ("a", "b b", "é/..x", "") for k in range(30)]
    return spark.createDataFrame(rows, "series_id string, date date, value double").repartition(5)


def key(rows):
    return sorted(rows, key=str)


def test_round_trip_append_and_overwrite(spark, panel, tmp_path):
    path = f"file://{tmp_path}/out"
    named = panel.where("series_id not like '%..%'")
    provider.write_provider(named, path)
    assert key(rows_of_any(provider.read_provider(spark, path))) == key(rows_of_any(named))
    provider.write_provider(named, path)
    assert provider.read_provider(spark, path).count() == 2 * named.count()
    provider.write_provider(named.where("series_id = 'a'"), path, "overwrite")
    assert key(rows_of_any(provider.read_provider(spark, path))) == key(rows_of_any(named.where("series_id = 'a'")))
    assert len([p for p in (tmp_path / "out").iterdir() if p.is_dir()]) == 1


def rows_of_any(df):
    return [tuple(r) for r in df.collect()]


def test_filters_reach_the_files(spark, panel, tmp_path):
    path = str(tmp_path / "out")
    provider.write_provider(panel.where("series_id in ('a', 'b b')"), path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = provider.read_provider(spark, path).where((F.col("series_id") == "a") & (F.col("date") >= dt.date(2020, 1, 10)) & (F.col("value") > 12))
        assert sorted(r["value"] for r in some.collect()) == [float(k) for k in range(13, 30)]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = provider.PushingReader(path, None)
    left = list(reader.pushFilters([provider.EqualTo(("series_id",), "a"), provider.LessThan(("date",), dt.date(2020, 1, 3)), provider.GreaterThan(("value",), 0.0)]))
    assert [type(f) for f in left] == [provider.GreaterThan]
    assert {p.series_id for p in reader.partitions()} == {"a"}
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2


def test_an_aborted_write_leaves_nothing(spark, panel, tmp_path):
    path = str(tmp_path / "out")
    provider.write_provider(panel.where("series_id = 'a'"), path)
    bad = panel.where("series_id = 'a'").unionByName(spark.createDataFrame([(None, dt.date(2020, 1, 1), 1.0)], panel.schema))
    with pytest.raises(Exception, match="without a name"):
        provider.write_provider(bad, path, "overwrite")
    assert key(rows_of_any(provider.read_provider(spark, path))) == key(rows_of_any(panel.where("series_id = 'a'")))
    assert len([p for p in (tmp_path / "out").iterdir() if p.is_dir()]) == 1
