"""Folders of price files as a data source: ``spark.read.format("provider_csv")`` and ``df.write.format("provider_csv")``.

A folder holds a file or several for each series, as data providers ship them: any known name for the
date and the value column, in its own header. A reader's partition is a file. A writer's job is a
folder of its own, published by replacing a manifest of the files that its tasks told of, so readers see
all of a job or nothing, and never what a lost attempt of a task left.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as csv
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from tidemark.operators.calendar import DATE_NAMES, VALUE_NAMES

NAME = "provider_csv"
SCHEMA = "series_id string, date date, value double"
#: Which files count.
MANIFEST = "_manifest.json"


@dataclass
class File(InputPartition):
    path: str
    series_id: str


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the folder of a URI or an absolute path."""
    return fs.FileSystem.from_uri(path.rstrip("/"))


def published(files: fs.FileSystem, folder: str) -> list[str] | None:
    """The files that the manifest lists; None if there is no manifest."""
    try:
        with files.open_input_stream(f"{folder}/{MANIFEST}") as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return None


def series_of(path: str) -> str:
    """A file is named by its series; what follows two dots tells a series' files apart."""
    return unquote(path.rsplit("/", 1)[-1].removesuffix(".csv").rsplit("..", 1)[0])


class ProviderSource(DataSource):
    """Options: ``path``; ``value``, the value column's name if it is not a known one; ``pushdown``, to take filters."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ProviderReader:
        kind = PushingReader if self.options.get("pushdown") == "true" else ProviderReader
        return kind(self.options.get("path"), self.options.get("value"))

    def writer(self, schema: StructType, overwrite: bool) -> ProviderWriter:
        if [f.name for f in schema.fields] != ["series_id", "date", "value"]:
            raise ValueError(f"rows must be {SCHEMA}")
        return ProviderWriter(self.options.get("path"), overwrite)


class ProviderReader(DataSourceReader):
    def __init__(self, path: str, value: str | None):
        self.path, self.value = path, value
        self.series: set[str] | None = None
        self.dates: list[tuple[str, object]] = []

    def partitions(self) -> list[File]:
        files, folder = place(self.path)
        listed = published(files, folder)
        if listed is None:
            found = [x.path for x in files.get_file_info(fs.FileSelector(folder, recursive=True)) if x.is_file and x.path.endswith(".csv")]
            found = [p for p in found if not p.rsplit("/", 1)[-1].startswith(("_", "."))]
        else:
            found = [f"{folder}/{name}" for name in listed]
        told = [File(p, series_of(p)) for p in sorted(found)]
        return [f for f in told if self.series is None or f.series_id in self.series]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        files, _ = place(self.path)
        with files.open_input_file(partition.path) as f:
            header = f.read(1 << 16).split(b"\n", 1)[0].decode("utf-8-sig").strip("\r")
        names = next(iter(pd.read_csv(pd.io.common.StringIO(header + "\n"), header=None, dtype=str, keep_default_na=False).itertuples(index=False)), ())
        date = next((c for c in DATE_NAMES if c in names), names[0] if names else None)
        value = next((c for c in (self.value, *VALUE_NAMES) if c in names and c != date), None) or next((c for c in names if c != date), None)
        if value is None:
            raise ValueError(f"no value column in {partition.path}")
        wanted = csv.ConvertOptions(include_columns=[date, value], column_types={date: pa.string(), value: pa.string()}, strings_can_be_null=True)
        with files.open_input_stream(partition.path) as f:
            for batch in csv.open_csv(f, convert_options=wanted):
                days = pc.strptime(pc.utf8_slice_codeunits(pc.utf8_trim_whitespace(batch.column(0)), 0, 10), format="%Y-%m-%d", unit="s", error_is_null=True).cast(pa.date32())
                numbers = pd.to_numeric(batch.column(1).to_pandas(), errors="coerce").to_numpy(float)
                keep = pc.is_valid(days)
                for test, bound in self.dates:
                    keep = pc.and_(keep, pc.fill_null(getattr(pc, test)(days, pa.scalar(bound, pa.date32())), False))
                out = pa.RecordBatch.from_arrays(
                    [pa.array([partition.series_id] * batch.num_rows, pa.string()), days, pa.array(numbers, mask=~np.isfinite(numbers))], names=["series_id", "date", "value"]
                )
                yield out.filter(keep)


class PushingReader(ProviderReader):
    """Also takes filters, which Spark allows only where ``spark.sql.python.filterPushdown.enabled`` is on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Series are chosen by file, dates while reading; other filters stay Spark's."""
        bounds = {GreaterThan: "greater", GreaterThanOrEqual: "greater_equal", LessThan: "less", LessThanOrEqual: "less_equal", EqualTo: "equal"}
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("series_id",):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.series = wanted if self.series is None else self.series & wanted
            elif type(f) in bounds and f.attribute == ("date",):
                self.dates.append((bounds[type(f)], f.value))
            else:
                yield f


class ProviderWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.job = f"job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """A file for each run of a series' rows; an attempt's files have names of their own."""
        files, folder = place(self.path)
        files.create_dir(f"{folder}/{self.job}", recursive=True)
        own, now, sink, done = uuid.uuid4().hex[:12], None, None, []
        shape = pa.schema([("date", pa.date32()), ("value", pa.float64())])
        try:
            for batch in iterator:
                names = np.array(batch.column(0).to_pylist(), object)
                cuts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]).tolist() if len(names) else []
                for lo, hi in zip(cuts, [*cuts[1:], len(names)], strict=True):
                    if names[lo] is None:
                        raise ValueError("a series without a name cannot be a file")
                    if sink is None or names[lo] != now:
                        if sink:
                            sink.close()
                        now = names[lo]
                        done.append(f"{self.job}/{quote(now, safe='')}..{own}-{len(done)}.csv")
                        sink = csv.CSVWriter(files.open_output_stream(f"{folder}/{done[-1]}"), shape)
                    part = batch.slice(lo, hi - lo)
                    sink.write_batch(pa.RecordBatch.from_arrays([part.column(1).cast(pa.date32()), part.column(2).cast(pa.float64())], schema=shape))
        finally:
            if sink:
                sink.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = place(self.path)
        files.create_dir(f"{folder}/{self.job}", recursive=True)
        before = published(files, folder) or []
        listed = [*([] if self.overwrite else before), *(name for m in messages if m for name in m.files)]
        new = f"{folder}/_{self.job}.json"
        with files.open_output_stream(new) as f:
            f.write(json.dumps(listed).encode())
        files.move(new, f"{folder}/{MANIFEST}")
        for job in {name.split("/")[0] for name in before} if self.overwrite else ():
            files.delete_dir(f"{folder}/{job}")

    def abort(self, messages: list[Written | None]) -> None:
        files, folder = place(self.path)
        if files.get_file_info(f"{folder}/{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{folder}/{self.job}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ProviderSource)


def write_provider(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write (series_id, date, value) as provider files, sorted by date; a long series makes several."""
    register(rows.sparkSession)
    ordered = rows.select("series_id", "date", "value").repartitionByRange("series_id", "date").sortWithinPartitions("series_id", "date")
    ordered.write.format(NAME).mode(mode).option("path", path).save()


def read_provider(spark: SparkSession, path: str, value: str | None = None) -> DataFrame:
    """(series_id, date, value) of all files under ``path``: bad dates are left out, bad numbers are null."""
    register(spark)
    reader = spark.read.format(NAME).option("path", path).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return (reader.option("value", value) if value else reader).load()
