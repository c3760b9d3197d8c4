"""Substring deduplication over a log-structured index of window fingerprints."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NAMED, WRITTEN, drop_table, shared_dir, store

WINDOW = 20
#: Words of the inner windows that are indexed; every full window holds WINDOW - ANCHOR + 1 of them.
ANCHOR = 8
#: A fingerprint that occurs so often has its windows dealt out one by one.
HOT = 512
#: Bytes of text hashed at a time.
CHUNK = 1 << 20
#: Longest word that is hashed by table; longer ones are hashed each by itself.
TABLED = 32
#: The id that stands for null.
NO_ID = -(1 << 63)

SPACES = (9, 10, 11, 12, 13, 32)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

FOUND = "fp bigint, part bigint, seq int, doc_id bigint, key bigint, start int, count int, words binary"
KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())


class Hasher:
    """Hashes of words and of runs of words, all positions of a chunk of texts at once.

    A word's hash is the sum of one random number for each of its bytes and their places, a run's
    the sum of its words' hashes times one random odd number for each place. They choose
    candidates only; what is removed is compared word by word.
    """

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 63, TABLED * 256, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, TABLED * 256, dtype=np.uint64)
        self.places = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros(0, np.uint64)
        length = end - start
        first = np.cumsum(length) - length
        at = np.arange(int(length.sum())) - np.repeat(first, length)
        part = self.table[np.minimum(at, TABLED - 1) * 256 + data[at + np.repeat(start, length)]]
        out = np.add.reduceat(part, first)
        for k in np.flatnonzero(length > TABLED):
            out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes())
        return mixed(out)

    def runs(self, words: np.ndarray, length: int) -> np.ndarray:
        """Hash of words[i : i + length] for every i that has so many."""
        n = max(0, len(words) - length + 1)
        out = np.zeros(n, np.uint64)
        for k in range(length):
            out += words[k : k + n] * self.places[k % len(self.places)]
        return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts of about CHUNK bytes; a longer text is one of its own."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every word."""
    inside = ~IS_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offsets[1:], start, side="right")


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over x[i : i + width] for every i that has so many, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = pick(out[:-have], out[have:]) if len(out) > have else out[:0]
        have *= 2
    rest = width - have
    return (pick(out[:-rest], out[rest:]) if len(out) > rest else out[:0]) if rest else out


def single_spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """The texts with their words joined by one space, as bytes and offsets; of every word start, end and text; each text's first word."""
    start, end, owner = split_words(data, offsets)
    more = np.r_[owner[1:] == owner[:-1], np.zeros(min(1, len(owner)), bool)]
    keep = ~IS_SPACE[data]
    keep[end[more]] = True
    stop = np.cumsum(end - start + more)
    begin = np.r_[np.zeros(1, np.int64), stop]
    plain = data[keep]
    plain[stop[more] - 1] = 32
    bounds = np.searchsorted(owner, np.arange(len(offsets)))
    return plain, begin[bounds], begin[:-1], stop - more, owner, bounds


def selections(words: np.ndarray, owner: np.ndarray, hasher: Hasher, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, first window and length of each run of neighbouring full windows that select one place.

    A window selects the first of its inner windows of the least fingerprint. Windows of one run
    differ from each other, since like windows select places as far apart as they are.
    """
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = hasher.runs(words, anchor)
    least = sliding(inner, window - anchor + 1, np.minimum)
    whole = owner[window - 1 :] == owner[: len(owner) - window + 1]
    # The place is left behind by the next window, or a lesser one comes in.
    new = np.r_[True, (inner[: len(least) - 1] == least[:-1]) | (least[1:] < least[:-1]) | ~whole[:-1]] | ~whole
    at = np.flatnonzero(new)
    count = np.diff(np.r_[at, len(least)])
    at, count = at[whole[at]], count[whole[at]]
    return least[at], at, count


PREPARED = "doc_id bigint, key bigint, no_id boolean, text binary, run_fps array<bigint>, run_windows array<int>"


def prepared(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """The documents with single-spaced texts and, for each, the :func:`selections` of its windows, which follow each other.

    This is the only place where words are hashed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            names = [batch.column(c) for c in ("doc_id", "key", "no_id")]
            for first, data, offsets in chunks(batch.column("text")):
                plain, places, start, end, owner, bounds = single_spaced(data, offsets)
                fp, at, count = selections(hasher.words(plain, start, end), owner, hasher, window, anchor)
                n = len(places) - 1
                text = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(plain)])
                of = pa.array(np.searchsorted(at, bounds).astype(np.int32))
                runs = [pa.ListArray.from_arrays(of, pa.array(x)) for x in (fp.view(np.int64), count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*(c.slice(first, n) for c in names), text, *runs], names=["doc_id", "key", "no_id", "text", "run_fps", "run_windows"])

    return docs.select("doc_id", "key", "no_id", "text").mapInArrow(run, PREPARED)


def lists(column: pa.Array) -> tuple[list[int], np.ndarray]:
    """Offsets and values of a column of lists of numbers."""
    return column.offsets.to_pylist(), column.values.to_numpy(zero_copy_only=False)


def word_edges(text: bytes) -> np.ndarray:
    """The spaces of a single-spaced text, and its two ends: word k lies between the k-th and the next."""
    return np.r_[-1, np.flatnonzero(np.frombuffer(text, np.uint8) == 32), len(text)]


def repeated_windows(texts: DataFrame, hits: DataFrame, seq: int, is_new: bool, window: int) -> DataFrame:
    """Rows of ``FOUND``: the windows of the batch ``seq`` that may repeat, and those that do so nearby.

    ``hits`` has each document's shared fingerprints. Only windows that select one of them can
    repeat. The windows of a run travel as one row with all their words. A task compares the runs of
    the documents of one Arrow batch itself and passes on one of each kind, so a passage that a
    third of the documents share is a few rows. Around a shared passage the windows differ from
    text to text but select the same fingerprint; those of a hot one are taken one by one and dealt
    out by a hash of their words. Rows without words are windows that are known to start earlier
    too; of a batch that is not ``is_new`` they are left out.
    """
    names = [f.split()[0] for f in FOUND.split(", ")]
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy() for c in ("doc_id", "key"))
            texts_ = batch.column("text")
            (fp_of, fps), (_, counts), (hit_of, hit), (hot_of, hot) = (lists(batch.column(c)) for c in ("run_fps", "run_windows", "fps", "hot_fps"))
            seen: set[bytes] = set()
            out: list[tuple] = []
            last = None
            # In the order of the documents, so that the first of its kind is the earliest.
            for r in np.lexsort((keys, ids)).tolist():
                doc_id, key = name = int(ids[r]), int(keys[r])
                if name == last:  # a row alike
                    continue
                last = name
                shared, singly = set(hit[hit_of[r] : hit_of[r + 1]].tolist()), set(hot[hot_of[r] : hot_of[r + 1]].tolist())
                here = fps[fp_of[r] : fp_of[r + 1]].tolist()
                at = [k for k, f in enumerate(here) if f in shared]
                if not at:
                    continue
                text = texts_[r].as_py()
                edges = word_edges(text)
                count = counts[fp_of[r] : fp_of[r + 1]].astype(np.int64)
                begin = np.cumsum(count) - count
                begin, count = begin[at], count[at]
                low, high = (edges[begin] + 1).tolist(), edges[begin + count + window - 1].tolist()
                since = until = 0  # the windows known to repeat that are not yet passed on
                for k, a, b, s, c in zip(at, low, high, begin.tolist(), count.tolist(), strict=True):
                    fp = here[k]
                    if fp in singly:
                        single = [(s + j, 1, text[edges[s + j] + 1 : edges[s + j + window]]) for j in range(c)]
                    else:
                        single = ((s, c, text[a:b]),)
                    for s_, c_, words in single:
                        if words not in seen:
                            seen.add(words)
                            out.append((fp, xxhash.xxh3_64_intdigest(words) >> 1 if fp in singly else 0, seq, doc_id, key, s_, c_, words))
                        elif is_new:
                            if s_ != until:
                                if until > since:
                                    out.append((key, 0, seq, doc_id, key, since, until - since, None))
                                since = s_
                            until = s_ + c_
                if until > since:
                    out.append((key, 0, seq, doc_id, key, since, until - since, None))
                if len(out) >= 10_000:
                    yield table(out)
                    out = []
            if out:
                yield table(out)

    texts = texts.select("doc_id", "key", "text", "run_fps", "run_windows")
    # The text stays where its bucket is; the hits of a bucket fit in memory beside it.
    return texts.join(hits.hint("shuffle_hash"), "key").mapInArrow(run, FOUND)


def settle(found: DataFrame, seq: int, window: int) -> DataFrame:
    """(doc_id, key, mark): the windows of batch ``seq`` that also start earlier, as start << 32 | count.

    The windows of a fingerprint meet in one task in their order and are compared by their words:
    first by whole runs, then, where runs differ, one by one.
    """

    def windows_of(words: bytes, count: int) -> list[bytes]:
        if count == 1:
            return [words]
        parts = words.split(b" ")
        return [b" ".join(parts[k : k + window]) for k in range(count)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The runs of the fingerprint so far, each by its first place; the windows of all of them
        # are made when a second one comes, since those of one run differ.
        group, leads, seen = None, {}, None
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            words_ = batch.column("words").to_pylist()
            for fp, part, seq_, doc_id, key, start, count, words in zip(*(c.to_numpy().tolist() for c in batch.columns[:-1]), words_, strict=True):
                if words is None:
                    out.append((doc_id, key, start << 32 | count))
                    continue
                if (fp, part) != group:
                    group, leads, seen = (fp, part), {}, None
                here = (seq_, doc_id, key, start)
                lead = leads.setdefault(words, here)
                if lead is not here:
                    if seq_ == seq and lead != here:
                        out.append((doc_id, key, start << 32 | count))
                    continue
                if len(leads) == 1:
                    only = count
                    continue
                if seen is None:
                    seen = set(windows_of(next(iter(leads)), only))
                since = None
                for k, w in enumerate(windows_of(words, count)):
                    again = w in seen
                    if not again:
                        seen.add(w)
                    if again and since is None:
                        since = k
                    elif not again and since is not None:
                        if seq_ == seq:
                            out.append((doc_id, key, start + since << 32 | k - since))
                        since = None
                if since is not None and seq_ == seq:
                    out.append((doc_id, key, start + since << 32 | count - since))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "key", "mark"])

    ordered = found.repartition("fp", "part").sortWithinPartitions("fp", "part", "seq", "doc_id", "key", "start")
    return ordered.mapInArrow(run, "doc_id bigint, key bigint, mark bigint")


class SubstringIndex:
    """The texts seen so far and sorted immutable runs of their windows' fingerprints, in a shared folder.

    A batch's texts are written once, bucketed by their key, with the fingerprints that their windows
    select, so no text is hashed again; the fingerprints are also written as a run (fp, n), bucketed
    and sorted by fingerprint. The batch is merge-joined with all runs without moving
    them; what shares a fingerprint is verified word by word, and when ``fanout`` runs have gathered
    they are compacted into one. What a batch added is entered in a new manifest, as the last step,
    so a failed batch leaves the index as it was. ``folder`` may be one that an earlier run has left,
    whatever its session was. Batches come one after the other.
    """

    def __init__(self, spark: SparkSession, folder: str, window: int = WINDOW, anchor: int = ANCHOR, fanout: int = 4, hot: int = HOT):
        self.spark, self.folder, self.fanout, self.hot = spark, folder.rstrip("/"), fanout, hot
        self.window, self.anchor = window, anchor
        #: Of each kind the tables: (name, path, columns, key, buckets, batch).
        self.held: list[tuple] = []
        self.seq, self.version = 0, 0
        self._open()

    def _open(self) -> None:
        jvm, where = self.spark._jvm, f"{self.folder}/manifests"
        path = jvm.org.apache.hadoop.fs.Path(where)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return
        done = [f.getPath().getName() for f in files.listStatus(path)]
        versions = [int(v) for v in done if files.exists(jvm.org.apache.hadoop.fs.Path(f"{where}/{v}/_SUCCESS"))]
        if not versions:
            return
        self.version = max(versions)
        rows = self.spark.read.json(f"{where}/{self.version}").collect()
        self.held = [(r["kind"], r["name"], r["path"], r["columns"], r["key"], r["buckets"], r["batch"]) for r in rows if r["kind"] != "settings"]
        if any(t[0] == "texts" and "run_fps" not in t[3] for t in self.held):
            raise ValueError(f"the index in {self.folder} has texts without the runs of their windows: build it anew")
        settings = next(r for r in rows if r["kind"] == "settings")
        self.seq, self.window, self.anchor = settings["batch"], settings["buckets"], int(settings["columns"])
        for _, name, path, columns, key, buckets, _ in self.held:
            if not self.spark.catalog.tableExists(name):
                self.spark.sql(f"create table {name} ({columns}) using parquet clustered by ({key}) sorted by ({key}) into {buckets} buckets location '{path}'")

    def _commit(self, held: list[tuple], seq: int) -> None:
        rows = [*held, ("settings", "", "", str(self.anchor), "", self.window, seq)]
        named = self.spark.createDataFrame(rows, "kind string, name string, path string, columns string, key string, buckets int, batch int")
        named.coalesce(1).write.json(f"{self.folder}/manifests/{self.version + 1}")
        self.held, self.seq, self.version = held, seq, self.version + 1

    def _write(self, kind: str, df: DataFrame, key: str, buckets: int, batch: int) -> tuple:
        name = f"{kind}_{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}"
        df.write.bucketBy(buckets, key).sortBy(key).option("path", path).option("compression", "zstd").saveAsTable(name)
        return kind, name, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), key, buckets, batch

    def _read(self, table: tuple) -> DataFrame:
        return self.spark.table(table[1])

    def _of(self, kind: str, held: list[tuple] | None = None) -> list[tuple]:
        return [t for t in (self.held if held is None else held) if t[0] == kind]

    def _erase(self, tables: list[tuple]) -> None:
        for _, name, path, *_ in tables:
            self.spark.sql(f"drop table if exists {name}")
            drop_table(self.spark, path)

    def add(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Take a batch of (doc_id, key, no_id, text): its texts as stored, and (key, marks) of their repeated windows.

        A window repeats if it starts earlier in the batch, or anywhere in an earlier one.
        """
        buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), int((docs.agg(F.sum(F.length("text"))).first()[0] or 0) >> 28))
        wrote: list[tuple] = []
        try:
            ready = prepared(docs.repartition(buckets, "key"), self.window, self.anchor)
            wrote.append(self._write("texts", ready, "key", buckets, self.seq))
            texts = self._read(wrote[0])
            runs = self._of("run")
            run_buckets = runs[-1][5] if runs else buckets
            fresh = texts.select(F.explode("run_fps").alias("fp")).groupBy("fp").agg(F.count("*").alias("n"))
            wrote.append(self._write("run", fresh.repartition(run_buckets, "fp"), "fp", run_buckets, self.seq))
            shared = self._read(wrote[1])
            for k, run in enumerate(runs):
                shared = shared.join(self._read(run).withColumnRenamed("n", f"n{k}").hint("merge"), "fp", "left")
            total = F.col("n")
            for k in range(len(runs)):
                total = total + F.coalesce(f"n{k}", F.lit(0))
            shared = store(shared.select("fp", total.alias("n")).where("n > 1").select("fp", (F.col("n") >= self.hot).alias("hot")), "shared-fingerprints")
            found = None
            for table in [*self._of("texts"), wrote[0]]:
                batch = table[6]
                selected = self._read(table).select("key", F.explode("run_fps").alias("fp"))
                # Shared fingerprints grow with the documents, so they are never broadcast.
                hits = selected.join(shared.hint("merge"), "fp").groupBy("key").agg(F.collect_set("fp").alias("fps"), F.collect_set(F.when(F.col("hot"), F.col("fp"))).alias("hot_fps"))
                rows = repeated_windows(self._read(table), hits, batch, batch == self.seq, self.window)
                found = rows if found is None else found.unionByName(rows)
            marks = settle(found, self.seq, self.window).groupBy("key").agg(F.collect_list(F.struct("doc_id", "mark")).alias("marks"))
            marks = store(marks, "marks")
            self._commit([*self.held, *wrote], self.seq + 1)
        except BaseException:
            self._erase(wrote)
            raise
        if len(self._of("run")) >= self.fanout:
            self.compact()
        return texts, marks

    def compact(self) -> None:
        """Merge all runs into one."""
        old = self._of("run")
        if len(old) > 1:
            merged = self._read(old[0])
            for run in old[1:]:
                merged = merged.unionByName(self._read(run))
            buckets = max(t[5] for t in old)
            new = self._write("run", merged.groupBy("fp").agg(F.sum("n").alias("n")).repartition(buckets, "fp"), "fp", buckets, old[-1][6])
            self._commit([*(t for t in self.held if t[0] != "run"), new], self.seq)
            self._erase(old)

    def remove_repeats(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
        """Take a batch of documents and tell what is left of each; see :func:`remove_repeats`."""
        texts, marks = self.add(keyed(docs, id_col, text_col))
        return kept_words(texts, marks, self.window, id_col, with_text)

    def forget_runs(self) -> None:
        """Delete all but the texts, which results may still read."""
        self._erase([t for t in self.held if t[0] != "texts"])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    )
    # A row of the least id is not one without an id.
    key = F.when(F.col("no_id") | (F.col("doc_id") != NO_ID), F.xxhash64("doc_id", "text")).otherwise(F.xxhash64("no_id", "doc_id", "text"))
    return rows.select("doc_id", key.alias("key"), "no_id", "text")


def kept_words(texts: DataFrame, marks: DataFrame, window: int, id_col: str, with_text: bool) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: list[tuple] = []
            found = batch.column("marks")
            of, of_doc, marks_ = found.offsets.to_pylist(), *(found.values.field(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "mark"))
            for r, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_numpy().tolist(), batch.column("text").to_pylist(), strict=True)):
                n = text.count(b" ") + 1 if text else 0
                kept, left = text, n
                if of[r] < of[r + 1]:
                    here = slice(of[r], of[r + 1])
                    mark = np.sort(marks_[here][of_doc[here] == doc_id])
                    start = mark >> 32
                    stop = np.maximum.accumulate(start + (mark & 0xFFFFFFFF) - 1 + window)
                    low, high = np.r_[0, stop], np.r_[start, n]
                    some = low < high
                    low, high, edges = low[some], high[some], word_edges(text)
                    kept = b" ".join([text[a:b] for a, b in zip((edges[low] + 1).tolist(), edges[high].tolist(), strict=True)])
                    left = int((high - low).sum())
                out.append((n, n - left, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            names = ["doc_id", "no_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("no_id"), *arrays], names=names)

    schema = "doc_id bigint, no_id boolean, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"
    done = texts.select("doc_id", "key", "no_id", "text").join(marks.hint("shuffle_hash"), "key", "left").mapInArrow(run, schema)
    done = done.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id").withColumnRenamed("doc_id", id_col)
    return done if with_text else done.drop("kept_text")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, batches: int = 2, hot: int = HOT, with_text: bool = False
) -> DataFrame:
    """One row per row of ``docs``: what is left of its words without repeated windows.

    A word goes if a window of ``window`` words covers it whose word sequence also starts earlier,
    in a smaller id or before in the same text. Words are runs of anything but ASCII white space.
    Null and empty texts have no words and shorter ones no window. The ids order the documents,
    null ids come first, among rows of the least long. Rows alike in id and text
    are one document; different texts of one id, or of none, are documents of their own, in the
    order of the hashes of id and text. Columns other than the two do not matter; an empty table
    gives no rows.

    Full windows are found through the ``anchor``-word windows inside: each full window selects the
    inner one of least fingerprint, so equal windows select equal ones. The documents enter a
    :class:`SubstringIndex` of their own in ``batches``, in the order of their ids; to go on with an
    index that stays, call its :meth:`~SubstringIndex.remove_repeats`. Returns id, n_words,
    n_removed, kept_sha256 and, on demand, kept_text.
    """
    spark = docs.sparkSession
    index = SubstringIndex(spark, f"{shared_dir(spark)}/tidemark/substrings-{uuid.uuid4().hex}", window, anchor, hot=hot)
    WRITTEN.append(index.folder)
    source = keyed(docs, id_col, text_col)
    edges = sorted(set(source.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] or [])) if batches > 1 else []
    done = None
    try:
        for low, high in zip([None, *edges], [*edges, None], strict=True):
            slice_ = source if low is None else source.where(F.col("doc_id") > low)
            part = kept_words(*index.add(slice_ if high is None else slice_.where(F.col("doc_id") <= high)), window, id_col, with_text)
            done = part if done is None else done.unionByName(part)
    finally:
        NAMED.extend(t[1] for t in index._of("texts"))
        index.forget_runs()
    return done
