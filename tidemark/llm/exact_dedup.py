"""Exact deduplication: counting quotient filters find repeated fingerprints, bytes decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, keep_rows, row_hash, short_batches, store, whole_row, with_groups

#: Fingerprints that a task gathers before it emits its filter; filters merge without loss.
FLUSH = 1 << 20
#: Remainders that are packed at a time.
PACKED = 1 << 16

FILTER_SCHEMA = "block int, size int, quotients binary, remainders binary, repeated binary, counts binary"


class CountingQuotientFilter:
    """A multiset of 64-bit fingerprints that share their top ``block_bits``.

    Of what is left of a fingerprint the top bits are its quotient, about as many as the logarithm
    of the entries, and the others its remainder. A quotient's remainders form one sorted run. The
    filter holds the runs' lengths in unary (a one for each entry, a zero after each quotient),
    the remainders in just their bits, one bit per entry that tells whether its count is above
    one, and the counts of those. That is the remainder and about three bits for an entry, from
    which the fingerprint can be told whole, so merging filters loses nothing.
    """

    def __init__(self, block: int, block_bits: int, prints: np.ndarray, counts: np.ndarray):
        """``prints`` are sorted and distinct."""
        self.block, self.block_bits, self.size = block, block_bits, len(prints)
        low, q = self._geometry()
        quotient = (prints >> np.uint64(low)).astype(np.int64) & ((1 << q) - 1)
        unary = np.zeros(self.size + (1 << q), bool)
        unary[np.arange(self.size) + quotient] = True
        self.quotients = np.packbits(unary).tobytes()
        parts = [np.unpackbits(prints[i : i + PACKED].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - low :].ravel() for i in range(0, self.size, PACKED)]
        self.remainders = np.packbits(np.concatenate(parts) if parts else np.zeros(0, bool)).tobytes()
        self.repeated = np.packbits(counts > 1).tobytes()
        self.counts = counts[counts > 1].astype(np.int64).tobytes()

    def _geometry(self) -> tuple[int, int]:
        """Bits of a remainder and of a quotient."""
        q = min(max(1, self.size.bit_length() - 1), 63 - self.block_bits)
        return 64 - self.block_bits - q, q

    @classmethod
    def build(cls, block: int, block_bits: int, prints: np.ndarray):
        return cls(block, block_bits, *np.unique(prints, return_counts=True))

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints in their order, and their counts."""
        low, q = self._geometry()
        unary = np.unpackbits(np.frombuffer(self.quotients, np.uint8), count=self.size + (1 << q))
        quotient = (np.flatnonzero(unary) - np.arange(self.size)).astype(np.uint64)
        packed, parts = np.frombuffer(self.remainders, np.uint8), []
        for i in range(0, self.size, PACKED):  # PACKED remainders end at a byte
            n = min(PACKED, self.size - i)
            bits = np.unpackbits(packed[i * low // 8 :], count=n * low).reshape(n, low)
            wide = np.zeros((n, 64), np.uint8)
            wide[:, 64 - low :] = bits
            parts.append(np.packbits(wide, axis=1).view(">u8").ravel().astype(np.uint64))
        remainder = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        top = np.uint64(self.block) << np.uint64(64 - self.block_bits) if self.block_bits else np.uint64(0)
        counts = np.ones(self.size, np.int64)
        counts[np.unpackbits(np.frombuffer(self.repeated, np.uint8), count=self.size).astype(bool)] = np.frombuffer(self.counts, np.int64)
        return top | (quotient << np.uint64(low)) | remainder, counts

    @classmethod
    def merge(cls, parts: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """One filter of what ``parts``, all of one block, hold together.

        Each part is read once, in the order of its quotients and sorted remainders. The stable
        sort of these sorted runs is a merge of them, and entries that meet add their counts.
        """
        prints, counts = (np.concatenate(x) for x in zip(*(p.entries() for p in parts), strict=True))
        order = np.argsort(prints, kind="stable")
        prints, counts = prints[order], counts[order]
        first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]])[: len(prints)]
        return cls(parts[0].block, parts[0].block_bits, prints[first], np.add.reduceat(counts, first) if len(first) else counts)

    def pack(self) -> tuple:
        return self.block, self.size, self.quotients, self.remainders, self.repeated, self.counts

    @classmethod
    def unpack(cls, block_bits: int, block: int, size: int, *held: bytes):
        out = cls.__new__(cls)
        out.block, out.block_bits, out.size = block, block_bits, size
        out.quotients, out.remainders, out.repeated, out.counts = held
        return out


def normalise(column):
    """The text's UTF-8 bytes; what follows lower-cases their A-Z only. Null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def _digest(id_type: pa.DataType, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.lower() for x in batch.column("text").to_pylist()]
            prints = np.array([xxhash.xxh3_64_intdigest(x) for x in texts], np.uint64).view(np.int64)
            columns = {"print": pa.array(prints)}
            if with_text:
                columns["text"] = pa.array(texts, pa.binary())
            else:
                columns["sha"] = pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(id_type), **columns})

    return run


def _filters(block_bits: int):
    def emit(gathered: list[np.ndarray]) -> pa.RecordBatch:
        prints = np.concatenate(gathered).view(np.uint64)
        blocks = (prints >> np.uint64(64 - block_bits)).astype(np.int64) if block_bits else np.zeros(len(prints), np.int64)
        order = np.argsort(blocks, kind="stable")
        cuts = np.flatnonzero(np.diff(blocks[order])) + 1
        parts = [CountingQuotientFilter.build(int(blocks[i[0]]), block_bits, prints[i]).pack() for i in np.split(order, cuts)]
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*parts, strict=True), kinds, strict=True)], names=[f.split()[0] for f in FILTER_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, n = [], 0
        for batch in batches:
            if batch.num_rows:
                gathered.append(batch.column("print").to_numpy())
                n += batch.num_rows
            if n >= FLUSH:
                yield emit(gathered)
                gathered, n = [], 0
        if n:
            yield emit(gathered)

    return run


def _repeated(block_bits: int):
    def run(table: pa.Table) -> pa.Table:
        parts = [CountingQuotientFilter.unpack(block_bits, *row.values()) for row in table.to_pylist()]
        prints, counts = CountingQuotientFilter.merge(parts).entries()
        return pa.table({"print": pa.array(prints[counts > 1].view(np.int64)), "count": pa.array(counts[counts > 1])})

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_block: int = 1 << 19) -> DataFrame:
    """One row per row of ``docs``: its id, the id kept of its group, the group's size, whether it is kept.

    Texts are equal when their bytes are after lower-casing A-Z; null counts as empty. Each task
    builds counting quotient filters over its fingerprints, one per block of the fingerprint
    space, and so sends one entry however often a text repeats. Filters of a block merge by
    sorted remainders. Only texts whose fingerprint counts above one are compared, by grouping
    on the bytes themselves, which Spark combines before the shuffle.

    The largest id of a group stays; a null id counts as the smallest. Where rows repeat that id,
    ``kept`` is true on each, see :func:`drop_exact`. Texts are compared whole, however long; other
    columns are not read. An empty table gives no rows. Returns the id
    column under its own name and keep_id, group_size, kept, text_sha256.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), normalise(text_col).alias("text"))
    digests = store(short_batches(source).mapInArrow(_digest(pa.int64(), False), "doc_id bigint, print bigint, sha string"), "digests")
    blocks = max(1, digests.count() // rows_per_block)
    block_bits = min(20, int(blocks - 1).bit_length())
    filters = digests.select("print").mapInArrow(_filters(block_bits), FILTER_SCHEMA)
    repeated = store(filters.groupBy("block").applyInArrow(_repeated(block_bits), "print bigint, count bigint"), "repeated")

    hint = F.broadcast(repeated.select("print")) if repeated.count() * 16 <= BROADCAST_BYTES else repeated.select("print")
    texts = source.mapInArrow(_digest(pa.int64(), True), "doc_id bigint, print bigint, text binary").join(hint, "print")
    groups = (
        texts.groupBy("print", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("print", F.sha2("text", 256).alias("sha"), "keep_id", "group_size")
    )
    return with_groups(digests, store(groups, "exact-groups"), ["print", "sha"], "group_size").select(
        F.col("doc_id").alias(id_col),
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("doc_id").eqNullSafe(F.coalesce("keep_id", "doc_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    Of equal texts (null and empty ones are equal) the row with the largest id stays; rows repeated
    with their id stay once, the one of least row hash where other columns differ. A group without
    ids keeps one row too. Rows whose text is not repeated are not moved. An empty table gives no rows.
    """
    key = lambda id_, sha: F.concat_ws(":", sha, F.col(id_).cast("string")).alias("_key")
    groups = exact_groups(docs, id_col, text_col).where("group_size > 1")
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    contested = store(groups.select(key(id_col, F.col("text_sha256")), "kept").distinct(), "contested")
    return keep_rows(docs.select(whole_row(docs), row_hash(docs).alias("_hash"), key(id_col, F.sha2(lower, 256))), contested)
