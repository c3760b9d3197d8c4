"""SimHash near-duplicates: multi-index hashing finds links, star contraction their components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, row_hash, short_batches, store, whole_row, with_groups

WORDS = 3
RADIUS = 2
#: A table entry with more fingerprints than this is linked through shared keys, not by comparing them.
DENSE = 64


def simhash(hashes: np.ndarray) -> int:
    """Bit set where more than half of the 64-bit hashes have it."""
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased text, repeats included."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.r_[0, ends[:-1]].tolist()
    if len(parts) > words:
        spans = map(slice, starts[: len(parts) - words + 1], (ends[words - 1 :] - 1).tolist())
        return np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(42)), np.uint64, len(parts) - words + 1)
    return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            hashes = shingle_hashes(text)
            out.append(simhash(hashes) if len(hashes) else 0)
        prints = np.array(out, np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(prints)], names=["doc_id", "row", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: bool = False) -> DataFrame:
    """(doc_id, row, fp): id, hash of the whole row if asked for, and fingerprint."""
    row = row_hash(docs) if rows else F.lit(0).cast("bigint")
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row.alias("row"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return short_batches(source).mapInArrow(_fingerprints, "doc_id bigint, row bigint, fp bigint")


def roots_of(nodes: DataFrame, dense: int) -> DataFrame:
    """``nodes`` with ``root``, the least fingerprint that ``fp`` reaches."""
    roots = components(near_links(nodes, dense))
    return nodes.join(roots, F.col("fp") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "fp"))


def _high(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, 32)


def _low(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit(0xFFFFFFFF))


def near_links(prints: DataFrame, dense: int = DENSE) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` at ``RADIUS`` 2 or fewer bits.

    Two fingerprints that close agree in the low half, or differ by at most one bit in the high
    half. So there is one table for each half; the low one is asked for equal values only, the
    high one for the ball of radius 1 (the flips that set a bit: of two values one bit apart the
    one without it finds the other). Matches are verified by their whole distance.

    An entry with many fingerprints would give the square of their number. There every
    fingerprint instead emits keys, its other half with the at most two bits (or, beside a flip,
    the one bit) that may differ blanked out: equal keys mean a distance of 2 or fewer and the
    reverse, so linking each to the least fingerprint of its key loses no connection and adds
    none. Keys per fingerprint are a constant, hence the work is linear in both cases.
    """
    prints = prints.select("fp")
    flips = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.getbit(_high(F.col("fp")), i) == 0)
    entries = prints.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("half"), _high(F.col("fp")).alias("key")), F.struct(F.lit(1).alias("half"), _low(F.col("fp")).alias("key")))).alias("e")).select(
        "fp", "e.half", "e.key"
    )
    balls = prints.select("fp", F.explode(flips).alias("bit")).select(
        "fp", F.lit(0).alias("half"), _high(F.col("fp")).bitwiseOR(F.expr("shiftleft(1L, bit)")).alias("key"), "bit"
    )
    crowded = store(entries.groupBy("half", "key").agg(F.count("*").alias("n")).where(F.col("n") > dense).select("half", "key"), "crowded")

    # Few fingerprints to an entry: fetch and verify.
    asked = balls.unionByName(entries.withColumn("bit", F.lit(-1)))
    sparse_asked = asked.join(crowded, ["half", "key"], "left_anti")
    held = entries.withColumnRenamed("fp", "other")
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    fetched = sparse_asked.join(held, ["half", "key"]).where(((F.col("bit") >= 0) | (F.col("fp") < F.col("other"))) & (distance <= RADIUS) & (distance > 0))
    links = fetched.select(F.col("fp").alias("a"), F.col("other").alias("b"))

    # Many: shared keys.
    dense_asked = asked.join(crowded, ["half", "key"], "left_semi")
    dense_held = entries.join(crowded, ["half", "key"], "left_semi")
    other = F.when(F.col("half") == 0, _low(F.col("fp"))).otherwise(_high(F.col("fp")))
    one_bit = F.expr("transform(sequence(0, 31), i -> (shiftleft(1L, i)))")
    two_bits = F.expr("flatten(transform(sequence(0, 30), i -> transform(sequence(i + 1, 31), j -> shiftleft(1L, i) | shiftleft(1L, j))))")
    set_bits = F.expr("filter(sequence(0, 31), i -> getbit(key, i) = 1)")
    same = dense_held.select("fp", "half", "key", F.lit(-1).alias("bit"), other.alias("rest"), F.explode(two_bits).alias("mask"))
    flipped = dense_asked.where("bit >= 0").select("fp", "half", "key", "bit", other.alias("rest"))
    members = dense_held.where("half = 0").select("fp", "half", "key", F.explode(set_bits).alias("bit"), other.alias("rest"))
    beside = flipped.unionByName(members).select("*", F.explode(one_bit).alias("mask"))
    blank = F.col("rest").bitwiseAND(F.bitwise_not("mask"))
    keyed = same.unionByName(beside.select(*same.columns)).select(
        "fp", ((F.col("half") * 33 + F.col("bit") + 1) * (1 << 32) + F.col("key")).alias("k1"), F.shiftleft("mask", 32).bitwiseOR(blank).alias("k2")
    )
    keyed = store(keyed, "dense-keys")
    least = keyed.groupBy("k1", "k2").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = keyed.join(least, ["k1", "k2"]).where("fp > a").select("a", F.col("fp").alias("b"))
    return links.unionByName(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the component's least node.

    Alternates large-star and small-star steps, which move links to ever smaller neighbours, until
    a round changes nothing. A round is aggregations and joins over the links, written to the
    shared folder; a node's neighbours are never gathered in one place.
    """
    edges = store(links.select("a", "b").where("a <> b"), "links")
    seen = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        large = store(large, "large-star")
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(down, "b")
        small = joined.select(F.col("m").alias("a"), "b").unionByName(joined.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")))
        edges = store(small.where("a <> b").distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = now


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: int = DENSE) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint in hex, and component_id, the least id it reaches.

    Fingerprints are of lower-cased (A-Z) three-word shingles, repeats included; a text of fewer
    words is one shingle and one without words, or null, has fingerprint zero, linked like any
    other. Equal fingerprints are one node, so copies, however many, cost one. Repeated rows give
    repeated rows; an empty table gives none. Null ids stay null and never name a component
    unless all its ids are null.
    """
    table = store(fingerprints(docs, id_col, text_col), "simhash")
    nodes = store(table.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-nodes")
    linked = store(roots_of(nodes, dense), "simhash-roots")
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = store(linked.join(names, "root").select("fp", "n", "component_id"), "simhash-named")
    # A fingerprint that many rows share, as of empty texts, is no hot key there.
    return with_groups(table, named, ["fp"], "n").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, with all its columns, whatever their names: the one of least id.

    Null ids come last, so such a row stays only where no row of its component has an id. Rows of
    one id, or of none, are told apart by a hash of the whole row; rows alike in all columns are one.
    Null and empty texts form one component, with whatever fingerprint lies near zero. Rows that
    are a component by themselves are not moved. An empty table gives no rows.
    """
    key = lambda doc_id, row: F.concat_ws(" ", F.coalesce(doc_id.cast("bigint").cast("string"), F.lit("")), row.cast("string")).alias("_key")
    table = store(fingerprints(docs, id_col, text_col, rows=True), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    nodes = store(table.groupBy("fp").agg(first, F.count("*").alias("n")), "simhash-nodes")
    linked = store(roots_of(nodes, DENSE), "simhash-roots")
    groups = linked.groupBy("root").agg(F.min("least").alias("first"), F.sum("n").alias("size")).where("size > 1")
    # A group's rows are found through its fingerprints; one that a third of the rows share is split.
    members = store(linked.join(groups, "root").select("fp", "n", "first"), "simhash-groups")
    rows = with_groups(table, members, ["fp"], "n").where("first is not null")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row"))
    contested = store(rows.select(key(F.col("doc_id"), F.col("row")), kept.alias("kept")).distinct(), "contested")
    return keep_rows(docs.select(whole_row(docs), row_hash(docs).alias("_hash"), key(F.col(id_col), row_hash(docs))), contested)
