"""Merkle manifest of a dataset: a persistent tree in aligned blocks, where each tampered leaf is a version of its own."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store, with_groups

#: A block is an aligned subtree of this many levels, so of at most 2 ** LEVELS nodes of the level below.
LEVELS = 8
#: Leaves that a range of the sort holds at most, about.
RANGE_ROWS = 500_000
#: How a path's step is told: the sibling's side, or none, before the sibling's 32 bytes.
LEFT, RIGHT, LONE = 0, 1, 2
STEP = 33


def combine(*nodes: bytes) -> bytes:
    """The parent of digests, which are hashed as hex text."""
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def levels_of(nodes: list[bytes], first: bool, levels: int) -> list[list[bytes]]:
    """A block's levels, from its nodes to its one root.

    A block that is not full and is a tree's first is the whole tree, and ends where one node is
    left; every other one climbs all ``levels``, its last run perhaps of one node.
    """
    climbs = (len(nodes) - 1).bit_length() if first and len(nodes) < 1 << levels else levels
    out = [nodes]
    for _ in range(climbs):
        below = out[-1]
        out.append([combine(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def path_of(block: list[list[bytes]], place: int) -> bytes:
    """The steps from a node of the block's lowest level to its root."""
    out = b""
    for level in block[:-1]:
        beside = place ^ 1
        out += bytes([LONE]) + bytes(32) if beside >= len(level) else bytes([LEFT if place & 1 else RIGHT]) + level[beside]
        place >>= 1
    return out


def copied(start: bytes, path: bytes) -> list[bytes]:
    """The nodes that a version copies: the leaf and its ancestors. All others stay shared with the original."""
    out = [start]
    for at in range(0, len(path), STEP):
        side, beside = path[at], path[at + 1 : at + STEP]
        out.append(combine(out[-1]) if side == LONE else combine(beside, out[-1]) if side == LEFT else combine(out[-1], beside))
    return out


def siblings(path: bytes) -> str:
    """The siblings of a path as hex text, lowest first."""
    return "".join(path[at + 1 : at + STEP].hex() for at in range(0, len(path), STEP) if path[at] != LONE)


def leaf(*values: Column) -> Column:
    """The digest of values, each as its length in bytes, a colon and itself, or as ``-`` if null."""
    told = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*told).cast("binary"), 256))


def tampered_ids(id_col: str, every: int = 7) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0, F.lit(False))


def numbered(table: DataFrame, order: list[str], name: str) -> DataFrame:
    """A stored ``table`` with ``idx``, the place of a row in its ``tree`` by ``order``, from 0.

    A distributed sort: ranges are cut over all trees at once, so a large tree takes many. A place
    is the row's number within its range and tree plus the tree's rows in the ranges before. Rows
    alike in ``order`` are told apart by where they were read, so they do not fill one range.
    """
    spark = table.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), table.count() // RANGE_ROWS + 1)
    dealt = table.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(ranges, "tree", *order, "_at")
    dealt = store(dealt.withColumn("_range", F.spark_partition_id()), name)
    counts = dealt.groupBy("tree", "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.select("tree", "_range", F.coalesce(before, F.lit(0)).alias("_begin"))
    within = F.row_number().over(Window.partitionBy("tree", "_range").orderBy(*order, "_at")) - 1
    placed = dealt.withColumn("_r", within).join(begins, ["tree", "_range"])
    return store(placed.withColumn("idx", F.col("_begin") + F.col("_r")).drop("_begin", "_r", "_range", "_at"), f"{name}-places")


def blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("idx", levels))


def by_place(rows: pa.Table) -> pa.Table:
    return rows.sort_by("idx")


def block_roots(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, idx, hash): the roots of the aligned blocks of ``nodes``, which are the nodes of a higher level."""

    def roots(key: tuple, rows: pa.Table) -> pa.Table:
        block = levels_of(by_place(rows).column("hash").to_pylist(), key[1].as_py() == 0, levels)
        return pa.table({"tree": [key[0].as_py()], "idx": [key[1].as_py()], "hash": pa.array(block[-1], pa.binary())})

    return blocks(nodes.select("tree", "idx", "hash"), levels).groupBy("tree", "block").applyInArrow(roots, "tree string, idx bigint, hash binary")


def climb(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """Roots of all trees (tree, root), and (tree, idx, path) of all nodes: the steps up to the tree's root.

    ``nodes`` (tree, idx, hash) is stored and is a level of each tree. Each round turns aligned blocks
    into their roots, which are the next round's nodes, until every tree has one; then paths are put
    together from the top down. A task gets whole blocks, never a whole tree.
    """

    def steps(key: tuple, rows: pa.Table) -> pa.Table:
        rows = by_place(rows)
        block = levels_of(rows.column("hash").to_pylist(), key[1].as_py() == 0, levels)
        paths = [path_of(block, i) for i in range(rows.num_rows)]
        return pa.table({"tree": rows.column("tree"), "idx": rows.column("idx"), "block": [key[1].as_py()] * rows.num_rows, "own": pa.array(paths, pa.binary())})

    rounds = [nodes]
    while not rounds[-1].where("idx > 0").isEmpty():
        rounds.append(store(block_roots(rounds[-1], levels), "merkle-level"))
    paths = rounds[-1].select("tree", "idx", F.lit(b"").alias("path"))
    for level in reversed(rounds[:-1]):
        own = blocks(level, levels).groupBy("tree", "block").applyInArrow(steps, "tree string, idx bigint, block bigint, own binary")
        upper = paths.select("tree", F.col("idx").alias("block"), F.col("path").alias("_up"))
        paths = store(own.join(upper, ["tree", "block"]).select("tree", "idx", F.concat("own", "_up").alias("path")), "merkle-paths")
    return rounds[-1].select("tree", F.col("hash").alias("root")), paths


def manifest(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    changed_col: str = "n_chars", levels: int = LEVELS,
) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root, proof_sha256, folded_root, verified, place, copied_nodes.

    A leaf is the digest of ``fields``. Each group has a tree over its leaves, by id; subroots, by
    group, are the leaves of the tree over all. ``proof_sha256`` is the digest of the siblings on
    the way from leaf to root. Rows of :func:`tampered_ids` are tampered with: 1 is added to
    ``changed_col``, unless it is null. Each such leaf makes a version of the tree that copies its
    ancestors, ``copied_nodes`` with itself, and shares everything else; ``folded_root`` is the
    version's root, or the original's, and ``verified`` tells that it is the original's.

    Texts are read once and never moved. Blocks of 2 ** ``levels`` leaves are groups of their own; a
    version goes on above its block in the same task, along the block's path, which holds the
    untouched upper nodes beside it. So no tree, whatever its share of the rows, comes together.

    Null ids come first and are not tampered with; a null group comes first, before the empty one.
    Rows of one id are ordered by their leaf; rows alike are leaves of their own, in any order. An
    empty table gives no rows. Columns other than those named are not read.
    """
    more = F.when(tampered_ids(id_col), F.col(changed_col).cast("decimal(20,0)") + 1)
    group = F.col(group_col).cast("string")
    leaves = docs.select(
        F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group)).alias("tree"),
        F.col(id_col).cast("bigint").alias("doc_id"),
        leaf(*[F.col(f) for f in fields]).alias("hash"),
        F.when(more.isNotNull(), leaf(*[more if f == changed_col else F.col(f) for f in fields])).alias("other"),
    )
    placed = numbered(store(leaves, "merkle-leaves"), ["doc_id", "hash"], "merkle-sorted")

    tops = store(block_roots(placed, levels), "merkle-blocks")
    subroots, inner = climb(tops, levels)
    whole = numbered(store(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("root").alias("hash")), "merkle-subroots"), ["group"], "merkle-groups")
    root, outer = climb(whole.select("tree", "idx", "hash"), levels)
    above = whole.join(outer, ["tree", "idx"]).join(root, "tree").select(F.col("group").alias("tree"), F.col("hash").alias("subroot"), "root", F.col("path").alias("_up"))
    above = store(above.join(tops.groupBy("tree").agg(F.count("*").alias("_n")), "tree"), "merkle-above")
    ways = with_groups(inner, above, ["tree"], "_n").select("tree", F.col("idx").alias("block"), F.concat("path", "_up").alias("path"), "subroot", "root")

    def fold(key: tuple, rows: pa.Table, way: pa.Table) -> pa.Table:
        rows = by_place(rows)
        hashes, others = rows.column("hash").to_pylist(), rows.column("other").to_pylist()
        block = levels_of(hashes, key[1].as_py() == 0, levels)
        path, subroot, root = (way.column(c)[0].as_py() for c in ("path", "subroot", "root"))
        upper, original = siblings(path), copied(block[-1][0], path)[-1]
        proofs, folded, count = [], [], []
        for i, other in enumerate(others):
            own = path_of(block, i)
            proofs.append(hashlib.sha256((siblings(own) + upper).encode()).hexdigest())
            version = copied(other, own + path) if other is not None else []
            folded.append(version[-1] if version else original)
            count.append(len(version))
        n = rows.num_rows
        return pa.table(
            {
                "doc_id": rows.column("doc_id"), "leaf": [h.hex() for h in hashes], "subroot": [subroot.hex()] * n, "root": [root.hex()] * n, "proof_sha256": proofs,
                "folded_root": [f.hex() for f in folded], "verified": [f == root for f in folded], "place": rows.column("idx"), "copied_nodes": pa.array(count, pa.int32()),
            }
        )

    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, place bigint, copied_nodes int"
    told = blocks(placed, levels).groupBy("tree", "block").cogroup(ways.groupBy("tree", "block")).applyInArrow(fold, schema)
    return told.withColumnRenamed("doc_id", id_col)
