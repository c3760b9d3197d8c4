"""Sharding: a k-d tree over metadata, split at weighted medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import below, gapless_rank, store, weighted_cuts, with_groups

#: A cut may miss its weight by this part of a shard to leave equal texts together.
SLACK = 0.01


def dense_ranks(table: DataFrame, column: str) -> DataFrame:
    """(value, rank): the distinct values of ``column`` numbered from 0 in their order, null first.

    A distributed sort: ranges of values are ranked each by itself, and a range starts where those
    before it end. The driver gets one row a range.
    """
    spark = table.sparkSession
    values = table.select(F.col(column).alias("value")).distinct().repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.asc_nulls_first("value"))
    ranges = store(values.withColumn("range", F.spark_partition_id()), "value-ranges")
    counts = sorted((r["range"], r["count"]) for r in ranges.groupBy("range").count().collect())
    starts, at = [], 0
    for k, n in counts:
        starts.append((k, at))
        at += n
    begin = F.broadcast(spark.createDataFrame(starts, "range int, _begin bigint"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(F.asc_nulls_first("value"))) - 1
    return store(ranges.withColumn("_r", within).join(begin, "range").select("value", (F.col("_begin") + F.col("_r")).alias("rank")), "value-ranks")


def ranked(table: DataFrame, column: str) -> DataFrame:
    """``table`` with ``column`` replaced by ``k_<column>``, the dense rank of its value."""
    ranks = dense_ranks(table, column)
    groups = store(table.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n")).join(ranks, F.col("_v").eqNullSafe(F.col("value"))).select(F.struct("value").alias("_value"), "_n", F.col("rank").alias(f"k_{column}")), "value-groups")
    return with_groups(table.withColumn("_value", F.struct(F.col(column).alias("value"))), groups, ["_value"], "_n").drop("_value", "_n", column)


def kd_shards(table: DataFrame, dimensions: list[str], ties: list[str], size: str, shards: int, slack: float = SLACK) -> DataFrame:
    """Add ``shard``, 0 to ``shards`` - 1, to a stored table of long columns.

    The tree starts as one node that owes all shards. On each level every node that owes more than
    one is cut along its widest dimension (its range there over the whole table's range; of
    equally wide ones the first) at the weighted median, or the weighted share of an odd number
    of shards. Rows alike in that dimension are ordered by ``ties``, so a hot value is cut too.
    The cuts of a level are found together, by distributed sums; the driver holds the tree only.
    """
    spans = table.agg(*[f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("lo", F.min), ("hi", F.max))], F.sum(size).alias("w")).first()
    total = spans["w"] or 0
    assigned: Column = F.lit(0)
    nodes = {0: shards}  # first shard -> number of shards
    while any(n > 1 for n in nodes.values()) and total:
        open_nodes = [first for first, n in nodes.items() if n > 1]
        placed = table.withColumn("_node", assigned)
        rows = placed.where(F.col("_node").isin(open_nodes)).groupBy("_node").agg(
            *[f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("lo", F.min), ("hi", F.max))], F.sum(size).alias("w")
        )
        cuts, by_dimension = {}, {}
        for row in rows.collect():
            wide = max(dimensions, key=lambda d: ((row[f"hi_{d}"] - row[f"lo_{d}"]) / max(1, spans[f"hi_{d}"] - spans[f"lo_{d}"]), -dimensions.index(d)))
            left = nodes[row["_node"]] // 2
            by_dimension.setdefault(wide, {})[row["_node"]] = row["w"] * left // nodes[row["_node"]]
        for wide, needs in by_dimension.items():
            keys = [wide, *[t for t in ties if t != wide]]
            found = weighted_cuts(placed, "_node", keys, size, needs, dict.fromkeys(needs, total / shards * slack))
            cuts |= {g: (keys, cut) for g, cut in found.items()}
        moved = F.lit(None).cast("int")
        for g, (keys, cut) in cuts.items():
            moved = F.when((assigned == g) & ~below(cut, keys), F.lit(g + nodes[g] // 2)).otherwise(moved)
        assigned = F.coalesce(moved, assigned)
        table = store(table.withColumn("_next", assigned).drop("_at").withColumnRenamed("_next", "_at"), "kd-level")
        assigned = F.col("_at")
        for g in open_nodes:
            n = nodes[g]
            nodes[g], nodes[g + n // 2] = n // 2, n - n // 2
    return table.withColumn("shard", assigned.cast("int")).drop("_at")


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row per document with its shard and its place there; the shards' bytes are near equal.

    Size is the text's UTF-8 bytes plus 1; a null text has none. Dimensions of the tree: size, the
    id, and the string columns of ``metadata``, whose values count by their dense rank, so values
    that begin alike are cut apart too. Equal texts (of one size and CRC) form a group that lies
    where its smallest id lies, in all dimensions, and ties are ordered by CRC. So a cut goes
    through at most one group, and only if leaving that whole would put more than ``SLACK`` of a
    shard on the wrong side. A null id counts as -1, a null of the metadata comes before all
    values. Repeated rows each get a slot, those alike in any order among themselves. Other
    columns are not read; an empty table gives no rows. Works from metadata only: texts, however
    long, are read once and never moved; ids may be as far apart as longs are.
    """
    binary = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    table = store(
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"),
            (F.length(binary) + 1).cast("bigint").alias("size"),
            F.crc32(binary).alias("text_crc32"),
            F.coalesce(F.col(id_col).cast("bigint"), F.lit(-1)).alias("k_id"),
            *[F.col(m).cast("string").alias(f"m{n}") for n, m in enumerate(metadata)],
        ),
        "shard-metadata",
    )
    own = ["k_id"]
    for n in range(len(metadata)):
        table = store(ranked(table, f"m{n}"), "shard-ranked")
        own.append(f"k_m{n}")
    places = table.groupBy("text_crc32", "size").agg(F.min(F.struct(*own)).alias("at"), F.count("*").alias("_n"))
    places = store(places.select("text_crc32", "size", "_n", *[F.col(f"at.{c}").alias(f"g{c}") for c in own]), "shard-groups")
    grouped = store(with_groups(table.drop(*own[1:]), places, ["text_crc32", "size"], "_n").drop("_n"), "shard-grouped")
    dimensions = ["size", *[f"g{c}" for c in own[1:]], "gk_id"]
    placed = kd_shards(grouped, dimensions, ["text_crc32", "k_id"], "size", shards)
    numbered = gapless_rank(store(placed, "shard-placed"), "shard", [F.col("k_id"), F.col("text_crc32"), F.col("size")], "slot")
    return numbered.select(F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
