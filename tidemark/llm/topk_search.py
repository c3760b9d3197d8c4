"""Exact top-k inner products by no-random-access aggregation over sorted lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: Bound below which doubles hold sums of products exactly.
EXACT = float(1 << 53)
#: The range of a score.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Just below the range's end, at which all larger scores tie.
TIED = MOST * (1 - 1e-15)
#: How much of the lists is read before each look at the bounds.
DEPTHS = (0.0, 0.5, 0.65, 0.8, 1.0)
#: Outsiders this few are resolved instead of reading on.
RESOLVE = 256
#: Queries whose bounds are kept at a time.
TOGETHER = 256
#: Each round reads so many times the blocks of all before it.
WIDER = 8


class SortedLists:
    """A block of vectors as one descending list of (value, row) per dimension, read from either end."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.sorted = -np.sort(-vectors, axis=0)
        self.largest = np.abs(vectors).max(axis=1, initial=0.0)
        #: Entries that were read so far.
        self.read = 0

    def reach(self, queries: np.ndarray, k: int, barred: np.ndarray, floor: np.ndarray, depths: tuple[float, ...] = DEPTHS, resolve: int = RESOLVE) -> list[np.ndarray]:
        """For each query the rows that may be among its ``k`` best, ties included; all others are provably below.

        A query reads each list from the end that suits its weight's sign. A row's upper bound
        takes the components that were read and, for the others, the value at which their list
        stands; its lower bound takes the far end of those lists. ``floor`` is a score that the
        k-th best is known to reach, -inf if none is; the k-th best lower bound raises it. Rows
        whose upper bound is below are out. A query is done when few are left to be resolved, at
        depth 0 if even the lists' first entries together stay below the floor. ``barred`` (rows,
        queries) are not candidates. Bounds leave room for what doubles round.
        """
        n, dims = self.vectors.shape
        alive = ~barred
        floor = floor.copy()
        if n <= resolve:
            return [np.flatnonzero(alive[:, j]) for j in range(len(queries))]
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        todo, before = np.arange(len(queries)), 0
        size = np.abs(queries).max(axis=1, initial=0.0)
        with np.errstate(over="ignore", invalid="ignore"):
            for depth in depths:
                end = int(np.ceil(n * depth))
                self.read += len(todo) * dims * (end - before)
                before = end
                top, bottom = (self.sorted[end - 1], self.sorted[n - end]) if end else (self.sorted[0], self.sorted[-1])
                if not end:
                    high = up[todo] @ top + down[todo] @ bottom
                    high = np.nan_to_num(high + size[todo] * self.largest.max() * dims * dims * 1e-15, nan=np.inf, posinf=np.inf)
                    out = high < floor[todo]
                    alive[:, todo[out]] = False
                    todo = todo[~out]
                    continue
                rows = np.flatnonzero(alive[:, todo].any(axis=1))
                x = self.vectors[rows]
                room = np.outer(self.largest[rows], size[todo]) * (dims * dims * 1e-15)
                if depth < 1.0 and (floor[todo] == -np.inf).any():
                    low = np.where(x >= top, x, self.sorted[-1]) @ up[todo].T + np.where(x <= bottom, x, self.sorted[0]) @ down[todo].T - room
                    low = np.where(alive[np.ix_(rows, todo)], np.nan_to_num(low, nan=-np.inf, neginf=-np.inf), -np.inf)
                    if len(rows) >= k:
                        floor[todo] = np.minimum(np.maximum(floor[todo], np.partition(low, len(rows) - k, axis=0)[len(rows) - k]), TIED)
                high = np.nan_to_num(np.maximum(x, top) @ up[todo].T + np.minimum(x, bottom) @ down[todo].T + room, nan=np.inf, posinf=np.inf)
                alive[np.ix_(rows, todo)] &= high >= floor[todo]
                todo = todo[alive[:, todo].sum(axis=0) > resolve]
                if not len(todo):
                    break
        return [np.flatnonzero(alive[:, j]) for j in range(len(queries))]


def scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of integral doubles, kept within the range of a score."""
    if not vectors.size:
        return np.zeros(len(vectors), np.int64)
    if float(np.abs(vectors).max()) * float(np.abs(query).max(initial=0.0)) * vectors.shape[1] < EXACT:
        return (vectors @ query).astype(np.int64)
    weights = [int(w) for w in query.tolist()]
    return np.array([min(MOST, max(LEAST, sum(int(a) * b for a, b in zip(row, weights, strict=True) if a and b))) for row in vectors.tolist()], np.int64)


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Lists as rows, shorter ones padded with zeros."""
    held = column.combine_chunks()
    offsets = held.offsets.to_numpy()
    lengths = np.diff(offsets)
    out = np.zeros((len(held), dims))
    row = np.repeat(np.arange(len(held)), lengths)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = held.values.to_numpy()[offsets[0] : offsets[-1]]
    return out


def block_best(held: pa.Table, wanted: pa.Table, k: int, resolve: int = RESOLVE) -> tuple[list[tuple[int, int, int]], int]:
    """(own, id, score) of the rows of a block that may be among a query's ``k`` best, and the entries read. A query's own row is none."""
    longest = [max(c.combine_chunks().value_lengths().to_pylist(), default=0) for c in (held.column("v"), wanted.column("v"))]
    dims = max(longest)
    x, q = matrix(held.column("v"), dims), matrix(wanted.column("v"), dims)
    ids, rows_of, asking = held.column("vec_id").to_numpy(), held.column("own").to_numpy(), wanted.column("own").to_numpy()
    known = np.array([-np.inf if f is None else f for f in wanted.column("floor").to_pylist()], float)
    known -= np.where(np.isinf(known), 0, np.abs(known) * 1e-15)
    lists, out = SortedLists(x), []
    for a in range(0, len(q), TOGETHER):
        some = slice(a, a + TOGETHER)
        able = lists.reach(q[some], k, rows_of[:, None] == asking[None, some], known[some], resolve=resolve)
        for own, weights, rows in zip(asking[some].tolist(), q[some], able, strict=True):
            found = scores(x[rows], weights)
            best = np.lexsort((ids[rows], -found.astype(object) if len(found) and found.min() == LEAST else -found))[:k]
            out.extend((own, int(ids[rows[i]]), int(found[i])) for i in best)
    return out, lists.read


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 4096, query_rows: int = 4096, row_col: str | None = None) -> DataFrame:
    """(query_id, rank, id, score): for each query its ``k`` largest inner products with other rows' vectors.

    Both tables hold an id and an array of integral doubles, as :func:`integral` gives them, and
    perhaps other columns; shorter vectors count as padded with zeros. Ties go to the smaller id.
    ``row_col`` is a long that names a row in both tables (see :func:`rows_named`), so that a query's own
    row is no candidate while other rows of its id are, and every query row gets its own result.
    Without it the id names the row, and ids must not repeat. Scores outside the range of a long
    count as its end. Empty tables give no rows.

    Candidates are dealt into blocks by hash and visited in rounds, each of ``WIDER`` times the blocks
    of those before. The k-th best score that the rounds so far have found is a query's floor in
    the next one, so blocks stop reading early and a query's rows per round do not grow with the
    blocks: what beats the best of an eighth of the candidates is about ``WIDER`` times k. Each pair
    of a block of candidates and a block of queries is one group of bounded size.
    """
    own = F.col(row_col or id_col).cast("bigint").alias("own")
    candidates = vectors.select(F.col(id_col).alias("vec_id"), own, F.col(vector_col).alias("v"))
    asked = queries.select(F.col(id_col).alias("query_id"), own, F.col(vector_col).alias("v"))
    n_candidates, n_asked = vectors.count(), queries.count()
    blocks, query_blocks = max(1, -(-n_candidates // block_rows)), max(1, -(-n_asked // query_rows))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    candidates = store(candidates.withColumn("cb", deal("own", blocks)), "candidates")
    asked = store(asked.withColumn("qb", deal("own", query_blocks)), "queries")

    def run(held: pa.Table, wanted: pa.Table) -> pa.Table:
        out = block_best(held, wanted, k)[0] if held.num_rows and wanted.num_rows else []
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("own", "vec_id", "score"), columns, strict=True)})

    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "vec_id"))
    best, low = None, 0
    while low < blocks:
        high = min(blocks, max(1, low * WIDER))
        known = asked.withColumn("floor", F.lit(None).cast("double"))
        if best is not None:
            floors = best.where(F.col("rank") == k).select("own", F.col("score").cast("double").alias("floor"))
            known = asked.join(floors.hint("merge"), "own", "left")
        left = candidates.where(F.col("cb").between(low, high - 1)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
        right = known.drop("query_id").withColumn("cb", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
        found = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInArrow(run, "own bigint, vec_id bigint, score bigint")
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = store(found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k), "best-so-far")
        low = high
    named = asked.select("own", "query_id").hint("merge")
    return best.join(named, "own").select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


def rows_named(vectors: DataFrame, name: str = "row") -> DataFrame:
    """``vectors`` with a number of its own for each row, written, so that it stays what it is."""
    return store(vectors.withColumn(name, F.monotonically_increasing_id()), "vectors")


def integral(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector): components x as floor(scale * x), as doubles, whatever their size.

    Rows take no part whose id or vector is null, or whose vector holds a null or a component that
    is not finite, or no more so after scaling. Empty vectors do, as zeros.
    """
    scaled = F.transform(F.col(vector_col), lambda x: x.cast("double") * scale)
    fine = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # From 2 ** 52 on all doubles are whole, and beyond the long range floor() would not hold them.
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x))
    return vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("bigint").alias(id_col), whole.alias(vector_col))
