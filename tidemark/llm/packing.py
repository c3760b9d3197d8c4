"""Packing tokenized documents into sequences by bin completion."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, short_batches, store

END_ID = 2
#: Fillings that the branch-and-bound over the histogram looks at before it settles for the best plan so far.
NODES = 20_000
#: States of at most so many lengths are remembered and bounded by more than their sum.
SMALL = 64
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class Encoder:
    """Ids of texts under a byte-level BPE, as the ``tokenizers`` library gives them.

    ``tiktoken`` does the work where all characters belong to blocks on which the two libraries'
    character classes cannot differ; other texts, and those that hold the string of a special
    token, go to ``tokenizers`` itself.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import base64
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        special = [re.escape(t.content) for t in self.exact.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join(["[^\t\n\r -~¡-ȳΑ-ΡΣ-ϿА-я‐-‧€]", *special])).search

    def __call__(self, text: str) -> list[int]:
        if self.odd(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@cache
def encoder(json_path: str, ranks_path: str, pattern: str) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(json_path, ranks_path, pattern)


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first takes what whole pieces leave."""
    n = len(ids)
    head = n % capacity or min(n, capacity)
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


def token_pieces(docs: DataFrame, paths: dict[str, str], capacity: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(**paths)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = encode(text or "")
                found.append(END_ID)
                ids = np.array(found, "<u4")
                rows.extend((doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(ids, capacity)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return short_batches(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, PIECES)


def complete_bins(counts: dict[int, int], capacity: int, small_first: bool = False) -> list[tuple[int, dict[int, int]]]:
    """Bins as (times, {length: pieces}) for a histogram of piece lengths: one dive, without branching.

    Each step looks at the largest piece left and the room beside it. The sums that the other
    pieces can reach bound the waste of every filling from below, so branches that cannot attain
    the least waste are never entered; of the fillings that attain it the one of largest pieces
    is taken, as it dominates those in which smaller pieces stand for a larger one. It is used as
    often as the counts allow. ``small_first`` prefers small pieces instead, for a second opinion.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    out: list[tuple[int, dict[int, int]]] = []
    while left:
        big = max(left)
        room = capacity - big
        sizes = sorted((n for n in left if n <= room), reverse=not small_first)
        stock = {n: left[n] - (n == big) for n in sizes}
        mask = (1 << (room + 1)) - 1
        reach = [1] * (len(sizes) + 1)  # bit s of reach[k]: sizes[k:] can fill s exactly
        for k in range(len(sizes) - 1, -1, -1):
            bits, n, todo, part = reach[k + 1], sizes[k], min(stock[sizes[k]], room // sizes[k]), 1
            while todo > 0:
                take = min(part, todo)
                bits |= (bits << (take * n)) & mask
                todo -= take
                part *= 2
            reach[k] = bits
        fill = reach[0].bit_length() - 1
        used = {big: 1}
        for k, n in enumerate(sizes):
            if not fill:
                break
            m = min(stock[n], fill // n)
            while not reach[k + 1] >> (fill - m * n) & 1:
                m -= 1
            if m:
                used[n] = used.get(n, 0) + m
                fill -= m * n
        times = min(left[n] // m for n, m in used.items())
        out.append((times, used))
        for n, m in used.items():
            left[n] -= times * m
            if not left[n]:
                del left[n]
    return out


def first_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """First-fit decreasing over a histogram: one bin at a time takes the largest pieces that fit."""
    left = {n: c for n, c in counts.items() if c > 0}
    out: list[tuple[int, dict[int, int]]] = []
    while left:
        used: dict[int, int] = {}
        room = capacity
        for n in sorted(left, reverse=True):
            if m := min(left[n], room // n):
                used[n] = m
                room -= m * n
        times = min(left[n] // m for n, m in used.items())
        out.append((times, used))
        for n, m in used.items():
            left[n] -= times * m
            if not left[n]:
                del left[n]
    return out


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best-fit decreasing over a histogram: a piece goes where it leaves the least room.

    Bins alike in what they hold are one entry; the empty ones are the entry of full room.
    """
    alike: dict[int, list[tuple[int, dict[int, int]]]] = {capacity: [(sum(counts.values()), {})]}
    for n in sorted(counts, reverse=True):
        c = counts[n]
        while c > 0:
            room = min(r for r in alike if r >= n)
            times, used = alike[room].pop()
            m = min(c, room // n)
            k = min(times, c // m)
            if times > k:
                alike[room].append((times - k, used))
            if not alike[room]:
                del alike[room]
            alike.setdefault(room - m * n, []).append((k, used | {n: m}))
            c -= k * m
    return [(times, used) for some in alike.values() for times, used in some if used]


def fewest(counts: dict[int, int], capacity: int) -> int:
    """A bound on the bins from below: pieces above half need one each, and what else does not fit beside them."""
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    for small in {1, *(n for n in counts if 2 * n <= capacity)}:
        alone = sum(c for n, c in counts.items() if n > capacity - small)
        halves = [(n, c) for n, c in counts.items() if capacity - small >= n and 2 * n > capacity]
        room = sum((capacity - n) * c for n, c in halves)
        rest = sum(n * c for n, c in counts.items() if small <= n and 2 * n <= capacity)
        best = max(best, alone + sum(c for _, c in halves) + max(0, -(-(rest - room) // capacity)))
    return best


def dominated(used: dict[int, int], stock: dict[int, int], waste: int) -> bool:
    """Whether a piece that is not in the filling fits in place of none, one or several smaller ones of it."""
    ones, more = 0, 0  # sums of one piece, and of two or more
    for n, m in used.items():
        for _ in range(m):
            more |= (more | ones) << n
            ones |= 1 << n
    sums = 1 | ones | more
    for n, c in stock.items():
        if c > used.get(n, 0) and (more >> n & 1 or sums >> max(0, n - waste) & ((1 << min(n, waste)) - 1)):
            return True
    return False


def fillings(left: dict[int, int], capacity: int, waste: int, budget: list[int]) -> Iterator[tuple[dict[int, int], int]]:
    """The undominated fillings of a bin that holds the largest piece, with their waste, least first.

    None wastes more than ``waste``. Every filling looked at takes one of ``budget``.
    """
    big = max(left)
    room = capacity - big
    stock = {n: c - (n == big) for n, c in left.items() if n <= room and c > (n == big)}
    sizes = sorted(stock, reverse=True)
    mask = (1 << (room + 1)) - 1
    reach = [1] * (len(sizes) + 1)  # bit s of reach[k]: sizes[k:] can fill s exactly
    for k in range(len(sizes) - 1, -1, -1):
        bits, n, todo, part = reach[k + 1], sizes[k], min(stock[sizes[k]], room // sizes[k]), 1
        while todo > 0:
            take = min(part, todo)
            bits |= (bits << (take * n)) & mask
            todo -= take
            part *= 2
        reach[k] = bits

    def exact(k: int, fill: int) -> Iterator[dict[int, int]]:
        if not fill:
            yield {}
            return
        while k < len(sizes) and reach[k] >> fill & 1:
            n = sizes[k]
            for m in range(min(stock[n], fill // n), 0, -1):
                if reach[k + 1] >> (fill - m * n) & 1:
                    for rest in exact(k + 1, fill - m * n):
                        yield {n: m, **rest}
            k += 1

    for fill in range(reach[0].bit_length() - 1, max(-1, room - waste - 1), -1):
        if reach[0] >> fill & 1:
            for used in exact(0, fill):
                budget[0] -= 1
                if budget[0] < 0:
                    return
                if not dominated(used, stock, room - fill):
                    yield used | {big: used.get(big, 0) + 1}, room - fill


def branch_and_bound(
    counts: dict[int, int], capacity: int, best: list[tuple[int, dict[int, int]]], least: int, nodes: int
) -> tuple[list[tuple[int, dict[int, int]]], bool]:
    """The best plan found, and whether it is proven: it meets ``least`` or the search is exhausted.

    Depth first. A branch is an undominated filling around the largest piece left, used as often as
    the counts allow, half as often and so on down to once, which makes the search complete. It is
    cut when the waste so far, or the bound on what is left, cannot lead to fewer bins than the
    best plan has, or when the same pieces were left before after no more bins. At most ``nodes``
    fillings are looked at.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    total, budget = sum(n * c for n, c in left.items()), [nodes]
    few = sum(t for t, _ in best)
    path: list[tuple[int, dict[int, int]]] = []
    seen: dict[frozenset, int] = {}
    bins, wasted = 0, 0

    def branches() -> Iterator[tuple[int, dict[int, int], int]]:
        slack = (few - 1) * capacity - total - wasted
        for used, waste in fillings(left, capacity, slack, budget):
            times = min(left[n] // m for n, m in used.items())
            while times:
                yield times, used, waste
                times //= 2

    stack = [branches()] if left else []
    while stack and few > least and budget[0] >= 0:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path:
                times, used = path.pop()
                bins -= times
                wasted -= times * (capacity - sum(n * m for n, m in used.items()))
                for n, m in used.items():
                    left[n] = left.get(n, 0) + times * m
            continue
        times, used, waste = step
        if wasted + times * waste > (few - 1) * capacity - total:
            continue
        path.append((times, used))
        bins, wasted = bins + times, wasted + times * waste
        for n, m in used.items():
            left[n] -= times * m
            if not left[n]:
                del left[n]
        cut_off = False
        if not left:
            best, few, cut_off = list(path), bins, True
        elif len(left) <= SMALL:
            key = frozenset(left.items())
            cut_off = seen.get(key, bins + 1) <= bins or bins + fewest(left, capacity) >= few
            seen[key] = min(bins, seen.get(key, bins))
        stack.append(iter(()) if cut_off else branches())
    return best, few <= least or (budget[0] >= 0 and not stack)


def pack_histogram(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[tuple[int, dict[int, int]]]:
    """The fewest bins that the searches find; the first that meets the bound ends them."""
    least = fewest(counts, capacity)
    best = best_fit(counts, capacity)
    for attempt in (first_fit, complete_bins, lambda a, b: complete_bins(a, b, True)):
        if sum(t for t, _ in best) <= least:
            return best
        found = attempt(counts, capacity)
        if sum(t for t, _ in found) < sum(t for t, _ in best):
            best = found
    return branch_and_bound(counts, capacity, best, least, nodes)[0]


def pack(
    docs: DataFrame, paths: dict[str, str], capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: where it lies in which sequence of at most ``capacity`` tokens.

    A document's ids end with id 2; null and empty texts are that id alone. Documents longer than
    ``capacity``, however long, are cut into full pieces behind a first one that takes the rest.
    Packing needs the lengths only: their histogram has at most ``capacity`` entries, whatever the
    number of documents, so the driver searches over it and gets a plan of that order. Pieces of a
    length are numbered without gaps (repeated rows are pieces of their own, those alike in id,
    piece and ids in any order among themselves) and the number tells sequence and offset. Null
    ids stay null, no other column is read, so names never clash, and an empty table gives no
    rows. ``paths`` names the tokenizer's files: json_path, ranks_path, pattern.
    """
    spark = docs.sparkSession
    pieces = store(token_pieces(docs, paths, capacity, id_col, text_col), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    given, sequence, plan = dict.fromkeys(counts, 0), 0, []
    for times, used in pack_histogram(counts, capacity):
        offset = 0
        for n in sorted(used, reverse=True):
            m = used[n]
            plan.append((n, given[n], given[n] + times * m, m, sequence, offset))
            given[n] += times * m
            offset += m * n
        sequence += times
    table = spark.createDataFrame(plan, "_length bigint, _from bigint, _to bigint, _m bigint, _sequence bigint, _offset bigint")
    ranked = gapless_rank(pieces, "length", [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "_rank")
    at = F.col("_rank") - F.col("_from")
    return ranked.join(
        F.broadcast(table), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    ).select(
        F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("_sequence") + F.expr("(_rank - _from) div _m")).alias("sequence_id"),
        (F.col("_offset") + (at % F.col("_m")) * F.col("length")).alias("offset"),
    )
