"""Cross-entropy difference: a target and a background n-gram model over one vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, store
from .substring_dedup import Hasher, chunks, split_words

#: Words are spelled by a model of bytes, each after the two before it.
ORDER = 3
SIZE = 256**ORDER
SPACE = 32
#: Words of a group of documents whose word counts travel together.
GROUP_WORDS = 1 << 20
#: Bytes of a group, unless one text alone is longer; places of words are 32-bit.
GROUP_BYTES = 64 << 20
#: Words that are spelled at a time.
SPELLED = 1 << 17
#: The most frequent words, whose counts are sent to all tasks. The others are joined by a shuffle.
FREQUENT = 1 << 17
#: Documents of a group, and occurrences in one entry, as they are packed into 32 bits.
GROUP_DOCS, MOST = 1 << 16, (1 << 15) - 1

SCANNED = (
    "group bigint, word bigint, spelled_background float, spelled_target float, entries binary, "
    "ids array<bigint>, tokens array<int>, wanted array<boolean>, background array<double>, target array<double>"
)
NAMES = [f.split()[0] for f in SCANNED.split(", ")]


def text_bytes(column: str):
    return F.coalesce(F.col(column), F.lit("")).cast("binary").alias("text")


def flagged(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, wanted): whether a document's id is among those of ``wanted``.

    The ids are broadcast while they are few bytes, otherwise joined by a shuffle.
    """
    ids = store(wanted.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id")).distinct().withColumn("wanted", F.lit(True)), "wanted")
    sent = F.broadcast(ids) if ids.count() * 64 <= BROADCAST_BYTES else ids.hint("merge")
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_bytes(text_col))
    return source.join(sent, "doc_id", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))


def codes(text: np.ndarray) -> np.ndarray:
    """Each byte with the two before it as one number; the text is led by two spaces."""
    padded = np.r_[np.full(2, SPACE, np.int32), text.astype(np.int32)]
    return (padded[:-2] << 16) | (padded[1:-1] << 8) | padded[2:]


def grouped(batches: Iterator[pa.RecordBatch], hasher: Hasher) -> Iterator[tuple[list[tuple], np.ndarray, tuple[np.ndarray, ...]]]:
    """Groups of a task's documents: (id, tokens, wanted) of each, their bytes, and their words as (hash, document, start, end)."""
    held: list[tuple[np.ndarray, ...]] = []
    documents: list[tuple] = []
    n_words = n_bytes = 0

    def group() -> tuple[list[tuple], np.ndarray, tuple[np.ndarray, ...]]:
        out = tuple(np.concatenate([h[k] for h in held]) for k in range(5))
        held.clear()
        return documents, out[0], out[1:]

    for batch in batches:
        ids, wanted = batch.column("doc_id").to_pylist(), batch.column("wanted").to_pylist()
        for first, data, offsets in chunks(batch.column("text")):
            start, end, owner = split_words(data, offsets)
            if documents and (n_words + len(start) > GROUP_WORDS or len(documents) + len(offsets) > GROUP_DOCS or n_bytes + len(data) > GROUP_BYTES):
                yield group()
                documents, n_words, n_bytes = [], 0, 0
            tokens = np.bincount(owner, minlength=len(offsets) - 1).tolist()
            held.append((data.copy(), hasher.words(data, start, end), (owner + len(documents)).astype(np.int32), (start + n_bytes).astype(np.int32), (end + n_bytes).astype(np.int32)))
            documents = documents + list(zip(ids[first : first + len(tokens)], tokens, wanted[first : first + len(tokens)], strict=True))
            n_words, n_bytes = n_words + len(start), n_bytes + len(data)
    if documents:
        yield group()


def count(docs: DataFrame) -> DataFrame:
    """(spelling, gram, background, target): how often each word occurs, and each three bytes in words between spaces.

    A task adds up its groups of documents first.
    """

    def summed(spelling: bool, gram: np.ndarray, wanted: np.ndarray) -> pa.RecordBatch:
        kinds, back = np.unique(gram, return_inverse=True)
        columns = (np.full(len(kinds), spelling), kinds.astype(np.int64), np.bincount(back, minlength=len(kinds)), np.bincount(back, wanted, len(kinds)).astype(np.int64))
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["spelling", "gram", "background", "target"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for documents, data, (word, doc, start, end) in grouped(batches, Hasher()):
            flag = np.array([w for _, _, w in documents], bool)[doc]
            yield summed(False, word.view(np.int64), flag)
            for k in range(0, len(word), SPELLED):
                # Each word behind two spaces and before one.
                some = slice(k, k + SPELLED)
                length = (end[some] - start[some] + 3).astype(np.int64)
                at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
                spaced = np.full(len(at), SPACE, np.uint8)
                inside = np.flatnonzero((at >= 2) & (at < np.repeat(length, length) - 1))
                spaced[inside] = data[(np.repeat(start[some], length) + at - 2)[inside]]
                yield summed(True, codes(spaced)[at >= 2], np.repeat(flag[some], length)[at >= 2])

    found = docs.mapInArrow(run, "spelling boolean, gram bigint, background bigint, target bigint")
    return found.groupBy("spelling", "gram").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


def log_model(code: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log2 p of a byte after its two for the given codes: Witten-Bell interpolation.

    Each order is mixed with the next lower in proportion to its context's count and its distinct
    continuations; the lowest is uniform over the bytes.
    """
    p = np.full(len(code), 1 / 256)
    for order in range(1, ORDER + 1):
        gram = code % 256**order
        kinds_of, at = np.unique(gram, return_inverse=True)
        n = np.bincount(at, counts, len(kinds_of))
        contexts, context = np.unique(kinds_of // 256, return_inverse=True)
        context_n, kinds = np.bincount(context, n, len(contexts)), np.bincount(context[n > 0], minlength=len(contexts))
        lot = np.maximum(kinds, 1)
        p = (n[at] + lot[context[at]] * p) / (context_n[context[at]] + lot[context[at]])
    return np.log2(p)


def spelled(data: np.ndarray, start: np.ndarray, end: np.ndarray, index: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """log2 p of words between spaces under each of ``logs``: of their bytes and the space behind.

    ``index`` tells where in ``logs`` a code stands.
    """
    if not len(start):
        return np.zeros((len(logs), 0))
    length = end - start + 1
    first = np.cumsum(length) - length
    at = np.arange(int(length.sum())) - np.repeat(first, length)
    byte = np.append(data, SPACE).astype(np.int64)[np.repeat(start, length) + at]
    byte[first + length - 1] = SPACE
    one, two = np.r_[SPACE, byte[:-1]], np.r_[SPACE, SPACE, byte[:-2]]
    one[at == 0], two[at <= 1] = SPACE, SPACE
    return np.add.reduceat(logs[:, index[(two << 16) | (one << 8) | byte]].astype(np.float64), first, axis=1)


def weighed(n: np.ndarray, others: np.ndarray, spelling: np.ndarray) -> np.ndarray:
    """``n`` times log2 of the count in other documents plus what the spelling adds, as log2."""
    with np.errstate(divide="ignore"):
        return n * np.logaddexp2(np.log2(others), spelling)


def scan(docs: DataFrame, code: np.ndarray, logs: np.ndarray, frequent: np.ndarray, counts: np.ndarray, kinds: np.ndarray) -> DataFrame:
    """Rows of ``SCANNED``: for each group of documents its rarer words, and one row, of null word, of its documents.

    ``frequent`` are sorted words, ``counts`` theirs; documents' sums over them are found here. A row
    of another word has how likely it is spelled, and its entries: 16 bits for the document's
    place in the group, one if the document is of the target, 15 for the occurrences.
    """
    sent = docs.sparkSession.sparkContext.broadcast((code.astype(np.int32), logs.astype(np.float32), frequent, counts))
    log_kinds = np.log2(kinds + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, logs, frequent, counts = sent.value
        index = np.zeros(SIZE, np.int32)
        index[code] = np.arange(len(code))
        group = (TaskContext.get().partitionId() << 24) - 1
        for documents, data, (word, doc, start, end) in grouped(batches, Hasher()):
            group += 1
            ids, tokens, wanted = zip(*documents, strict=True)
            flag = np.array(wanted, np.int64)
            order = np.lexsort((doc, word))
            sorted_doc, sorted_word = doc[order], word[order].view(np.int64)
            new_word = np.r_[True, sorted_word[1:] != sorted_word[:-1]][: len(word)]
            pair = np.flatnonzero(new_word | np.r_[True, sorted_doc[1:] != sorted_doc[:-1]][: len(word)])
            n, pair_doc, heads = np.diff(np.r_[pair, len(word)]), sorted_doc[pair].astype(np.int64), np.flatnonzero(new_word[pair])
            at = order[pair[heads]]
            logs_of = spelled(data, start[at], end[at], index, logs)
            of = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(pair)]))  # each pair's word
            words = sorted_word[pair[heads]]
            place = np.minimum(np.searchsorted(frequent, words), max(0, len(frequent) - 1))
            known = frequent[place] == words if len(frequent) else np.zeros(len(words), bool)

            mine = known[of]
            sums = []
            for k, own in enumerate((n, n * flag[pair_doc])):
                others = (counts[k][place[of[mine]]] if len(frequent) else of[mine]) - own[mine]
                sums.append(np.bincount(pair_doc[mine], weighed(n[mine], others, log_kinds[k] + logs_of[k][of[mine]]), len(documents)))

            n, pair_doc, of = n[~mine], pair_doc[~mine], of[~mine]
            parts = (n - 1) // MOST + 1  # entries of an occurrence count that 15 bits do not hold
            entry_n = np.full(int(parts.sum()), MOST)
            entry_n[np.cumsum(parts) - 1] = n - (parts - 1) * MOST
            entry_doc, entry_of = np.repeat(pair_doc, parts), np.repeat(of, parts)
            packed = (entry_doc | (flag[entry_doc] << 16) | (entry_n << 17)).astype("<u4")
            rare = np.flatnonzero(~known)
            begin = np.searchsorted(entry_of, np.r_[rare, len(heads)])
            none = lambda kind, k: pa.nulls(k, kind)
            lists = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.float64()), pa.list_(pa.float64()))
            for a in range(0, len(rare), 50_000):
                b = min(len(rare), a + 50_000)
                entries = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(((begin[a : b + 1] - begin[a]) * 4).astype(np.int32).tobytes()), pa.py_buffer(packed[begin[a] : begin[b]].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, group)), pa.array(words[rare[a:b]]), *(pa.array(x[rare[a:b]].astype(np.float32)) for x in logs_of), entries, *(none(k, b - a) for k in lists)], names=NAMES)
            rows = [pa.array([group]), none(pa.int64(), 1), none(pa.float32(), 1), none(pa.float32(), 1), none(pa.binary(), 1)]
            yield pa.RecordBatch.from_arrays([*rows, *(pa.array([list(x)], k) for x, k in zip((ids, tokens, wanted, *sums), lists, strict=True))], names=NAMES)

    return docs.mapInArrow(run, SCANNED)


def losses(entries: DataFrame, kinds: np.ndarray) -> DataFrame:
    """(doc, rare_background, rare_target): documents' sums over their words in rows of :func:`scan` with the words' counts."""
    log_kinds = np.log2(kinds + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("entries")
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            packed = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<u4").astype(np.int64)
            row = np.repeat(np.arange(len(column)), np.diff(offsets) // 4)
            n, flag = packed >> 17, (packed >> 16) & 1
            doc = (batch.column("group").to_numpy()[row] << 16) | (packed & 0xFFFF)
            # A document with over MOST of a word has it in neighbouring entries of the row.
            first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])])
            n, row, doc, flag = np.add.reduceat(n, first), row[first], doc[first], flag[first]
            docs, at = np.unique(doc, return_inverse=True)
            sums = []
            for k, (name, own) in enumerate((("background", n), ("target", n * flag))):
                others = batch.column(name).to_numpy()[row] - own
                sums.append(np.bincount(at, weighed(n, others, log_kinds[k] + batch.column(f"spelled_{name}").to_numpy()[row].astype(float)), len(docs)))
            yield pa.RecordBatch.from_arrays([pa.array(docs), *map(pa.array, sums)], names=["doc", "background", "target"])

    found = entries.mapInArrow(run, "doc bigint, background double, target double").groupBy("doc")
    return found.agg(F.sum("background").alias("rare_background"), F.sum("target").alias("rare_target"))


def score_documents(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per document: id, tokens, ``score`` and its parts, background_loss and target_loss.

    The background model is counted over all of ``docs``, the target model over those whose id is
    among ``wanted`` (nulls and repeats there do not matter). Both share one vocabulary, the words
    (runs of anything but ASCII white space) as 64-bit hashes. A word's probability is its count in
    the other documents, this one's own occurrences being held out of both models, mixed with how
    the model's bytes, in trigrams interpolated down to the uniform one, spell it between spaces;
    the spelling weighs as many occurrences as the model has distinct words, and one. A loss is
    the mean of -log2 p per word, the score background_loss - target_loss: the higher, the closer
    to the target. Null texts and those without words have losses and score 0. Repeated rows
    count, and are scored, each; null ids are of the background only. Texts are read whole, each up to
    Arrow's 2 GiB; a group of texts is bounded by its bytes. Other columns are not read.
    Empty tables give no rows.

    Tasks get the counts of bytes, at most 2 ** 24 rows whatever the input, and of the ``frequent``
    most frequent words. The others grow with the input: documents are scanned in groups, whose
    rarer words meet the counts of the whole corpus in a join, and their sums return to the
    documents. Words that many documents have are among the frequent ones, so no key of the join
    is hot, and no text is moved.
    """
    source = flagged(docs, wanted, id_col, text_col)
    counted = store(count(source), "gram-counts")
    table = counted.where("spelling").orderBy("gram").toArrow()
    code, *byte_counts = (table.column(c).to_numpy().astype(np.int64) for c in ("gram", "background", "target"))
    words = counted.where("not spelling").select(F.col("gram").alias("word"), "background", "target")
    n_b, n_t, *kinds = (x or 0 for x in words.agg(F.sum("background"), F.sum("target"), F.count("*"), F.sum((F.col("target") > 0).cast("bigint"))).first())
    kinds = np.array(kinds, float)
    top = words.orderBy(F.desc("background"), "word").limit(frequent).toArrow().sort_by("word")
    top_words, *top_counts = (top.column(c).to_numpy() for c in ("word", "background", "target"))
    scanned = store(scan(source, code, np.stack([log_model(code, c) for c in byte_counts]), top_words, np.stack(top_counts), kinds), "scanned-words")
    entries = scanned.where("word is not null").select("group", "word", "spelled_background", "spelled_target", "entries")
    # These words grow with the documents, so neither side is broadcast.
    sums = losses(entries.join(words.hint("merge"), "word"), kinds)
    heads = scanned.where("word is null").select("group", F.posexplode(F.arrays_zip("ids", "tokens", "wanted", "background", "target")).alias("place", "d"))
    heads = heads.select(F.shiftleft("group", 16).bitwiseOR(F.col("place").cast("bigint")).alias("doc"), "d.*")

    def mean(name: str, n: int, own, kinds: float):
        total = F.col("tokens") * F.log2(F.lit(n) - own + F.lit(kinds + 1.0)) - F.col(name) - F.coalesce(f"rare_{name}", F.lit(0.0))
        return F.coalesce(total / F.nullif("tokens", F.lit(0)), F.lit(0.0)).alias(f"{name}_loss")

    own = F.when(F.col("wanted"), F.col("tokens")).otherwise(0)
    done = heads.join(sums, "doc", "left").select(
        F.col("ids").alias(id_col), F.col("tokens").cast("bigint").alias("tokens"), mean("background", n_b, F.col("tokens"), float(kinds[0])), mean("target", n_t, own, float(kinds[1]))
    )
    return done.withColumn("score", F.col("background_loss") - F.col("target_loss"))
