"""Conversation structure repair: cheapest edits by a Viterbi search whose survivors emit what they agree on."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: States of the role grammar: nothing yet, after the system's turn, after the user's, after the assistant's.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: What a role's initial does when kept.
KEEP = {b"s": {NONE: SYSTEM}, b"u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, b"a": {USER: ASSISTANT}}
#: The user's or the assistant's turn, whichever may come next.
NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What it costs at most to go on from the first state as one may go on from the second.
IMITATE = {
    (NONE, SYSTEM): 0, (NONE, USER): 3, (NONE, ASSISTANT): 0, (SYSTEM, NONE): 6, (SYSTEM, USER): 3, (SYSTEM, ASSISTANT): 6,
    (USER, NONE): 7, (USER, SYSTEM): 3, (USER, ASSISTANT): 3, (ASSISTANT, NONE): 4, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): 3,
}
LEGAL = {b"su", b"ua", b"au"}
#: Rows of an Arrow batch that are Python objects at a time.
SLICE = 256


class Node:
    """A row's edits in the tree of back pointers; ``refs`` counts the nodes that follow and the state that survives here."""

    __slots__ = ("parent", "edits", "kids", "refs")

    def __init__(self, parent: Node | None, edits: str):
        self.parent, self.edits, self.kids, self.refs = parent, edits, [], 1
        if parent:
            parent.kids.append(self)
            parent.refs += 1

    def release(self) -> None:
        """Give up one reference; nodes without any go, and so may those before them."""
        node = self
        while node:
            node.refs -= 1
            if node.refs or not node.parent:
                return
            before, node.parent = node.parent, None
            before.kids.remove(node)
            node = before


def rest(x: str, y: str) -> tuple[str, str]:
    """Two texts from where they differ, a letter each; if one begins the other, what the other has more."""
    k = 0
    while k < len(x) and k < len(y) and x[k] == y[k]:
        k += 1
    return (x[k], y[k]) if k < len(x) and k < len(y) else (x[k:], y[k:])


class Search:
    """The cheapest edits of one conversation, of equally cheap ones those that read least.

    Each state keeps one survivor. What survivors of a pair differ in is kept as the place where their
    whole unresolved edits part, so a tie is decided by all of them without reading them again. A
    survivor that another one can imitate at less cost is dropped, which never loses a cheapest or
    tied end. Rows wait only until all survivors share the node of their edits.
    """

    def __init__(self, emit):
        self.root = Node(None, "")
        self.alive: dict[int, tuple[int, Node]] = {NONE: (0, self.root)}
        self.differ: dict[tuple[int, int], tuple[str, str]] = {}
        self.waiting: deque = deque()
        self.emit = emit

    def gap(self, s: int, t: int) -> tuple[str, str]:
        if s == t:
            return "", ""
        x, y = self.differ[min(s, t), max(s, t)]
        return (x, y) if s < t else (y, x)

    def parted(self, s: int, x: str, t: int, y: str) -> tuple[str, str]:
        """How state ``s``'s edits with ``x`` part from ``t``'s with ``y``."""
        p, q = self.gap(s, t)
        return (p, q) if p and q else rest(p + x, q + y)

    def step(self, options: list[tuple[int, str, int, int]]) -> None:
        """Go on by ``options``: (from, edits, to, cost)."""
        best: dict[int, tuple[int, int, str]] = {}
        for source, edits, to, cost in options:
            if source in self.alive:
                total = self.alive[source][0] + cost
                known = best.get(to)
                if known is None or total < known[0] or total == known[0] and (d := self.parted(source, edits, known[1], known[2]))[0] < d[1]:
                    best[to] = (total, source, edits)
        for s in list(best):
            if any(best[t][0] + IMITATE[t, s] < best[s][0] for t in best if t != s):
                del best[s]
        self.differ = {(s, t): self.parted(best[s][1], best[s][2], best[t][1], best[t][2]) for s, t in combinations(sorted(best), 2)}
        before = self.alive
        self.alive = {s: (total, Node(before[source][1], edits)) for s, (total, source, edits) in best.items()}
        for _, node in before.values():
            node.release()

    def settle(self) -> None:
        """Emit the edits that all survivors share."""
        while self.root.refs == 1 and self.root.kids:
            node = self.root.kids[0]
            node.parent, self.root.kids = None, []
            self.root = node
            self.emit(node.edits, self.waiting.popleft() if self.waiting else None)

    def add(self, role: bytes, text: bytes, must_go: bool, truncated: bool) -> None:
        """One more row: it may be kept, get the other role, or go, after up to two inserted turns."""
        self.waiting.append((role, text))
        options, extra = [], TRUNCATED * truncated
        for source in self.alive:
            at, edits, cost = source, "", 0
            for _ in range(3):
                if not must_go:
                    if (to := KEEP.get(role[:1], {}).get(at)) is not None:
                        options.append((source, f"{edits}K", to, cost + extra))
                    options.append((source, f"{edits}R", NEXT[at], cost + REROLE + extra))
                options.append((source, f"{edits}D", at, cost + DELETE))
                at, edits, cost = NEXT[at], f"{edits}I", cost + INSERT
        self.step(options)
        self.settle()

    def close(self) -> int:
        """Choose the end, with inserted turns where they are needed, and emit all that waits. The cost."""
        options = []
        for source in self.alive:
            at, edits = source, ""
            for k in range(3):
                if at in (NONE, ASSISTANT):
                    options.append((source, edits, ASSISTANT, k * INSERT))
                at, edits = NEXT[at], f"{edits}I"
        self.step(options)
        self.settle()
        return self.alive[ASSISTANT][0]


class Conversation:
    """What is told of one conversation, row by row in its order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.least = self.most = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: bytes | None = None
        self.state, self.lines = NONE, 0
        self.audit: list[str] = []
        self.digest = hashlib.sha256()
        self.search = Search(self.edit)

    def line(self, role: bytes, text: bytes) -> None:
        self.digest.update((b"\n" if self.lines else b"") + role + b":" + text)
        self.lines += 1

    def edit(self, edits: str, row: tuple[bytes, bytes] | None) -> None:
        self.audit.append(edits)
        for e in edits:
            if e == "D":
                continue
            if e == "K":
                role, text = row
                self.state = KEEP[role[:1]][self.state]
            else:
                self.state = NEXT[self.state]
                role, text = b"user" if self.state == USER else b"assistant", row[1] if e == "R" else b""
            self.line(role, text)

    def add(self, turn: int | None, role: bytes, text: bytes, seen: bool) -> None:
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.last or not self.turns
            self.most = self.last = turn
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        said = text.rstrip()
        blank, duplicate = not said, bool(said) and seen
        truncated = not blank and not duplicate and said[-1:] not in (b".", b"!", b"?")
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.search.add(role, text, blank or duplicate, truncated)

    def told(self) -> tuple:
        cost = self.search.close()
        gaps = min(self.most - self.least + 1 - self.turns, (1 << 63) - 1) if self.turns else 0
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.digest.hexdigest())


def damage(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows as damaged by the CRC of their id and turn. Nulls are one space there, and as role and text."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", shown(id_col), shown(turn_col)).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = conversations.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), shown(role_col).alias("role"), shown(text_col).alias("text"), kind.alias("_kind")
    )
    times = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_kind") == 0).alias("gone"), times.alias("_copy")).drop("_copy")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
NAMES = ["conv_id", *COUNTS, "audit", "repaired_sha256"]


def repair(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, gone): its faults, and its cheapest repair.

    Rows of a conversation are in the order of turn (null first), then role and text. A first fault is
    blank, then duplicate (role and text were seen before), then truncated. ``audit`` has the
    initials of the cheapest edits after which role initials are ``(s?(ua)+)?``: Insert, Keep, Rerole,
    Delete, of equally cheap ones the least as ASCII. Rows that are ``gone`` only name their
    conversation; one without other rows has zeros, an empty audit and the empty text's digest. Other
    roles than those with initials s, u and a cannot be kept. A null id is a conversation. Gaps
    beyond a long are its end. An empty table gives no rows; other columns are not read.

    Conversations are dealt by id with one shuffle; partitions are sorted by Spark, which spills, and
    streamed through the search. The digest chains a conversation's whole texts, so they pass through
    one task, however many they are; that task holds the rows whose edits are still open, not the
    conversation. What is open stays short unless ties or parity keep two ends possible.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    first = Window.partitionBy("conv_id", "gone", "role", "text").orderBy("turn")
    sorted_rows = (
        rows.select("conv_id", "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), "gone")
        .repartition("conv_id")
        .withColumn("seen", F.row_number().over(first) > 1)
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, shape = None, [], None

        def batch() -> pa.RecordBatch:
            kinds = [shape, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=NAMES)

        for whole in batches:
            shape = whole.schema.field("conv_id").type
            for at in range(0, whole.num_rows, SLICE):
                part = whole.slice(at, SLICE)
                for conv, turn, role, text, gone, seen in zip(*(part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "seen")), strict=True):
                    if now is None or now.conv_id != conv:
                        if now is not None:
                            out.append(now.told())
                        now = Conversation(conv)
                    if not gone:
                        now.add(turn, role, text, seen)
                if len(out) >= SLICE:
                    yield batch()
                    out = []
        if now is not None:
            out.append(now.told())
            yield batch()

    schema = f"conv_id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, repaired_sha256 string"
    return sorted_rows.mapInArrow(run, schema).withColumnRenamed("conv_id", id_col)


def audit(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Damage ``conversations`` and repair them: one row per id; see :func:`damage` and :func:`repair`."""
    return repair(damage(conversations, id_col, turn_col, role_col, text_col), id_col)
