"""Toxicity: a weighted finite-state grammar of insults and threats, whose clauses, not single words, are scored."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, short_batches, store

# Words of English, German, French and Spanish that the grammar knows by itself.
TARGETS = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre vos tú ti usted ustedes vosotros".split())
NEGATIONS = frozenset("not never no isn't aren't don't doesn't nobody nicht nie kein keine keinen pas jamais ne aucun nunca jamás".split())
SPEECH = frozenset("said says say called calls wrote quote quoted claimed sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split())
MODALS = frozenset("will gonna shall should must i'll we'll werde werden wird sollte vais va allons doit voy vamos debe".split())
HARMS = frozenset("kill hurt destroy murder stab shoot beat burn hang töten umbringen schlagen verletzen tuer frapper détruire brûler matar golpear destruir quemar".split())
INSULTS = frozenset("idiot moron stupid scum loser worthless pathetic trash dumm idiotin trottel abschaum crétin imbécile ordure idiota estúpido imbécil basura".split())

TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[.!?;\n\"“”„«»]")
QUOTES = frozenset("\"“”„«»")
#: Letters from a word's start that may make a pattern.
STEMS = (3, 4, 5, 6)
#: How many words a negation, a threat's modal and a target reach.
REACH = 3
#: Log-odds from which a pattern is an insult of level 1, 2 and 3.
LEVELS = (2.0, 4.0, 6.0)
#: Toxic texts that a learned pattern must be found in, and patterns that are kept at most.
SUPPORT, PATTERNS = 3, 4096
#: Pattern counts that a task holds before it hands them on.
HELD_COUNTS = 200_000
#: Symbols of the lexical transducer; insults have a symbol a level.
INPUT = ["other", "target", "negation", "speech", "modal", "harm", "insult1", "insult2", "insult3"]
BREAK = len(INPUT)
#: What a clause can hold in the end, with its weight in the clause's score.
OUTCOMES = {
    "aimed1": 1.5, "aimed2": 3.0, "aimed3": 4.5, "insult1": 1.0, "insult2": 2.0, "insult3": 3.0, "told1": 0.5, "told2": 1.0, "told3": 1.5,
    "denied1": 0.25, "denied2": 0.5, "denied3": 0.75, "threat": 3.0, "aim": 1.0,
}
FEATURES = [*OUTCOMES, "strongest", "total"]


@dataclass(frozen=True)
class Transducer:
    """Deterministic and weighted: ``arcs`` (state, symbol) -> (state, symbol out, weight); what has no arc passes as it is."""

    start: object
    arcs: dict

    def go(self, state, symbol: str) -> tuple:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))


def compose(first: Transducer, second: Transducer, alphabet: list[str]) -> Transducer:
    """The transducer that reads as ``first`` does and writes what ``second`` makes of it; weights add up."""
    start = (first.start, second.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in alphabet:
            a, between, w = first.go(state[0], symbol)
            b, out, v = second.go(state[1], between)
            arcs[state, symbol] = ((a, b), out, w + v)
            if (a, b) not in seen:
                seen.add((a, b))
                todo.append((a, b))
    return Transducer(start, arcs)


def within(opens: str, rewrites: dict[str, str], alphabet: list[str], reach: int = REACH) -> Transducer:
    """After ``opens``, and for ``reach`` more words, symbols are rewritten."""
    arcs = {}
    for left in range(reach + 1):
        for s in alphabet:
            arcs[left, s] = (max(0, left - 1), rewrites.get(s, s) if left else s, 0.0)
        arcs[left, opens] = (reach, opens, 0.0)
    return Transducer(0, arcs)


def levels(kind: str) -> list[str]:
    return [f"{kind}{k}" for k in range(1, len(LEVELS) + 1)]


def grammar() -> Transducer:
    """Negation, reported speech, threat and target, composed in this order, and the weights of what comes out."""
    all_kinds = [*INPUT, *levels("denied"), *levels("told"), *levels("aimed"), "threat", "aim"]
    denied = dict(zip(levels("insult"), levels("denied"), strict=True)) | {"harm": "other"}
    negation = within("negation", denied, all_kinds)
    told = dict(zip(levels("insult"), levels("told"), strict=True)) | {"harm": "other"}
    reported = Transducer(0, {(1, s): (1, told.get(s, s), 0.0) for s in all_kinds} | {(0, "speech"): (1, "speech", 0.0)})
    threat = within("modal", {"harm": "threat"}, all_kinds)
    aimed = dict(zip(levels("insult"), levels("aimed"), strict=True))
    before = within("target", aimed, all_kinds)
    # A target just after an insult or a threat; the states count the words that are left for it.
    after = Transducer(0, {})
    for left in range(REACH + 1):
        for s in all_kinds:
            opens = s in ("threat", *levels("insult"))
            after.arcs[left, s] = (REACH, s, 0.0) if opens else (0, "aim", 0.0) if s == "target" and left else (max(0, left - 1), s, 0.0)
    weights = Transducer(0, {(0, s): (0, s, w) for s, w in OUTCOMES.items()})
    whole = negation
    for part in (reported, threat, before, after, weights):
        whole = compose(whole, part, INPUT)
    return whole


class Machine:
    """The composed grammar as tables, read clause by clause."""

    def __init__(self, whole: Transducer):
        numbers = {whole.start: 0}
        for (state, _), _ in whole.arcs.items():
            numbers.setdefault(state, len(numbers))
        places = {s: k for k, s in enumerate(OUTCOMES)}
        self.table = [[(0, -1, 0.0)] * len(INPUT) for _ in numbers]
        for (state, symbol), (to, out, weight) in whole.arcs.items():
            self.table[numbers[state]][INPUT.index(symbol)] = (numbers[to], places.get(out, -1), weight)

    def clause(self, symbols: bytes) -> tuple[set[int], float]:
        """The outcomes of a clause, and its score."""
        state, found, score = 0, set(), 0.0
        for s in symbols:
            state, out, weight = self.table[state][s]
            if out >= 0:
                found.add(out)
                score += weight
        return found, score

    def features(self, symbols: bytes) -> list[float]:
        """Of a text: the logarithm of the clauses with each outcome, the strongest clause's score, and that of all scores."""
        counts, strongest, total = [0] * len(OUTCOMES), 0.0, 0.0
        for clause in symbols.split(bytes([BREAK])):
            if clause and max(clause) >= INPUT.index("harm"):
                found, score = self.clause(clause)
                for k in found:
                    counts[k] += 1
                strongest, total = max(strongest, score), total + score
        return [*map(math.log1p, counts), strongest, math.log1p(total)]


class Lexicon(dict):
    """The lexical transducer: a token's symbol, by whole word, else by the longest known stem."""

    def __init__(self, patterns: dict[str, int]):
        self.patterns = patterns

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[token] = symbol = self.symbol(token)
        return symbol

    def symbol(self, token: str) -> int:
        if not token[0].isalnum():
            return INPUT.index("speech") if token in QUOTES else BREAK
        for kind, words in (("target", TARGETS), ("negation", NEGATIONS), ("speech", SPEECH), ("modal", MODALS), ("harm", HARMS)):
            if token in words:
                return INPUT.index(kind)
        for unit in units(token):
            if unit in self.patterns:
                return INPUT.index(f"insult{self.patterns[unit]}") if self.patterns[unit] else 0
        return INPUT.index("insult2") if token in INSULTS else 0

    def read(self, text: str) -> bytes:
        return bytes(map(self.__getitem__, TOKEN.findall(text.lower())))


def units(word: str) -> list[str]:
    """The patterns that may fit a word: itself, then its stems, longest first."""
    return [f"={word}", *(f"^{word[:k]}" for k in sorted(STEMS, reverse=True) if k < len(word))]


def log_odds(toxic: float, clean: float, n_toxic: float, n_clean: float) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


def level(odds: float) -> int:
    return sum(odds >= x for x in LEVELS)


def unit_counts(sample: DataFrame) -> DataFrame:
    """(unit, toxic, clean): in how many texts of either label a pattern is found. Added up in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array([v[1] for v in held.values()], pa.int64()), pa.array([v[0] for v in held.values()], pa.int64())], names=["unit", "toxic", "clean"]
            )

        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                words = {w for w in TOKEN.findall((text.as_py() or "").lower()) if w[0].isalnum()}
                for unit in {u for w in words for u in units(w)}:
                    held.setdefault(unit, [0, 0])[label] += 1
                if len(held) >= HELD_COUNTS:
                    yield told()
                    held.clear()
        if held:
            yield told()

    return short_batches(sample).mapInArrow(run, "unit string, toxic bigint, clean bigint").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression, the intercept last, by Newton's steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    keep = np.r_[np.full(x.shape[1] - 1, ridge * max(1.0, len(x) ** 0.5)), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(sample: DataFrame) -> dict:
    """Patterns and weights from ``sample`` (text, label 0 or 1), which the caller bounds.

    Spark counts in how many texts of either label each word and stem is found; those far likelier
    in toxic ones become insults of a level. The weights of what clauses then hold are fitted to the
    sample, where a text reads with its own count taken out, so a pattern that only it has does not
    speak for itself. Without texts of both labels the model is the base rate.
    """
    sample = store(sample, "toxicity-sample")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        base = (n1 + 0.5) / (n1 + n0 + 1)
        return {"patterns": {}, "weights": np.r_[np.zeros(len(FEATURES)), math.log(base / (1 - base))]}
    # A word or stem that clears the least level once one clean text is left out.
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.greatest(F.col("clean") - 1, F.lit(0)) + 0.5) / (n0 + 1))
    known = unit_counts(sample).where((F.col("toxic") >= SUPPORT) & (odds >= LEVELS[0]))
    rows = known.orderBy(F.desc(F.col("toxic") * odds), "unit").limit(PATTERNS).collect()
    patterns = {r["unit"]: level(log_odds(r["toxic"], r["clean"], n1, n0)) for r in rows}
    own = {
        1: {r["unit"]: level(log_odds(r["toxic"] - 1, r["clean"], n1 - 1, n0)) if r["toxic"] > SUPPORT else 0 for r in rows},
        0: {r["unit"]: level(log_odds(r["toxic"], max(0, r["clean"] - 1), n1, n0 - 1)) for r in rows},
    }

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, lexicons = Machine(grammar()), {k: Lexicon(p) for k, p in own.items()}
        for batch in batches:
            labels = batch.column("label").to_pylist()
            found = Counter(tuple([y, *machine.features(lexicons[y].read(t.as_py() or ""))]) for t, y in zip(batch.column("text"), labels, strict=True))
            columns = np.array(list(found), float).reshape(len(found), 1 + len(FEATURES)).T
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(list(found.values()), pa.int64())], names=["label", *FEATURES, "times"])

    schema = "label double, " + ", ".join(f"{f} double" for f in FEATURES) + ", times bigint"
    measured = short_batches(sample).mapInArrow(measure, schema).groupBy("label", *FEATURES).agg(F.sum("times").alias("times")).orderBy("label", *FEATURES).toPandas()
    values = measured.loc[measured.index.repeat(measured["times"])].drop(columns="times").to_numpy()
    return {"patterns": patterns, "weights": fit_weights(values[:, 1:], values[:, 0])}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, clauses, strongest) for every row: the probability of toxicity, the clauses that matched and the strongest one's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, lexicon = Machine(grammar()), Lexicon(model["patterns"])
        bare = [k for k, f in enumerate(OUTCOMES) if f != "aim"]
        for batch in batches:
            x = np.array([machine.features(lexicon.read(t.as_py() or "")) for t in batch.column("text")], float).reshape(batch.num_rows, len(FEATURES))
            total = x @ model["weights"][:-1] + model["weights"][-1]
            clauses = np.rint(np.expm1(x[:, bare]).sum(axis=1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(total, -700, 700)))), pa.array(clauses), pa.array(x[:, FEATURES.index("strongest")])],
                names=["doc_id", "score", "matches", "strongest"],
            )

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return short_batches(source).mapInArrow(run, "doc_id bigint, score double, matches bigint, strongest double").withColumnRenamed("doc_id", id_col)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, bound: int = 20_000) -> DataFrame:
    """Scores of all rows of ``docs`` under a grammar learned from ``labels``: id, held_out, score, predicted, matches, strongest.

    The score uses the text alone: its words are read as symbols, its clauses by the composed
    grammar. ``matches`` counts outcomes of clauses, ``strongest`` is the weight of the strongest. Patterns
    and weights are learned from at most about ``bound`` labelled rows outside the held-out quarter,
    drawn by a hash. Null and empty texts match nothing and get the score of a text without insults;
    texts are read whole, however long. Null ids are scored and not held out; repeated rows get equal
    scores. No labels of either kind: the base rate. An empty table gives no rows; other columns are
    not read.
    """
    usable = labels.where(~held_out(id_col))
    model = learn(labelled_sample(docs, usable, label_col, bound, "toxicity", id_col, text_col).dropDuplicates())
    told = score(docs, model, id_col, text_col)
    return told.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "matches", "strongest")
