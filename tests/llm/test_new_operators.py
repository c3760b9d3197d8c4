"""Merkle manifest, conversation repair and toxicity against plain versions, and on awkward rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import common, dialogue, merkle, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, hash int, idx int, block int, path int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def up(level):
    return [h(*level[i : i + 2]) for i in range(0, len(level), 2)]


def way(levels, place):
    out = []
    for level in levels[:-1]:
        beside = place ^ 1
        out.append((place & 1, level[beside] if beside < len(level) else None))
        place >>= 1
    return out


def plain_manifest(rows):
    """doc_id -> (leaf, subroot, root, proof, folded) of rows (doc_id, text, lang, source, n_chars), level by level."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    trees = {}
    for lang, members in groups.items():
        leaves = [(r, h(field(r[0]), field(r[3]), field(r[2]), field(r[4]), field(r[1]))) for r in members]
        leaves.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        levels = [[x[1] for x in leaves]]
        while len(levels[-1]) > 1:
            levels.append(up(levels[-1]))
        trees[lang] = (leaves, levels)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    tops = [[trees[x][1][-1][0] for x in order]]
    while len(tops[-1]) > 1:
        tops.append(up(tops[-1]))
    root, out = tops[-1][0], []
    for g, lang in enumerate(order):
        leaves, levels = trees[lang]
        for place, (r, leaf) in enumerate(leaves):
            steps = way(levels, place) + way(tops, g)
            now = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                now = h(field(r[0]), field(r[3]), field(r[2]), field(r[4] + 1), field(r[1]))
            for right, beside in steps:
                now = h(now) if beside is None else h(beside, now) if right else h(now, beside)
            out.append((r[0], leaf, levels[-1][0], root, h(*[b for _, b in steps if b is not None]), now, now == root))
    return sorted(out, key=str)


def told(df):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


@pytest.mark.parametrize(("n", "levels"), [(1, 2), (3, 1), (8, 2), (9, 8), (77, 2), (77, 8)])
def test_manifest_is_the_plain_one(spark, n, levels):
    rng = random.Random(n)
    rows = [(i * 3 - 20, rng.choice([None, "", "x é漢", "y" * 3000]), rng.choice(["en", "en", "en", None, "", "é", "zz"]), rng.choice([None, "a"]), rng.choice([None, i, (1 << 63) - 1])) for i in range(n)]
    docs = spark.createDataFrame([(*r, "t", 1, 2, 3, 4) for r in rows], DOCS).repartition(3)
    assert told(merkle.manifest(docs, levels=levels)) == plain_manifest(rows)


def test_manifest_of_repeated_and_null_rows(spark):
    rows = [(None, "a", "en", None, 1), (None, "b", "en", None, 1), (None, None, None, None, None)] + [(7, "same", "en", "s", 4)] * 40 + [(7, "other", "en", "s", 5)]
    docs = spark.createDataFrame([(*r, "t", 1, 2, 3, 4) for r in rows], DOCS)
    got = merkle.manifest(docs, levels=2)
    assert told(got) == plain_manifest(rows)
    assert sorted(r["place"] for r in got.where("doc_id = 7").collect()) == list(range(2, 43))
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_versions_share_all_but_their_path(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "string(id) as text", "'en' as lang", "'s' as source", "id as n_chars")
    got = merkle.manifest(docs, levels=3).toPandas()
    hit = got[got["copied_nodes"] > 0]
    assert set(hit["doc_id"]) == {i for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 0}
    assert set(hit["copied_nodes"]) == {10} and not hit["verified"].any()  # a leaf and nine ancestors
    assert hit["folded_root"].nunique() == len(hit)
    assert got[got["copied_nodes"] == 0]["verified"].all()


def test_block_never_holds_more_than_its_levels(spark):
    nodes = [bytes([k]) * 32 for k in range(8)]
    levels = merkle.levels_of(nodes, False, 3)
    assert [len(x) for x in levels] == [8, 4, 2, 1]
    assert [len(x) for x in merkle.levels_of(nodes[:1], False, 3)] == [1, 1, 1, 1]  # the last run of a longer level
    assert merkle.levels_of(nodes[:1], True, 3) == [nodes[:1]]  # a lone leaf is its tree
    for place in range(8):
        assert merkle.copied(nodes[place], merkle.path_of(levels, place))[-1] == levels[-1][0]


# Conversations

SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """All that is told of one conversation's damaged rows, by trying every state with whole audits."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        said = text.strip(SPACE)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    best = {"": (0, "", ())}  # role initials so far (reduced) -> cost, audit, lines

    def state(s):
        return "" if s == "" else "s" if s == "s" else "u" if s.endswith("u") else "a"

    def put(into, key, value):
        if key not in into or value < into[key]:
            into[key] = value

    def inserted(now):
        out = dict(now)
        for _ in range(3):
            for key, (cost, audit, lines) in list(out.items()):
                role = "assistant" if key == "u" else "user"
                put(out, role[0], (cost + 3, audit + "I", (*lines, f"{role}:")))
        return out

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for key, (cost, audit, lines) in inserted(best).items():
            put(after, key, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            follows = {"": "su", "s": "u", "u": "a", "a": "u"}[key]
            if role[:1] and role[:1] in follows:
                put(after, role[:1], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
            new = "assistant" if key == "u" else "user"
            put(after, new[0], (cost + 3 + more, audit + "R", (*lines, f"{new}:{text}")))
        best = after
    cost, audit, lines = min(v for k, v in inserted(best).items() if state(k) in ("", "a"))
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


TALK = "conv_id bigint, turn bigint, role string, text string, gone string, seen int, _kind int, _copy int"
TOLD = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], TALK).repartition(parts)
    return {r["conv_id"]: tuple(r[c] for c in TOLD) for r in dialogue.audit(df).collect()}


def test_repair_is_the_plain_one(spark):
    rng = random.Random(3)
    rows = []
    for conv in [None, *range(250)]:
        role = ["system", "user", "assistant"]
        for turn in range(rng.randint(1, 14)):
            who = role[turn % 2 + 1] if rng.random() < 0.6 else rng.choice([*role, "tool", None, "", "u"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn * 5]), who, rng.choice(["Yes.", "No", "so what?", " \t", None, "é!\n ", f"t{turn}."])))
    got = repaired(spark, rows)
    damaged = plain_damage(rows)
    assert got.keys() == {r[0] for r in rows}
    for conv, found in got.items():
        assert found == plain_repair([r for r in damaged if r[0] == conv]), conv


def test_conversation_of_dropped_rows_and_far_turns(spark):
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert repaired(spark, [(dropped, 0, "user", "Hi.")])[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    far = [(5, -(1 << 63), "user", "a."), (5, (1 << 63) - 1, "assistant", "b.")]
    kept = plain_damage(far)
    assert len(kept) == 2 and repaired(spark, far)[5][0] == (1 << 63) - 1
    assert dialogue.audit(spark.createDataFrame([], TALK)).count() == 0


def test_long_conversation_emits_as_it_goes():
    waited, talk = 0, dialogue.Conversation(1)
    rows = [(0, k, "assistant" if k % 2 else "user", f"line {k}." if k % 7 else f"line {k}") for k in range(3000)]
    for _, turn, role, text in rows:
        talk.add(turn, role.encode(), text.encode(), False)
        waited = max(waited, len(talk.search.waiting))
    assert talk.told()[1:] == plain_repair(rows)
    assert waited < 40
    hard = [(0, k, "user", f"{k}.") for k in range(400)]  # parity keeps two ends possible to the last row
    talk = dialogue.Conversation(1)
    for _, turn, role, text in hard:
        talk.add(turn, role.encode(), text.encode(), False)
    assert talk.told()[1:] == plain_repair(hard)


def test_survivors_count_their_references():
    root = dialogue.Node(None, "")
    a, b = dialogue.Node(root, "K"), dialogue.Node(root, "D")
    root.release()
    assert root.refs == 2
    b.release()
    assert root.refs == 1 and root.kids == [a]


# Toxicity


def corpus(n=600, seed=2):
    rng = random.Random(seed)
    syllables = ["ba", "ren", "to", "li", "mas", "ou", "chen", "dra", "vi", "el"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(["zurk", "zork" + word(), "you moron", "zorkel"])
        docs.append((i, " ".join(words) + "."))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def judged(spark):
    docs, labels = corpus()
    df = toxicity.judge(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    return {r["doc_id"]: r for r in df.collect()}, dict(labels)


def test_toxicity_holds_on_rows_it_has_not_seen(judged):
    found, labels = judged
    held = [r for r in found.values() if r["held_out"]]
    assert len(found) == 600 and {r["doc_id"] for r in held} == {i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2}
    hits = sum(r["predicted"] == labels[r["doc_id"]] for r in held)
    assert hits >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.values())


def symbols(*names):
    return bytes(toxicity.INPUT.index(n) for n in names)


@pytest.mark.parametrize(
    ("clause", "outcomes"),
    [
        (("target", "other", "insult3"), {"aimed3"}),
        (("insult3", "other"), {"insult3"}),
        (("insult3", "target"), {"insult3", "aim"}),
        (("negation", "other", "insult2"), {"denied2"}),
        (("negation", "other", "other", "other", "insult2"), {"insult2"}),
        (("speech", "other", "insult1"), {"told1"}),
        (("speech", "negation", "insult1"), {"denied1"}),
        (("modal", "harm", "target"), {"threat", "aim"}),
        (("harm", "target"), set()),
        (("negation", "modal", "harm"), set()),
        (("target", "other", "other", "other", "insult1"), {"insult1"}),
    ],
)
def test_grammar_reads_clauses(clause, outcomes):
    found, score = toxicity.Machine(toxicity.grammar()).clause(symbols(*clause))
    names = list(toxicity.OUTCOMES)
    assert {names[k] for k in found} == outcomes
    assert score == sum(toxicity.OUTCOMES[x] for x in outcomes)


def test_composition_is_one_after_the_other():
    rng = random.Random(1)
    kinds = toxicity.INPUT
    first = toxicity.within("negation", {"insult1": "other", "harm": "target"}, kinds)
    second = toxicity.within("target", {"insult2": "insult3"}, kinds)
    both = toxicity.compose(first, second, kinds)
    for _ in range(50):
        text = [rng.choice(kinds) for _ in range(12)]
        plain, a, b, c = [], first.start, second.start, both.start
        for s in text:
            a, mid, _ = first.go(a, s)
            b, out, _ = second.go(b, mid)
            c, got, _ = both.go(c, s)
            plain.append((out, got))
        assert all(x == y for x, y in plain)


def test_clauses_do_not_reach_over_their_end():
    machine, lexicon = toxicity.Machine(toxicity.grammar()), toxicity.Lexicon({"=oaf": 3})
    one = dict(zip(toxicity.FEATURES, machine.features(lexicon.read("You utter OAF! Not now.")), strict=True))
    assert one["aimed3"] == pytest.approx(np.log(2)) and one["insult3"] == 0 and one["denied3"] == 0
    two = dict(zip(toxicity.FEATURES, machine.features(lexicon.read("You there. Not so. oaf")), strict=True))
    assert two["aimed3"] == 0 and two["denied3"] == 0 and two["insult3"] == pytest.approx(np.log(2))


def test_patterns_are_counted_in_texts(spark):
    rows = [("abc abc. abcdef", 1), ("abcdef", 0), (None, 0), ("ABC", 1)]
    got = {r["unit"]: (r["toxic"], r["clean"]) for r in toxicity.unit_counts(spark.createDataFrame(rows, "text string, label int")).collect()}
    assert got == {"=abc": (2, 0), "=abcdef": (1, 1), "^abc": (1, 1), "^abcd": (1, 1), "^abcde": (1, 1)}


def test_toxicity_of_awkward_rows(spark):
    docs, labels = corpus(200)
    rows = [*docs, (None, None), (None, "zurk zurk"), (0, docs[0][1]), (0, "again"), (900, ""), (901, " \n"), (902, "ba " * 200_000), (903, "🙂 ___ \"“")]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id bigint, text string, label int, score double")
    marks = spark.createDataFrame([*labels, (0, 0), (None, 1), (3, None)], "doc_id bigint, toxic int")
    got = toxicity.judge(df, marks).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    empty = {r["score"] for r in got if r["doc_id"] in (900, 901, 902, 903)}
    assert len(empty) == 1 and empty.pop() < 0.3
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert toxicity.judge(df.limit(0), marks).count() == 0
    for none in (marks.limit(0), marks.where("toxic = 0")):
        assert len({r["score"] for r in toxicity.judge(df, none).collect()}) == 1


def test_sample_is_bounded_whatever_repeats(spark):
    docs = spark.range(40_000).selectExpr("id % 20 as doc_id", "concat('text ', id) as text")
    labels = spark.range(20).selectExpr("id as doc_id", "int(id % 2) as toxic")
    assert 500 < common.labelled_sample(docs, labels, "toxic", 1000, "x").count() <= 1100
    alike = spark.range(5000).selectExpr("1L as doc_id", "'same' as text")
    assert common.labelled_sample(alike, labels, "toxic", 1000, "x").count() <= 1


