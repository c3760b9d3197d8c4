"""The pipeline against a chain of plain versions of its stages."""

import random

import numpy as np

from corpus_pipeline import STAGES, run
from tests.llm.test_operators import ascii_lower, check_packing, exact_encode, plain_targets, simhash_components, words_of  # noqa: F401
from tidemark.llm import quality


def fixture_rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    good = [" ".join([word() for _ in range(rng.randint(30, 200))]) + "." for _ in range(120)]
    bad = [" ".join(rng.choice(["BUY!!", "NOW!!", "WIN!!"]) for _ in range(rng.randint(20, 60))) for _ in range(40)]
    near = [g.rsplit(" ", 1)[0] + " changed" for g in good[:10]]
    texts = good + bad + good[:8] + [g.upper() for g in good[8:12]] + near
    rng.shuffle(texts)
    return [(i, t, "en", f"s{rng.randint(0, 3)}", len(t)) for i, t in enumerate(texts)], {t: int(t not in bad) for t in texts}


def test_stages_match_plain_versions(spark, tmp_path, exact_encode):  # noqa: F811
    rows, good = fixture_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(r[0], good[r[1]], 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    after = []
    for name, stage in STAGES:
        path = str(tmp_path / f"after-{len(after)}")
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        after.append(docs.collect())
        if len(after) < len(STAGES):
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    judged, exact, near, mixed, packed = after

    source = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    scores = quality.classify(source, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()
    assert {r.doc_id for r in judged} == {r.doc_id for r in scores if r.predicted}
    assert np.mean([good[r.text] for r in judged]) > 0.97
    kept = {r.doc_id for r in judged}
    assert np.mean([i in kept for i, text, *_ in rows if good[text]]) > 0.97
    assert np.mean([i in kept for i, text, *_ in rows if not good[text]]) < 0.03

    last = {}
    for r in judged:
        last[ascii_lower(r.text)] = max(last.get(ascii_lower(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(last.values())

    _, components = simhash_components([(r.doc_id, r.text) for r in exact])
    assert sorted(r.doc_id for r in near) == sorted(set(components.values()))

    sizes = {}
    for r in near:
        sizes[r.source] = sizes.get(r.source, 0) + len(words_of(r.text))
    names = sorted(sizes)
    targets = plain_targets([sizes[s] for s in names])
    largest = max(len(words_of(r.text)) for r in near)
    for s, t in zip(names, targets, strict=True):
        assert abs(sum(len(words_of(r.text)) for r in mixed if r.source == s) - t) <= largest

    unique = {r.doc_id: r.text for r in mixed}
    assert len(packed) >= len(mixed)
    ids = {d: len(exact_encode(t)) + 1 for d, t in unique.items()}
    assert sum(r.length for r in packed) == sum(ids[r.doc_id] for r in mixed)
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)


#: Columns named like those that stages add for themselves.
EXTRA = "_row string, _key int, _n int, kept boolean, label int, hash int, size int, score double, length int, _times int"


def test_every_stage_takes_awkward_rows(spark, tmp_path):
    """Null ids, texts, sources and columns, empty and very long texts, repeated rows and ids, equal and unlike texts of one id."""
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    texts = [None, "", " \n", prose(60_000), "x" * 300_000, prose(50), prose(80), "漢字 🙂 <|endoftext|> " + prose(40)]
    base = [(i, t, None if k % 3 else "en", (None, "a", "b")[k % 3], None) for k, t in enumerate(texts) for i in (None, 7, 100 + k)]
    base += base[-6:] + [(7, prose(60), "en", "a", 5), (None, prose(70), "en", None, 5)]
    rows = [(*r, None, None, 1, None, 2, 3, 4, None, 5, 6) for r in base]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)
    labels = [(100 + k, int(t is not None and len(t) > 30), 0) for k, t in enumerate(texts)] + [(None, 1, 0), (7, None, None), (100, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in STAGES:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        if name != STAGES[-1][0]:
            assert out.columns == docs.columns, name
            assert set(map(str, got)) <= set(map(str, docs.collect())), name
        if name == "exact dedup":
            assert sorted(str(r.text) for r in got if r.text and r.text.strip()) == sorted({r[1] for r in rows if r[1] and r[1].strip()})
        elif name == "SimHash near-dedup":
            assert {r.text for r in got if r.text and len(r.text) > 9} == {r[1] for r in rows if r[1] and len(r[1]) > 9}
        elif name == "mixing sources to target weights":
            assert {r.source for r in got} == {None, "a", "b"}
        elif name == "best-fit packing":
            assert {(r.doc_id, r.piece) for r in got} >= {(r[0], 0) for r in rows} and len({(r.sequence_id, r.offset) for r in got}) == len(got)
        none = stage(spark, docs.where("false"), str(tmp_path))
        assert none.count() == 0 and (none.columns == docs.columns or name == STAGES[-1][0]), name


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert run(spark, str(tmp_path)).count() == 0
