"""Each operator against a brute-force version, and on awkward rows."""

import hashlib
import random
import re
import tempfile
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common, exact_dedup, lm_scoring, mixing, near_dedup, packing, quality, queries, sharding, substring_dedup, topk_search, url_filter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Columns that are named like those the operators add for themselves.
EXTRA = ["size", "hash", "fp", "_key", "_row", "_n", "score", "shard", "piece", "label", "batch"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
    + [T.StructField(c, T.IntegerType()) for c in EXTRA]
)


def corpus(seed=5, n=160):
    """Copies, near copies, shared passages, a hot group, nulls, empty, blank and long texts, odd characters."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, hot = prose(45), prose(60)
    texts = [None, "", " \t\n", "one", "Two words", "Ünïcode\u00a0space\u2003wide 漢字 🙂 <|endoftext|>", "a " * 70, prose(9000)]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.3:
            texts.append(hot if rng.random() < 0.8 else hot.upper())
        elif kind < 0.4 and len(texts) > 10:
            base = (rng.choice(texts) or "").split(" ")
            base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))
        elif kind < 0.6:
            texts.append(f"{prose(rng.randint(0, 30))} {passage}\n{prose(rng.randint(0, 30))}")
        else:
            texts.append(prose(rng.randint(1, 300)))
    return [(i, t, "en", rng.choice(["b", "a", None, "é", "B", "a"])) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *range(len(EXTRA))) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column and repeated rows."""
    base = [(None, None, None, None), (None, "x y", None, "a"), (3, None, None, "a"), (4, "x y", "en", None), (4, "x y", "en", None), (4, "x y", "en", None)]
    return spark.createDataFrame([(*r, *[None] * len(EXTRA)) for r in base], SCHEMA)


def words_of(text):
    return WORD.findall((text or "").encode())


# 1 quality classifier


def labelled(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["the", "of", "river", "stone", "and", "light"]) for _ in range(rng.randint(20, 60))) + "." for _ in range(150)]
    bad = [" ".join(rng.choice(["BUY!!", "NOW!!", "WIN!!"]) for _ in range(rng.randint(20, 60))) for _ in range(60)]
    texts = [(i, t, int(t in good)) for i, t in enumerate(rng.sample(good + bad, 210))]
    return spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string"), spark.createDataFrame([(i, q) for i, _, q in texts], "doc_id long, quality int")


def test_quality_learns_and_scores_held_out_rows(spark):
    docs, labels = labelled(spark)
    out = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    for r in out.itertuples():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = out[out.held_out]
    assert len(held) > 30 and (held.predicted == held.quality).mean() > 0.95
    again = quality.classify(docs.repartition(5), labels).toPandas().set_index("doc_id").score
    assert np.allclose(out.set_index("doc_id").score.sort_index(), again.sort_index())


def test_quality_does_not_learn_from_held_out_labels(spark):
    docs, labels = labelled(spark)
    wrong = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.classify(docs, x).orderBy("doc_id").toPandas().score for x in (labels, wrong))
    assert np.allclose(a, b)


def test_quality_on_awkward_rows(spark, docs, odd, none):
    _, labels = labelled(spark)
    assert quality.classify(odd, labels).count() == 6
    assert quality.classify(none, labels).count() == 0
    assert quality.classify(docs, labels.where("false")).where("score between 0 and 1").count() == docs.count()
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert quality.keep_good(odd, labels).count() <= 6 and quality.keep_good(none, labels).count() == 0


def test_features_match_plain_counts():
    rng = random.Random(2)
    texts = ["The cat sat. The end!\nBUY | NOW 42%\n\nthe cat sat.", "x", "é é\tÀb  c;", "".join(rng.choice("ab C9.!|\né") for _ in range(500))]
    for text in texts:
        data, words = text.encode(), words_of(text)
        got = dict(zip(quality.FEATURES, quality.features(data), strict=True))
        lower, lines = [w.lower() for w in words], [x for x in data.split(b"\n") if x.strip()]
        share = lambda test: sum(map(test, data)) / len(data)
        want = {
            "log_words": np.log(1 + len(words)), "word_length": sum(map(len, words)) / len(words), "upper": share(lambda c: 65 <= c <= 90), "digits": share(lambda c: 48 <= c <= 57),
            "non_ascii": share(lambda c: c > 127), "shouts": data.count(b"!") / len(data), "pipes": data.count(b"|") / len(data), "distinct_words": len(set(lower)) / len(words),
            "top_word": max(map(lower.count, lower)) / len(words), "log_lines": np.log(1 + len(lines)), "distinct_lines": len(set(lines)) / len(lines),
            "byte_entropy": -sum(data.count(c) / len(data) * np.log2(data.count(c) / len(data)) for c in set(data)),
            "distinct_pairs": len(set(zip(lower, lower[1:]))) / max(1, len(words) - 1), "function_words": sum(w in quality.FUNCTION_WORDS for w in lower) / len(words),
        }
        assert {k: got[k] for k in want} == pytest.approx(want)
    assert set(quality.features(b" \n")) == {0.0}


def test_trees_match_an_exhaustive_search():
    rng = np.random.default_rng(4)
    for _ in range(30):
        g, h = rng.normal(size=7), rng.random(7) + 0.1
        gain = lambda *parts: sum(g[p].sum() ** 2 / (h[p].sum() + 2.0) for p in parts)
        cuts = {k: gain(slice(0, k), slice(k, 7)) for k in range(1, 7)}
        k = max(cuts, key=cuts.get)
        parts = [slice(0, k), slice(k, 7)] if cuts[k] > gain(slice(0, 7)) + 1e-12 else [slice(0, 7)]
        assert quality.leaves(g, h, 1, 2.0) == pytest.approx(np.concatenate([np.full(len(g[p]), g[p].sum() / (h[p].sum() + 2.0)) for p in parts]))
        a, b = rng.normal(size=(4, 5)), rng.random((4, 5)) + 0.1
        cells = lambda i, j: [(slice(None, i), slice(None, j)), (slice(None, i), slice(j, None)), (slice(i, None), slice(None, j)), (slice(i, None), slice(j, None))]
        best = max(((i, j) for i in range(1, 4) for j in range(1, 5)), key=lambda c: sum(a[x].sum() ** 2 / (b[x].sum() + 2.0) for x in cells(*c)))
        step = np.empty((4, 5))
        for x in cells(*best):
            step[x] = a[x].sum() / (b[x].sum() + 2.0)
        assert quality.quadrants(a, b, 2.0) == pytest.approx(step)


def test_lookup_tables_add_up():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 8, (4000, 2))
    y = ((x[:, 0] > 3) ^ (x[:, 1] > 3)).astype(float)  # an interaction and nothing else
    base, single, double = quality.fit_tables(x, y, [8, 8], 1, 80)
    score = base + single[0][x[:, 0]] + single[1][x[:, 1]] + double[(1, 0)][x[:, 1] * 8 + x[:, 0]]
    assert ((score > 0) == y).mean() > 0.98


# 2 substring dedup


def kept_by_brute_force(rows, window):
    seen, out = set(), {}
    for doc_id, text, *_ in sorted(rows):
        words = words_of(text)
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            if w in seen:
                gone[k : k + window] = [True] * window
            seen.add(w)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("batches,hot", [(1, 512), (3, 2)])
def test_substring_dedup_matches_brute_force(docs, rows, batches, hot):
    out = substring_dedup.remove_repeats(docs, batches=batches, hot=hot, with_text=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == kept_by_brute_force(rows, 20)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in out)


def test_substring_dedup_of_periodic_texts(spark):
    texts = ["a b " * 40, "b a " * 40, "a " * 19, "a " * 20, "a " * 21, "x " * 25 + "y " + "x " * 25]
    rows = list(enumerate(texts))
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == kept_by_brute_force(rows, 20)


def test_substring_dedup_on_awkward_rows(odd, none):
    assert sorted(r.n_words for r in substring_dedup.remove_repeats(odd).collect()) == [0, 0, 2, 2, 2, 2]
    assert substring_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("batches,hot,parts", [(2, 2, 3)])
def test_substring_dedup_tells_texts_of_one_id_apart(spark, batches, hot, parts):
    prose = lambda seed, n: " ".join(str(random.Random(seed * 1000 + k).random()) for k in range(n))
    texts = ["a " * 70, None, "", "short one", prose(1, 50), prose(1, 25) + " " + prose(2, 30), prose(2, 40), "b " * 30]
    rows = [(None, t) for t in texts] + [(7, t) for t in texts] + [(7, texts[4]), (None, texts[0]), (8, prose(3, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("doc_id", F.lit(-(1 << 63))), F.coalesce("text", F.lit("")).cast("binary")).alias("h")).collect()
    order = sorted({(r.doc_id is not None, r.doc_id or 0, r.h): r.text for r in hashed}.items())
    want = kept_by_brute_force([(k, text) for k, (_, text) in enumerate(order)], 20)
    place = {key: k for k, (key, _) in enumerate(order)}
    out = substring_dedup.remove_repeats(docs.repartition(parts), batches=batches, hot=hot).collect()
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in out)
    assert got == sorted((r.doc_id is not None, r.doc_id or 0, *want[place[r.doc_id is not None, r.doc_id or 0, r.h]]) for r in hashed)


def test_substring_dedup_compares_words_not_hashes(spark):
    # These two words have one polynomial hash modulo a power of two, for every odd base.
    thue = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    morse = thue.translate(str.maketrans("ab", "ba"))
    lead = " ".join(f"w{k}" for k in range(19))
    rows = [(1, f"{lead} {thue}"), (2, f"{lead} {morse}"), (3, f"{lead} {thue}")]
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in out} == {1: 0, 2: 0, 3: 20}


@pytest.mark.parametrize("fanout", [2])
def test_index_stays_for_later_runs(spark, tmp_path, rows, fanout):
    """Batches in separate runs, each opening the index anew, give what one run over all gives."""
    folder, got = f"file://{tmp_path}/index", {}
    for k in range(4):
        part = [r for r in rows if r[0] * 4 // len(rows) == k]
        docs = spark.createDataFrame([r[:2] for r in part], "doc_id long, text string").repartition(2)
        index = substring_dedup.SubstringIndex(spark, folder, fanout=fanout, hot=8)
        assert index.seq == k
        got |= {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in index.remove_repeats(docs).collect()}
        assert len(index._of("run")) == (1 if fanout == 2 or k == 3 else k + 1)
        for table in index.held:  # as in a session that does not know the tables
            spark.sql(f"drop table if exists {table[1]}")
    assert got == kept_by_brute_force(rows, 20)


def test_failed_batch_leaves_the_index_as_it_was(spark, tmp_path):
    index = substring_dedup.SubstringIndex(spark, f"file://{tmp_path}/index")
    prose = " ".join(map(str, range(40)))
    index.remove_repeats(spark.createDataFrame([(1, prose)], "doc_id long, text string")).collect()
    broken = spark.createDataFrame([(2, prose)], "doc_id long, text string").withColumn("text", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        index.remove_repeats(broken)
    again = substring_dedup.SubstringIndex(spark, f"file://{tmp_path}/index")
    assert again.seq == 1
    assert [r.n_removed for r in again.remove_repeats(spark.createDataFrame([(2, prose)], "doc_id long, text string")).collect()] == [40]


def test_substring_index_hashes_each_text_once(spark, tmp_path, monkeypatch):
    """Neither later batches nor the comparison of words hash a text again, whatever they share with it."""
    log = tmp_path / "hashed"
    log.mkdir()

    class Counting(substring_dedup.Hasher):
        def words(self, data, start, end):
            with tempfile.NamedTemporaryFile("w", dir=log, delete=False) as f:
                f.write(str(len(start)))
            return super().words(data, start, end)

    monkeypatch.setattr(substring_dedup, "Hasher", Counting)
    passage = " ".join(f"w{k}" for k in range(50))
    rows = [(k, f"{passage[: 40 + 20 * k]} {k}  own\n{passage}\t") for k in range(9)]
    index, got = substring_dedup.SubstringIndex(spark, f"file://{tmp_path}/index"), {}
    for k in range(3):
        docs = spark.createDataFrame(rows[3 * k : 3 * k + 3], "doc_id long, text string")
        got |= {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in index.remove_repeats(docs).collect()}
    assert got == kept_by_brute_force(rows, 20)
    assert sum(int(f.read_text()) for f in log.iterdir()) == sum(len(text.split()) for _, text in rows)


def test_runs_of_windows_that_select_one_place():
    rng, hasher = random.Random(5), substring_dedup.Hasher()
    for _ in range(60):
        texts = [b"".join(rng.choice([b"a", b"b ", b" ", b"\n", b"cd ", b"\t\x0b"]) for _ in range(rng.choice([0, 1, 3, 60, 200]))) for _ in range(rng.randint(1, 6))]
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        plain, places, start, end, owner, _ = substring_dedup.single_spaced(data, offsets)
        assert [bytes(plain[a:b]) for a, b in zip(places, places[1:])] == [b" ".join(t.split()) for t in texts]
        words = hasher.words(plain, start, end)
        inner, want, last = hasher.runs(words, 8), [], None
        for i in range(len(words) - 19):
            if owner[i] == owner[i + 19]:
                place = min(range(i, i + 13), key=lambda k: (inner[k], k))
                if last == (owner[i], place):
                    want[-1][2] += 1
                else:
                    want.append([inner[place], i, 1])
                last = owner[i], place
        assert want == [list(x) for x in zip(*substring_dedup.selections(words, owner, hasher, 20, 8))]


def test_index_of_an_older_layout_is_refused(spark, tmp_path):
    index = substring_dedup.SubstringIndex(spark, f"file://{tmp_path}/index")
    index._commit([("texts", "texts_old", f"file://{tmp_path}/index/texts_old", "doc_id bigint, key bigint, no_id boolean, text binary", "key", 2, 0)], 1)
    with pytest.raises(ValueError, match="anew"):
        substring_dedup.SubstringIndex(spark, f"file://{tmp_path}/index")


# 3 exact dedup


def ascii_lower(text):
    return (text or "").encode().lower()


def test_exact_dedup_matches_brute_force(docs, rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(ascii_lower(text), []).append(doc_id)
    want = {d: (max(g), len(g), d == max(g), hashlib.sha256(t).hexdigest()) for t, g in groups.items() for d in g}
    out = exact_dedup.exact_groups(docs, rows_per_block=8).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out} == want
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())


def test_exact_dedup_on_awkward_rows(odd, none):
    assert exact_dedup.exact_groups(none).count() == 0
    out = exact_dedup.exact_groups(odd).collect()
    assert sorted((r.keep_id, r.group_size) for r in out) == [(3, 2)] * 2 + [(4, 4)] * 4
    assert sorted(r.doc_id for r in exact_dedup.drop_exact(odd).collect()) == [3, 4]


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(2)
    build, unpack = exact_dedup.CountingQuotientFilter.build, exact_dedup.CountingQuotientFilter.unpack
    for bits, kinds, n in ((3, 50, 400), (0, 3, 9), (20, 10**6, 5000), (1, 10**9, 200_000)):
        prints = rng.integers(0, kinds, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        blocks = prints >> np.uint64(64 - bits) if bits else np.zeros(n, np.uint64)
        for block in np.unique(blocks)[:8].tolist():
            mine = prints[blocks == block]
            parts = [unpack(bits, *build(block, bits, p).pack()) for p in np.array_split(mine, 3)]
            got, counts = unpack(bits, *exact_dedup.CountingQuotientFilter.merge(parts).pack()).entries()
            want, want_counts = np.unique(mine, return_counts=True)
            assert (got == want).all() and (counts == want_counts).all()
    # About eleven bits fewer than a word of the fingerprint for 200,000 entries, with all the rest.
    whole = build(0, 0, rng.integers(0, 1 << 63, 200_000).astype(np.uint64) * np.uint64(2))
    assert sum(map(len, whole.pack()[2:])) < 200_000 * 51 / 8


def test_merging_reads_each_filter_once(monkeypatch):
    rng = np.random.default_rng(3)
    filters = exact_dedup.CountingQuotientFilter
    parts = [filters.build(0, 0, rng.integers(0, 10**6, 50).astype(np.uint64) << np.uint64(40)) for _ in range(1000)]
    read, entries = [], filters.entries
    monkeypatch.setattr(filters, "entries", lambda self: (read.append(self.size), entries(self))[1])
    whole = filters.merge(parts)
    assert len(read) == 1000 and entries(whole)[1].sum() == 50_000


# 4 packing


@pytest.fixture(scope="module")
def exact_encode():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def check_packing(out, rows, encode, capacity):
    ids = {d: np.array([*encode(t or ""), 2], "<u4") for d, t, *_ in rows}
    by_sequence, by_doc = {}, {}
    for r in out:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    for d, pieces in by_doc.items():
        pieces.sort()
        assert [p[0] for p in pieces] == list(range(len(pieces))) and sum(p[2] for p in pieces) == len(ids[d])
        assert all(p[2] == capacity for p in pieces[1:])
    assert set(by_doc) == set(ids)
    lengths = {}
    for r in out:
        lengths[r.length] = lengths.get(r.length, 0) + 1
    return len(by_sequence), packing.fewest(lengths, capacity)


def test_packing_round_trip(docs, rows, exact_encode):
    out = packing.pack(docs, queries.tokenizer_paths(), 256).collect()
    used, least = check_packing(out, rows, exact_encode, 256)
    assert used <= least + 2


def test_packing_on_awkward_rows(odd, none):
    out = packing.pack(odd, queries.tokenizer_paths(), 16).collect()
    assert len(out) == 6 and len({(r.sequence_id, r.offset) for r in out}) == 6
    assert packing.pack(none, queries.tokenizer_paths()).count() == 0


def test_fast_encoder_gives_the_same_ids(exact_encode, rows):
    rng = random.Random(3)
    encode = packing.Encoder(**queries.tokenizer_paths())
    alphabet = "ab Z09'\t\n\r .,!?-_$€«»éßñÀžΩя—“”" + "\x0b\x0c\x1c\x85\u00a0\u2003\u200b漢🙂ʰ\u0301٣Ⅷ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [t or "" for _, t, *_ in rows]
    for part in (alphabet[:40], alphabet):
        texts += ["".join(rng.choice(part) for _ in range(12)) for _ in range(1000)]
    texts += ["hello <|endoftext|> x", "<|endoftext|>", "<|endoftext|", "a<|endoftext|>b<|endoftext|>"]
    assert all(encode(t) == exact_encode(t) for t in texts)
    assert encode("hello <|endoftext|> x") == [31373, 220, 50256, 2124]


def test_bins_are_whole_and_few():
    rng = random.Random(4)
    for _ in range(20):
        counts = {rng.randint(1, 100): rng.randint(1, 30) for _ in range(40)}
        plan = packing.pack_histogram(counts, 100)
        got = {}
        for times, used in plan:
            assert sum(n * m for n, m in used.items()) <= 100
            for n, m in used.items():
                got[n] = got.get(n, 0) + times * m
        assert got == counts
        assert sum(t for t, _ in plan) <= sum(t for t, _ in packing.best_fit(counts, 100))


def test_search_finds_and_proves_the_fewest_bins():
    counts = {408: 1, 378: 2, 348: 1, 338: 2, 318: 1, 298: 1, 268: 1}
    assert sum(t for t, _ in packing.pack_histogram(counts, 1024)) == 3  # every greedy pass needs 4

    def fewest(items, capacity, rooms=()):
        if not items:
            return len(rooms)
        placed = [fewest(items[1:], capacity, (*rooms[:k], r - items[0], *rooms[k + 1 :])) for k, r in enumerate(rooms) if r >= items[0] and r not in rooms[:k]]
        return min([*placed, fewest(items[1:], capacity, (*rooms, capacity - items[0]))])

    rng = random.Random(13)
    assert sum(t for t, _ in packing.pack_histogram({n: 1 for n in (4, 6, 9, 11, 12, 13, 14, 20)}, 30)) == 3
    for k in range(500):
        low, high = ((6, 32), (3, 20), (12, 26), (1, 50))[k % 4]
        items = sorted((rng.randint(low, high) for _ in range(8)), reverse=True)
        counts = {n: items.count(n) for n in items}
        plan, proven = packing.branch_and_bound(counts, 50, packing.best_fit(counts, 50), packing.fewest(counts, 50), 10**6)
        best = fewest(items, 50)
        assert proven and sum(t for t, _ in plan) == best == sum(t for t, _ in packing.pack_histogram(counts, 50))


def test_best_fit_leaves_the_least_room():
    assert sum(t for t, _ in packing.best_fit({6: 1, 5: 1, 4: 1, 3: 1, 2: 1}, 10)) == 2
    plan = packing.best_fit({60: 1, 50: 1, 45: 1, 5: 1}, 100)  # first fit puts 5 beside 60
    assert {tuple(sorted(u)) for _, u in plan} == {(60,), (5, 45, 50)}


# 5 top-k


def best_by_brute_force(rows, k=5):
    """All scores with Python's integers."""
    whole = [(i, [int(np.floor(256 * x)) if abs(256 * x) < 2**52 else int(256 * x) for x in v]) for i, v in rows]
    want = []
    for i, q in whole:
        if i % 50 == 0:
            scores = sorted((-min(2**63 - 1, max(-(2**63), sum(a * b for a, b in zip(v, q, strict=False)))), j) for j, v in whole if j != i)
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(want)


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(700, 12)), 1)  # ties
    x[100:250] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    none = [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (950, [1e308] * 12)]
    vectors = topk_search.integral(spark.createDataFrame(rows + none, "vec_id long, embedding array<double>"))
    out = topk_search.top_k(vectors, vectors.where("vec_id % 50 = 0"), block_rows=40, query_rows=5).collect()
    assert sorted(map(tuple, out)) == best_by_brute_force(rows)


@pytest.mark.parametrize("scales", [[1.0], [1.0, 1e5, 1e9], [1.0, 1e17], [1.0, 1e140, 1e300]])
def test_bounds_hold_for_components_of_any_size(scales):
    rng = np.random.default_rng(8)
    x = np.floor(256 * rng.normal(size=(900, 8)) * rng.choice(scales, size=(900, 1)))
    ids = np.arange(900)
    pa = topk_search.pa
    held = pa.table({"vec_id": ids, "own": ids, "v": pa.array(list(map(list, x)), pa.list_(pa.float64()))})
    q = [0, 50, 100, 450]
    exact = {i: sorted((-int(s), j) for j, s in enumerate(topk_search.scores(x, x[i])) if j != i)[:5] for i in q}
    assert exact[0] == sorted((-min(2**63 - 1, max(-(2**63), sum(int(a) * int(b) for a, b in zip(x[0], x[j], strict=True)))), j) for j in range(1, 900))[:5]
    for floors in ([None] * 4, [float(-exact[i][-1][0]) for i in q]):
        wanted = pa.table({"own": pa.array(q), "v": pa.array([list(x[i]) for i in q], pa.list_(pa.float64())), "floor": pa.array(floors, pa.float64())})
        out, _ = topk_search.block_best(held, wanted, 5, resolve=8)
        for i in q:
            assert [(-s, j) for a, j, s in out if a == i][:5] == exact[i]


def test_lists_are_read_in_part():
    """On random directions, where bounds close latest, fewer entries are read than there are."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4096, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True))
    all_scores = x[:20] @ x.T
    floor = np.sort(all_scores, axis=1)[:, -6]
    lists = topk_search.SortedLists(x)
    able = lists.reach(x[:20], 5, np.zeros((4096, 20), bool), floor)
    assert all(set(np.argsort(-s, kind="stable")[:5]) <= set(a) for s, a in zip(all_scores, able, strict=True))
    assert lists.read < 0.7 * 20 * x.size
    lists.read = 0
    assert not any(map(len, lists.reach(x[:20], 5, np.zeros((4096, 20), bool), np.full(20, 1e9))))
    assert lists.read == 0  # even the first entries of all lists stay below the floor


def test_top_k_on_awkward_rows(spark):
    rows = [(0, [1.0]), (0, [1.0]), (50, [2.0, 3.0]), (50, [-7.0, 1.0]), (100, []), (150, [1e300]), (3, [1e17, -1e17]), (200, [-1e17, 4.0])]
    docs = spark.createDataFrame([(*r, 1.0) for r in [*rows, (None, [1.0])]], "vec_id long, embedding array<double>, score double")
    vectors = topk_search.rows_named(topk_search.integral(docs))
    out = topk_search.top_k(vectors, vectors.where("vec_id % 50 = 0"), row_col="row").collect()
    # Every row is a candidate and, if its id is one, a query of its own; only itself is no candidate.
    whole = [(i, [float(int(256 * x // 1)) if abs(x) < 1e14 else 256 * x for x in v]) for i, v in rows]
    want = []
    for k, (query_id, q) in enumerate(whole):
        if query_id % 50 == 0:
            found = [(sum(int(a) * int(b) for a, b in zip(q, v)), i) for j, (i, v) in enumerate(whole) if j != k]
            found = sorted((-min((1 << 63) - 1, max(-(1 << 63), s)), i) for s, i in found)[:5]
            want += [(query_id, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    assert sorted(map(tuple, out)) == sorted(want)
    assert topk_search.top_k(vectors.where("false"), vectors.where("false"), row_col="row").count() == 0


# 6 near dedup


def simhash_components(rows):
    prints = {}
    for i, text, *_ in rows:
        words = WORD.findall(ascii_lower(text))
        shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        ones = [0] * 64
        for s in shingles:
            h = xxhash.xxh64(s, seed=42).intdigest()
            for k in range(64):
                ones[k] += h >> k & 1
        prints[i] = sum((ones[k] * 2 > len(shingles)) << k for k in range(64))
    return prints, reach(prints)


def reach(prints):
    ids, parent = sorted(prints), {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("dense", [64, 1])
def test_near_dedup_matches_brute_force(docs, rows, dense):
    prints, components = simhash_components(rows)
    out = near_dedup.near_groups(docs, dense=dense).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == {i: (f"{prints[i]:016x}", components[i]) for i in prints}


@pytest.mark.parametrize("dense", [1000, 2])
def test_links_of_chained_fingerprints(spark, dense):
    rng = random.Random(7)
    values = [rng.getrandbits(64) for _ in range(12)]
    for _ in range(150):
        values.append(rng.choice(values) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ ((rng.random() < 0.4) << rng.randrange(64)))
    prints = dict(enumerate(dict.fromkeys(values)))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in prints.values()]
    roots = {r.node: r.root for r in near_dedup.components(near_dedup.near_links(spark.createDataFrame(signed, "fp long"), dense)).collect()}
    got, want = {}, {}
    for i, component in reach(prints).items():
        want.setdefault(component, set()).add(i)
        got.setdefault(roots.get(signed[i][0], signed[i][0]), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_dedup_on_awkward_rows(docs, odd, none):
    assert near_dedup.near_groups(none).count() == 0
    assert sorted(str(r.component_id) for r in near_dedup.near_groups(odd).collect()) == ["3", "3", "4", "4", "4", "4"]
    assert near_dedup.drop_near(odd).count() == 2
    assert near_dedup.drop_near(docs).columns == docs.columns


def test_near_dedup_keeps_one_row_of_each_component_whatever_the_ids(spark):
    prose = lambda seed: " ".join(str(random.Random(seed * 1000 + k).random()) for k in range(40))
    rows = [(None, prose(1)), (None, prose(2)), (None, prose(2)), (None, prose(3)), (9, prose(3)), (5, prose(4)), (5, prose(5)), (4, prose(5)), (5, prose(5))]
    kept = near_dedup.drop_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(None, prose(1)), (None, prose(2)), (9, prose(3)), (5, prose(4)), (4, prose(5))]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))


# 7 URL filters


def test_url_filter_matches_brute_force(spark):
    urls = [
        None, "", "no scheme", "http://", "http://a.net", "http://a.net/", "HTTP://A.NET/x", "http://net/", "http://xnet/", "http://a.example.net/en/1",
        "http://a.example.net/en", "http://example.com/de/x?y#z", "http://example.com/DE/x", "http://b.org/fr/?q", "http://b.org?x/fr/", "http://b.org:80/fr/",
        "x://y://z.net/", "http://É.net/", "http://n-et.net/a\nb",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(3, "http://")], "page_id long, url string").withColumn("host", F.lit(1))
    out = url_filter.judge_urls(pages, queries.RULES).collect()
    assert len(out) == len(urls) + 1

    def judge(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url[url.index("://") + 3 :]
        authority = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(authority) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in authority)
        best = None
        for rule in queries.RULES:
            h, _, p = rule.text.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule.text) > len(best.text)):
                best = rule
        return host, path, best and best.text, best.verdict if best else "allow"

    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out} == {i: judge(u) for i, u in enumerate(urls)}


def test_url_filter_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert url_filter.judge_urls(pages, [], "block").first().verdict == "block"
    assert url_filter.judge_urls(pages.where("false"), queries.RULES).count() == 0


def test_rules_are_filed_under_their_rarest_token():
    rules = [url_filter.Rule("common.com/rare/", "block"), url_filter.Rule("common.com/ra", "block")]
    index, rest = url_filter.build_index(rules, {"common": 5, "com": 9, "rare": 1})
    assert index == {"rare": [0], "common": [1]} and not rest


# 8 LM scoring


def losses_by_brute_force(rows, wanted):
    """(background, target) loss of each row under dictionaries of words and of bytes."""

    def model(texts):
        grams, words = [{} for _ in range(3)], {}
        for t in texts:
            for w in WORD.findall(t.encode()):
                words[w] = words.get(w, 0) + 1
                padded = b"  " + w + b" "
                for k in range(2, len(padded)):
                    for order in range(3):
                        gram = padded[k - order : k + 1]
                        grams[order][gram] = grams[order].get(gram, 0) + 1

        def byte(gram):
            value = 1 / 256
            for order in range(3):
                g = gram[2 - order :]
                beside = [n for x, n in grams[order].items() if x[:-1] == g[:-1]]
                lot = max(1, len(beside))
                value = (grams[order].get(g, 0) + lot * value) / (sum(beside) + lot)
            return value

        def loss(own, held):
            total = 0.0
            for w in own:
                padded = b"  " + w + b" "
                base = sum(np.log2(byte(padded[k - 2 : k + 1])) for k in range(2, len(padded)))
                n = words.get(w, 0) - held * own.count(w)
                total -= np.log2((n + (len(words) + 1) * 2**base) / (sum(words.values()) - held * len(own) + len(words) + 1))
            return total / len(own) if own else 0.0

        return loss

    background, target = model([t or "" for _, t in rows]), model([t or "" for i, t in rows if i in wanted])
    return [(background(WORD.findall((t or "").encode()), 1), target(WORD.findall((t or "").encode()), int(i in wanted))) for i, t in rows]


@pytest.mark.parametrize("frequent", [0, 5, 1 << 17])
def test_lm_losses_match_a_direct_model(spark, frequent):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 4)))
    rows = [(k, " ".join(word() for _ in range(rng.randint(1, 12)))) for k in range(20)] + [(20, None), (21, " "), (22, "a  b\na"), (23, "a b a"), (None, "a b"), (3, "again a")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    wanted = {1, 3, 5, 7, 20, 22}
    out = lm_scoring.score_documents(docs, spark.createDataFrame([(w,) for w in [*wanted, 5, None, 99]], "doc_id long"), frequent=frequent).collect()
    got = sorted((str(r.doc_id), r.tokens, round(r.background_loss, 4), round(r.target_loss, 4)) for r in out)
    want = [(str(i), len(words_of(t)), round(b, 4), round(w, 4)) for (i, t), (b, w) in zip(rows, losses_by_brute_force(rows, wanted), strict=True)]
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-3)
    assert all(r.score == r.background_loss - r.target_loss for r in out)


def test_lm_tells_documents_that_occur_twice_apart(spark):
    rng = random.Random(14)
    common = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    prose = lambda: " ".join(rng.choice(common) if rng.random() < 0.8 else "".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(100))
    texts = [prose() for _ in range(200)]
    rows = list(enumerate(texts + texts[:20]))
    out = lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k,) for k in range(50, 120)], "doc_id long")).collect()
    twice = [r.background_loss for r in out if r.doc_id < 20 or r.doc_id >= 200]
    once = [r.background_loss for r in out if 20 <= r.doc_id < 200]
    assert max(twice) < min(once)
    # Held out of its own model, a document of the target does not look better for having been counted.
    inside, outside = (np.mean([r.score for r in out if (50 <= r.doc_id < 120) == k and 20 <= r.doc_id < 200]) for k in (True, False))
    assert abs(inside - outside) < 0.1


@pytest.mark.parametrize("frequent", [0, 9])
def test_lm_counts_words_beyond_an_entry(spark, frequent):
    rows = [(1, "a " * 70_000 + "b"), (2, "a b")]
    out = lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(2,)], "doc_id long"), frequent=frequent).collect()
    for r, want in zip(sorted(out, key=lambda r: r.doc_id), losses_by_brute_force([(1, "a " * 3 + "b"), (2, "a b")], {2}), strict=True):
        assert r.background_loss > 0 and r.tokens == (70_001 if r.doc_id == 1 else 2) and want[0] > 0
    # Document 1's own a's are held out: the other documents have one a among two words.
    assert {r.doc_id: r.background_loss for r in out}[1] < 3


def test_lm_on_awkward_rows(odd, none):
    assert lm_scoring.score_documents(none, none).count() == 0
    assert lm_scoring.score_documents(odd, none).count() == 6
    assert lm_scoring.score_documents(odd, odd.drop("score")).count() == 6


# 9 sharding


def check_shards(out, rows, shards):
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards))
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    size = {k: sum(r.size for r in v) for k, v in by.items()}
    largest = max(r.size for r in out)
    assert max(size.values()) - min(size.get(k, 0) for k in range(shards)) <= 3 * largest + 0.01 * sum(size.values())


def test_sharding_is_even_and_whole(docs, rows):
    for shards in (8, 5):
        out = sharding.shard_documents(docs, shards).collect()
        assert sorted(r.doc_id for r in out) == [r[0] for r in rows]
        texts = {r[0]: (r[1] or "").encode() for r in rows}
        assert all(r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in out)
        check_shards(out, rows, shards)
    again = sharding.shard_documents(docs.repartition(7), 5).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in out}


def shards_by_plain_tree(points, ties, sizes, shards):
    """Rows' shards under a k-d tree that is cut at exact weighted medians, the nearer side of the row that holds it."""
    spans = [max(1, max(c) - min(c)) for c in zip(*points, strict=True)]
    out = {}

    def split(rows, first, n):
        if n == 1 or not rows:
            out.update(dict.fromkeys(rows, first))
            return
        widths = [(max(points[r][d] for r in rows) - min(points[r][d] for r in rows)) / spans[d] for d in range(len(spans))]
        wide = widths.index(max(widths))
        order = sorted(rows, key=lambda r: (points[r][wide], *ties[r]))
        need, below, at = sum(sizes[r] for r in rows) * (n // 2) // n, 0, 0
        while at < len(order) and below + sizes[order[at]] < need:
            below += sizes[order[at]]
            at += 1
        if at < len(order) and abs(below + sizes[order[at]] - need) < abs(need - below):
            at += 1
        split(order[:at], first, n // 2)
        split(order[at:], first + n // 2, n - n // 2)

    split(list(range(len(points))), 0, shards)
    return out


@pytest.mark.parametrize("shards", [2, 5, 8])
def test_tree_matches_a_plain_one(spark, shards):
    rng = random.Random(21)
    rows = [(k, rng.randint(0, 9), rng.choice([3, 3, 3, 900, rng.randint(0, 10**6)]), rng.randint(1, 40)) for k in range(400)]
    table = common.store(spark.createDataFrame(rows, "k long, a long, b long, size long"), "plain-tree")
    got = {r.k: r.shard for r in sharding.kd_shards(table, ["a", "b"], ["k"], "size", shards, slack=0.0).collect()}
    assert got == shards_by_plain_tree([r[1:3] for r in rows], [(r[0],) for r in rows], [r[3] for r in rows], shards)


def test_values_that_begin_alike_are_cut_apart(spark):
    rows = [(k, "same size", "en", f"https://crawl.example/{'ab'[k % 2]}") for k in range(400)]
    docs = spark.createDataFrame([(k, f"{t} {k:03}", x, s) for k, t, x, s in rows], "doc_id long, text string, lang string, source string")
    out = sharding.shard_documents(docs, 2).collect()
    assert all(len({r.shard for r in out if r.doc_id % 2 == k}) == 1 for k in (0, 1)) and len({r.shard for r in out}) == 2
    ranks = {r.value: r["rank"] for r in sharding.dense_ranks(docs.select("source").unionByName(spark.createDataFrame([(None,), ("b",)], "source string")), "source").collect()}
    assert ranks == {None: 0, "b": 1, "https://crawl.example/a": 2, "https://crawl.example/b": 3}


def test_sharding_keeps_equal_texts_together(spark):
    rng = random.Random(12)
    texts = [f"text {i % 600} " + "x" * rng.randint(0, 3) for i in range(3000)]
    rows = [(i, t, rng.choice("ab"), rng.choice("cd")) for i, t in enumerate(texts)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    shards = {}
    for r in out:
        shards.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 7
    check_shards(out, rows, 8)


def test_sharding_on_awkward_rows(odd, none):
    assert sharding.shard_documents(none).count() == 0
    out = sharding.shard_documents(odd, 3).collect()
    assert len(out) == 6 and len({(r.shard, r.slot) for r in out}) == 6


# 10 mixing


def test_water_fill_clamps_and_shares():
    assert mixing.water_fill([100, 100], [5, 1], 150, 2) == pytest.approx([125, 25])
    assert mixing.water_fill([10, 100, 100], [5, 2, 1], 150, 2) == pytest.approx([20, 130 * 2 / 3, 130 / 3])
    assert mixing.water_fill([10, 10], [1, 1], 100, 2) == [20, 20]
    assert mixing.water_fill([0, 10], [5, 1], 15, 2) == [0, 15]
    assert mixing.water_fill([], [], 0, 2) == []


def plain_targets(sizes):
    """The one level at which shares in proportion to 5, 2, 1, cut at twice the sizes, add up to 150 %, by bisection."""
    weights = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    low, high = 0.0, 2.0 * sum(sizes) + 1
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(2 * n, level * w) for n, w in zip(sizes, weights)) < 1.5 * sum(sizes):
            low = level
        else:
            high = level
    return [min(2 * n, high * w) for n, w in zip(sizes, weights)]


def test_mixing_meets_targets(docs, rows):
    plan = mixing.mix_plan(docs).collect()
    sizes = {}
    for d, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words_of(text))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, plain_targets([sizes[s] for s in names]), strict=True))
    taken, largest = dict.fromkeys(names, 0), {}
    texts = {r[0]: r[1] for r in rows}
    for r in plan:
        assert r["size"] == len(words_of(texts[r.doc_id])) and r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken == r["size"] * r.repeats <= 2 * r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
    assert all(abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6 for s in names)
    assert {(r.doc_id, r.taken) for r in mixing.mix_plan(docs.repartition(6)).collect()} == {(r.doc_id, r.taken) for r in plan}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    count = {}
    for r in mixed.select("doc_id").collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert count == {r.doc_id: r.repeats for r in plan if r.repeats}


def test_mixing_on_awkward_rows(odd, none):
    assert mixing.mix_plan(none).count() == 0 and mixing.mix(none).count() == 0
    plan = mixing.mix_plan(odd).collect()
    assert len(plan) == 6 and mixing.mix(odd).count() == sum(r.repeats for r in plan)


# shared helpers


def test_weighted_cuts_find_the_nearest_boundary(spark):
    rng = random.Random(8)
    rows = [(g, rng.randint(0, 40), rng.randint(-(10**6), 10**6), rng.randint(0, 9)) for g in range(3) for _ in range(300)]
    table = spark.createDataFrame(rows, "g int, a long, b long, w long")
    needs = {0: 100.0, 1: 700.5, 2: 10**9}
    cuts = common.weighted_cuts(table, "g", ["a", "b"], "w", needs, fanout=4)
    for g, need in needs.items():
        mine = sorted(r[1:] for r in rows if r[0] == g)
        sums = [0]
        for r in mine:
            sums.append(sums[-1] + r[2])
        got = table.where(F.col("g") == g).where(common.below(cuts[g], ["a", "b"])).agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
        assert abs(got - need) == min(abs(s - need) for s in sums)


def test_sweep_deletes_what_was_written(spark):
    common.sweep(spark)
    stored = common.store(spark.range(3), "swept")
    (path,) = {f.rsplit("/", 1)[0] for f in stored.inputFiles()}
    assert common.sweep(spark) == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


# Ids, bytes and kinds of columns that an earlier version changed or refused


def test_page_ids_stay_what_they_are(spark):
    ids = [None, (1 << 53) + 1, (1 << 60) + 7, -(1 << 63)]
    pages = spark.createDataFrame([(i, "http://a.net/" + "x" * 100_000, 1) for i in ids], "page_id bigint, url string, host int").coalesce(1)
    got = url_filter.judge_urls(pages, queries.RULES).collect()
    assert sorted(map(str, ids)) == sorted(str(r["page_id"]) for r in got) and {r["rule"] for r in got} == {"net/"}
    assert url_filter.judge_urls(pages.limit(0), queries.RULES).count() == 0


def test_shards_of_ids_that_are_far_apart(spark):
    rng = random.Random(3)
    rows = [(rng.randint(-(1 << 63), (1 << 63) - 1), "x" * rng.randint(0, 50), "en", rng.choice("ab")) for _ in range(400)] + [(-(1 << 63), "a", "en", "a"), ((1 << 63) - 1, "b", "en", "a")]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), shards=5).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(out) == len(rows) and len(sizes) == 5 and sizes.max() - sizes.min() < 0.05 * sizes.mean() + 60


def test_language_model_groups_are_bounded_by_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lm_scoring, "GROUP_BYTES", 3000)
    texts = [b"word " * 300, b"x" * 9000, b"", b"y z " * 200, b"q" * 100]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts), pa.array([False] * 5)], names=["doc_id", "text", "wanted"])
    from tidemark.llm.substring_dedup import Hasher

    groups = list(lm_scoring.grouped(iter([batch.slice(k, 1) for k in range(5)]), Hasher()))
    assert [len(data) for _, data, _ in groups] and all(len(data) <= 3000 or len(docs) == 1 for docs, data, _ in groups)
    words = [bytes(data[a:b]) for _, data, (_, _, start, end) in groups for a, b in zip(start, end)]
    assert words == [w for t in texts for w in t.split()]


def test_least_id_and_no_id_are_told_apart(spark):
    passage = " ".join(f"w{k}" for k in range(40))
    rows = [(None, passage), (-(1 << 63), passage), (5, passage), (5, passage + " more")]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    assert sorted(r["n_removed"] for r in got) == [0, 40, 40, 40]


def test_columns_that_cannot_be_hashed(spark):
    rows = [(1, "one two three four", {"a": 1}), (2, "one two three four", {"a": 2}), (3, "ONE two three four", None), (3, "ONE two three four", None), (9, "quite another text here", {"b": 1})]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, tags map<string,int>").withColumn("deep", F.array(F.struct("tags")))
    assert {r["doc_id"] for r in near_dedup.near_groups(df).collect()} == {1, 2, 3, 9}
    assert sorted((r["doc_id"], r["tags"]) for r in near_dedup.drop_near(df).collect()) == [(1, {"a": 1}), (9, {"b": 1})]
    assert sorted((r["doc_id"], str(r["tags"])) for r in exact_dedup.drop_exact(df).collect()) == [(3, "None"), (9, "{'b': 1}")]


def test_a_hot_fingerprint_is_no_key_of_the_last_join(spark):
    rows = [(k, None if k % 3 else f"text number {k}") for k in range(3000)]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got.count() == 3000
    zero = got.where("fingerprint = '0000000000000000'")
    assert zero.count() >= 2000 and zero.agg(F.min("component_id")).first()[0] in (0, 1)
