"""Toxicity, near-duplicates, repeated passages and byte-pair encoding against brute force, with hard cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from spliceatlas.llm import _graph, bpe, minhash, substring, toxicity
from spliceatlas.llm._store import Scratch
from spliceatlas.llm._text import rolling, split_words, window_starts, word_hashes
from spliceatlas.llm.queries import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id bigint, text string, id string, n int, gid int"  # clashing names on purpose


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    vocabulary = ["w%d" % k for k in range(300)] + ["É", "naïve", "I'm", "漢字", "a.b", "X"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage = text(60)
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two"), (5, "ONE two"), (6, "one  two three"), (7, "a " * 400)]
    for k in range(8, 40):
        out.append((k, text(rnd.randint(1, 120))))
    base = text(200).split(" ")
    for k in range(40, 60):  # a group of near copies
        copy = list(base)
        for _ in range(rnd.randint(0, 12)):
            copy[rnd.randrange(len(copy))] = "edit%d" % rnd.randrange(10**6)
        out.append((k, " ".join(copy)))
    for k in range(60, 70):
        out.append((k, text(20) + "\n" + passage + "  " + text(15)))
    out += [(70, out[12][1]), (71, out[12][1]), (72, out[45][1].upper()), (73, text(30_000)), (74, text(34)), (75, text(35))]
    return out


def words_removed(texts, window=35):
    words = [WORD.findall(t or "") for _, t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    gone = []
    for w in words:
        g = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                g[i : i + window] = [True] * window
        gone.append(g)
    return words, gone


def test_words_and_hashes():
    texts = pa.array(["Ab c d", None, "", "x" * 5000 + " y", " \t", "c ab"])
    words = split_words(texts)
    got = [[words.data[a:b].tobytes().decode() for a, b in zip(words.start[i:j], words.end[i:j])] for i, j in zip(words.first[:-1], words.first[1:])]
    assert got == [WORD.findall(t or "") for t in texts.to_pylist()]
    h = word_hashes(words, lower=True)
    assert h[0] == h[-1] and len(set(h.tolist())) == len({w.translate(LOWER) for g in got for w in g})
    r = rolling(np.arange(100, dtype=np.uint64), 18)
    assert len(r) == 83 and len(set(r.tolist())) == 83
    assert window_starts(np.array([3, 0, 2, 1]), 2).tolist() == [0, 1, 3]


def test_repeats_match_brute_force(spark, corpus):
    words, gone = words_removed(corpus)
    got = {r.doc_id: r for r in substring.remove_repeats(docs_of(spark, corpus)).collect()}
    assert len(got) == len(corpus)
    for (i, _), w, g in zip(corpus, words, gone):
        assert got[i].n_words == len(w) and got[i].n_removed == sum(g)
        assert got[i].kept == " ".join(x for x, y in zip(w, g) if not y)
        assert sum(s.end - s.start for s in got[i].repeats) == sum(g)


def test_windows_of_one_first_hash_are_told_apart():
    keys, second = np.array([5, 5, 5, 9, 9], np.uint64), np.array([1, 2, 2, 7, 8], np.uint32)
    sent = substring._send(3, 1, keys, keys, second, np.zeros(5, np.uint8))
    assert sent.num_rows == 1
    found = substring._hits(substring._repeated(sent, False))
    assert [x.tolist() for x in found] == [[5], [2]]
    several = np.array([4, 5, 5, 5, 9], np.uint64), np.array([1, 1, 2, 4, 7], np.uint32)
    assert substring._among_both(keys, second, *several).tolist() == [True, True, True, True, False]
    words = split_words(pa.array(["a b c a"]))
    one, other = word_hashes(words), word_hashes(words, other=True)
    assert len(set(one) | set(other)) == 6 and other[0] == other[3]


def test_repeated_rows_repeat_and_empty_stays_empty(spark):
    long = " ".join("t%d" % k for k in range(40))
    rows = [(1, long), (1, long), (None, None)]
    got = substring.remove_repeats(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 40), (1, 40)]
    assert substring.remove_repeats(docs_of(spark, [])).collect() == []
    cut = substring.cut_repeats(docs_of(spark, [(1, "keep   me"), (2, None), (3, long + " tail"), (4, long)]), length_col="n")
    assert cut.columns == ["doc_id", "text", "id", "n", "gid"]
    assert {r.doc_id: (r.text, r.n) for r in cut.collect()} == {1: ("keep   me", 9), 2: (None, 1), 3: ("tail", 4), 4: ("", 0)}


def components(texts, width=3, percent=85):
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("rows,width,percent", [(2048, 3, 85), (4, 3, 85), (2048, 5, 80)])
def test_near_duplicates_match_brute_force(spark, corpus, rows, width, percent, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", rows)  # 4: groups are cut into many blocks
    expected = components(corpus, width, percent)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs_of(spark, corpus), width, percent).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == expected
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def variants(n, most, seed=3):
    """Copies of one text of 120 words with up to `most` words changed: many are near each other without being linked."""
    rnd = random.Random(seed)
    base = ["b%d" % rnd.randrange(400) for _ in range(120)]
    out = []
    for k in range(n):
        copy = list(base)
        for _ in range(rnd.randint(0, most)):
            copy[rnd.randrange(len(copy))] = "e%d" % rnd.randrange(2000)
        out.append((k, " ".join(copy)))
    return out


@pytest.mark.parametrize("block_rows,block_bytes,hub_pairs", [(2048, 2 << 20, 256), (50, 2 << 20, 20), (2048, 20_000, 256)])
def test_large_groups_of_unlinked_variants_match_brute_force(spark, block_rows, block_bytes, hub_pairs, monkeypatch):
    for name, value in (("BLOCK_ROWS", block_rows), ("BLOCK_BYTES", block_bytes), ("HUB_PAIRS", hub_pairs)):
        monkeypatch.setattr(minhash, name, value)
    rows = variants(400, 9)
    expected = components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs_of(spark, rows), 3, 85).collect()}
    assert got == expected
    assert len({c for _, c in expected.values()}) > 50


def test_intersections_of_common_and_rare_members():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 40 if k % 2 else 4000, 80)).astype(np.uint64) for k in range(90)]
    got = minhash._intersections(sets[:40], sets[40:])
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets[40:]] for x in sets[:40]]
    assert minhash._intersections(sets[:3], sets[:3]).tolist() == [[len(np.intersect1d(x, y)) for y in sets[:3]] for x in sets[:3]]


def test_components_of_paths_and_endless_steps(spark, monkeypatch):
    edges = [(k, k + 1) for k in range(50)] + [(100 + k, 100) for k in range(1, 40)] + [(7, 7), (300, 301), (301, 300)]
    scratch = Scratch(spark)
    found = {r.node: r.root for r in _graph.components(spark.createDataFrame(edges, "a bigint, b bigint"), scratch).collect()}
    assert found == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 140), 100), 300: 300, 301: 300}
    assert _graph.components(spark.createDataFrame([], "a bigint, b bigint"), scratch).collect() == []
    monkeypatch.setattr(_graph, "MOST_STEPS", 1)
    with pytest.raises(RuntimeError):
        _graph.components(spark.createDataFrame(edges, "a bigint, b bigint"), scratch)


def test_near_duplicates_of_odd_tables(spark):
    assert minhash.near_duplicates(docs_of(spark, [])).collect() == []
    got = minhash.near_duplicates(docs_of(spark, [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (9, None)])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (5, 5, True), (5, 5, True), (9, 9, True)]


def test_one_row_of_each_kept_document_stays(spark):
    clean, copied = (" ".join(f"{w}{k}" for k in range(60)) for w in "tc")
    rows = [(1, clean)] * 5 + [(2, copied), (3, copied), (3, copied), (4, "short"), (4, "short and longer"), (4, None), (5, None), (5, None), (6, ""), (None, clean), (None, clean)]
    kept = minhash.keep_one(docs_of(spark, rows).repartition(3))
    assert kept.columns == ["doc_id", "text", "id", "n", "gid"]
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == Counter([(1, clean), (2, copied), (4, "short and longer"), (5, None), (6, ""), (None, clean), (None, clean)])
    following = substring.cut_repeats(kept.where("doc_id is not null"), length_col=None)
    assert Counter((r.doc_id, r.text) for r in following.collect()) == Counter({k: 1 for k in got if k[0] is not None})
    assert minhash.keep_one(docs_of(spark, [])).collect() == []


def test_chain_of_links(spark):
    """Ends of a chain are far apart but in one component."""
    base = ["c%d" % k for k in range(300)]
    rows = [(k, " ".join(["z%d" % j for j in range(6 * k)] + base[6 * k :])) for k in range(12)]
    assert {r.component_id for r in minhash.near_duplicates(docs_of(spark, rows)).collect()} == {0}


ODD = ["", " ", "\n\n  \n", "a  b\n\n c \t", "x<|endoftext|> y <|startoftext|>z", "café naïve   x　y", "don't DON'T we'll", "a" * 40, "ΣΣ İx é Å", "\x1c a\x1db", "1234 5,6.7 !!!", "\U0001f600\U0001f600 hi", "trail  ", "<|", "\x85x y\x85", "́abc ́", "word " * 3000]


@pytest.mark.parametrize("part,first", [(1 << 19, 1 << 19), (30, 16)])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoding_equals_the_library(name, part, first, monkeypatch):
    monkeypatch.setattr(bpe, "PART", part)  # 30 and 16: many parts
    monkeypatch.setattr(bpe, "FIRST", first)
    from tokenizers import Tokenizer

    rnd = random.Random(3)
    texts = ODD + ["".join(rnd.choice(["a", "b", "the", " ", "  ", "\n", " ", "é", "'s", "1", "!", "<|endoftext|>", "Σ", "é", "\x1f", "漢", "ing", "ation"]) for _ in range(rnd.randint(1, 40))) for _ in range(400)]
    vocab, library = bpe.vocabulary(tokenizer_file(name)), Tokenizer.from_file(tokenizer_file(name))
    got = [ids[a:b].tolist() for _, _, ids, first in bpe.encode_batch(pa.array(texts), vocab) for a, b in zip(first[:-1], first[1:])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_round_trip_and_decoding(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = docs_of(spark, [(k, t) for k, t in enumerate(ODD)] + [(99, None), (None, "x")])
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = {r.doc_id: r.ids for r in bpe.encode(docs, path).collect()}
    for r in bpe.round_trip(docs, path).collect():
        e = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert ids[r.doc_id] == e and r.n_tokens == len(e)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, e)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()
    broken = spark.createDataFrame([(1, [0xE2 and 158]), (2, None), (3, [50256])], "doc_id bigint, ids array<int>")
    back = {r.doc_id: r.text for r in bpe.decode(broken, path).collect()}
    assert back == {1: library.decode([158], skip_special_tokens=False), 2: "", 3: "<|endoftext|>"}
    assert bpe.round_trip(docs_of(spark, []), path).collect() == []


def test_merging_with_overlaps():
    vocab = bpe.vocabulary(tokenizer_file("byte_bpe_50k.json"))
    assert bpe._apart(np.array([0, 1, 2, 5]), np.arange(1, 20)).tolist() == [0, 2, 5]
    ids, stood = vocab.merge(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(ids) == len(stood) == 0


def test_toxicity_learns_and_holds_out(spark):
    rnd = random.Random(1)
    plain = ["p%d" % k for k in range(200)]
    rows, labels = [], []
    for k in range(900):
        words = [rnd.choice(plain) for _ in range(30)]
        bad = k % 4 == 0
        if bad:
            words[rnd.randrange(30)], words[rnd.randrange(30)] = "Idiot,", "scum!"
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad), None if k % 50 else 1))
    rows += [(900, None), (901, ""), (902, "idiot scum " * 20_000), (None, "scum idiot")]
    docs, table = docs_of(spark, rows), spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0), (4, 0, 0)], "doc_id bigint, toxic int, quality int")
    model = toxicity.train(docs, table)
    assert 0 < len(model[0]) < 5000
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    held = [r.doc_id for r in docs.where(toxicity.held_out("doc_id")).collect()]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held if i < 900]) > 0.95
    assert got[900] == got[901] < 0.5 <= got[902]
    kept = toxicity.reject_toxic(docs, table)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, [(1, "a b"), (2, None)])
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert all(r.score < 0.5 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(docs_of(spark, []), model).collect() == []


def test_labels_of_the_held_out_rows_are_not_read(spark):
    docs = docs_of(spark, [(k, "bad word" if k % 2 else "good word") for k in range(100)])
    table = docs.select("doc_id", (docs.doc_id % 2).cast("int").alias("toxic"))
    flipped = table.withColumn("toxic", toxicity.F.when(toxicity.held_out("doc_id"), 1 - table.toxic).otherwise(table.toxic))
    a, b = toxicity.train(docs, table), toxicity.train(docs, flipped)
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_graph_components(spark):
    from spliceatlas.llm._graph import components as connected
    from spliceatlas.llm._store import Scratch

    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 200), (200, 300), (500, 500)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark)).collect()}
    expected = defaultdict(int) | {k: 0 for k in range(61)} | {k: 100 for k in (100, 200, 300)}
    assert got == dict(expected)


def plain_ftrl(rows, labels):
    """FTRL-proximal one coordinate at a time, as published; the bias by its own rate."""
    z, n = defaultdict(float), defaultdict(float)
    alpha, beta, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)

    bias, seen = np.log((sum(labels) + 0.5) / (len(labels) - sum(labels) + 4.5)), 1.0
    for _ in range(toxicity.EPOCHS):
        for row, y in zip(rows, labels):
            w = {i: weight(i) for i in row}
            g = 1 / (1 + np.exp(-(sum(w.values()) + bias))) - y
            for i in row:
                sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
            seen += g * g
            bias -= alpha * g / np.sqrt(seen)
    return {i: weight(i) for i in list(z)}, bias


def test_fit_matches_plain_ftrl(monkeypatch):
    monkeypatch.setattr(toxicity, "L1", 0.5)
    rnd = random.Random(3)
    labels = [rnd.randrange(2) for _ in range(120)]
    rows = [np.array(sorted(rnd.sample(range(40), 6) + ([41] if y else [43])), np.int32) for y in labels]
    weights, bias = toxicity._fit(rows, np.array(labels, float))
    expected, expected_bias = plain_ftrl([r.tolist() for r in rows], labels)
    assert {i: w for i, w in expected.items() if w} == pytest.approx({int(i): weights[i] for i in np.flatnonzero(weights)})
    assert bias == pytest.approx(expected_bias) and len(np.flatnonzero(weights)) < 42


def test_rejecting_without_rows_or_labels(spark):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    docs = docs_of(spark, [(1, None), (None, ""), (2, "word " * 50_000), (2, "x")])
    assert Counter((r.doc_id, r.text) for r in toxicity.reject_toxic(docs, labels).collect()) == Counter((r.doc_id, r.text) for r in docs.collect())
    assert toxicity.reject_toxic(docs_of(spark, []), labels).collect() == []


def test_keeping_one_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (2, "A b c d e f"), (4, None), (5, ""), (6, "word " * 60_000), (7, "word " * 60_001), (8, " ")]
    kept = minhash.keep_one(docs_of(spark, rows).withColumnsRenamed({"n": "kept", "gid": "salt"}))
    assert kept.columns == ["doc_id", "text", "id", "kept", "salt"]
    assert Counter(r.doc_id for r in kept.collect()) == Counter([None, None, 2, 4, 5, 6, 8])


def test_rows_that_repeat_an_id_are_compared_once(spark, monkeypatch):
    sent = []
    confirm = minhash._confirm

    def spy(docs, *rest):
        sent.append(docs.count())
        return confirm(docs, *rest)

    monkeypatch.setattr(minhash, "_confirm", spy)
    words = [f"w{k}" for k in range(100)]
    rows = [(1, " ".join(words))] * 500 + [(2, " ".join([*words[:99], "other"])), (3, "something else entirely"), (1, "a second text of one")]
    found = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs_of(spark, rows)).distinct().collect())
    assert set(found) == {(1, 1), (2, 1), (3, 3)} and sent[0] <= 4
