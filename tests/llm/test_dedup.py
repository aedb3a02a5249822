"""N-gram Jaccard join and substring dedup against brute force, with odd rows."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from rowkin.llm import _words, ngram_join, substring_dedup
from rowkin.llm._io import stage

from tests.llm.conftest import passage


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows, k, over, under):
    sets = [(d, shingles(t, k)) for d, t in rows]
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if None not in (a, b) and x and y and under * len(x & y) >= over * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted(((d, len(s), (find(d) if s else d) if d is not None else None) for d, s in sets), key=repr)


@pytest.mark.parametrize("k, over, under", [(3, 90, 100), (5, 8, 10)])
def test_join_equals_brute_force(docs, rows, k, over, under):
    got = [tuple(r) for r in ngram_join.join(docs, k, over, under).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=repr) == components(rows, k, over, under)


def test_join_splits_large_roots(docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 2)
    got = [tuple(r) for r in ngram_join.join(docs, 5, 5, 10).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=repr) == components(rows, 5, 5, 10)


def test_join_of_nothing(no_docs):
    assert ngram_join.join(no_docs).count() == 0


def test_keep_one(docs, rows):
    kept = {r["doc_id"] for r in ngram_join.keep_one(docs).collect()}
    expected = {d for d, _, c in components(rows, 5, 8, 10) if d == c}
    assert kept == expected
    assert ngram_join.keep_one(docs).columns == docs.columns


def test_tree_links_what_all_pairs_link():
    rng = np.random.default_rng(7)
    for trial in range(30):
        threshold = ngram_join.Threshold(*((90, 100) if trial % 2 else (8, 10)))
        base = [np.unique(rng.integers(0, 1 << 62, rng.integers(1, 70), dtype=np.uint64)) for _ in range(5)]
        sets = []
        for _ in range(rng.integers(2, 60)):
            own = base[rng.integers(0, 5)]
            own = np.delete(own, rng.integers(0, len(own), min(len(own) - 1, rng.integers(0, len(own) // 4 + 1))))
            sets.append(np.unique(np.append(own, rng.integers(0, 1 << 62, rng.integers(0, 4), dtype=np.uint64))))
        sets.sort(key=len)
        pairs = [(i, j) for j in range(len(sets)) for i in range(j) if threshold.reached(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))]

        def parts(links, n=len(sets)):
            group = list(range(n))
            for i, j in links:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
            return group

        assert parts(ngram_join.linked(sets, None, threshold)) == parts(pairs)


def expected_digests(rows, window=50):
    first = {}
    for d, t in rows:
        w = words(t)
        if d is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group, tree", [(1 << 14, 1 << 20), (2, 300)])
def test_substring_dedup_equals_brute_force(docs, rows, monkeypatch, group, tree):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    monkeypatch.setattr(substring_dedup, "TREE_WORDS", tree)
    got = sorted((tuple(r) for r in substring_dedup.digests(docs).collect()), key=repr)
    assert got == expected_digests(rows)
    assert any(r[2] for r in got)


def test_without_repeats_keeps_columns_and_white_space(docs, rows, no_docs):
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns and substring_dedup.without_repeats(no_docs).count() == 0
    plain = {(d, t) for d, t in rows}
    digests = {(r[0], r[3]): r[2] for r in expected_digests(rows)}
    for r in out.collect():
        kept = hashlib.sha256(" ".join(words(r["text"])).encode()).hexdigest()
        assert (r["doc_id"], kept) in digests
        if not digests[r["doc_id"], kept]:
            assert (r["doc_id"], r["text"]) in plain


def test_words_and_hashes_match_plain_python():
    texts = ["", " ", "a", " a b\tc\n", "é ſ 日本", "A b" * 50, "x\x85y z"]
    column = pa.array(texts)
    from rowkin.llm._io import utf8

    data, offsets = utf8(column)
    hashes, rows, starts, ends = _words.hashed_words(data, offsets, most=8)
    raw = data.tobytes()
    found = [[raw[a:b].decode() for a, b, r in zip(starts, ends, rows, strict=True) if r == i] for i in range(len(texts))]
    assert found == [words(t) for t in texts]
    known = {}
    for h, a, b in zip(hashes.tolist(), starts, ends, strict=True):
        assert known.setdefault(h, raw[a:b]) == raw[a:b]


def test_large_prefixes_are_lengthened(spark, monkeypatch):
    """Passages of 30 to 70 words that many documents quote in words of their own, one long text that quotes them often, and copies."""
    rng = random.Random(11)
    shared = [passage(900 + i, n) for i, n in enumerate((30, 49, 50, 51, 60, 70))]
    rows = []
    for i in range(60):
        parts = [passage(2000 + 7 * i, rng.randrange(0, 40)), *(f"{p} {passage(3000 + 11 * i + j, rng.randrange(0, 9))}" for j, p in enumerate(rng.sample(shared, 3)))]
        rows.append((rng.randrange(1000), " ".join(parts)))
    rows += [(5000, " ".join(p for _ in range(20) for p in rng.sample(shared, 6)))] + [(2000 - i, rows[0][1]) for i in range(8)] + [(rows[1][0], rows[2][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(substring_dedup, "GROUP", 3)
    rounds = []
    monkeypatch.setattr(substring_dedup, "stage", lambda df, name: rounds.append(name) or stage(df, name))
    got = sorted((tuple(r) for r in substring_dedup.digests(docs).collect()), key=repr)
    assert got == expected_digests(rows)
    assert rounds.count("anchors") > 3  # prefixes grew more than twice


@pytest.mark.parametrize("name, value", [("BLOCK_SETS", 4), ("BLOCK_TOKENS", 300), ("BLOCK_TOKENS", 40)])
def test_large_roots_of_near_copies(spark, monkeypatch, name, value):
    """Groups of near copies of several sizes that share rare words with others: all links found in two rounds, whatever the blocks."""
    monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(3)
    rows = []
    for group in range(5):
        base = passage(700 + group, rng.choice((20, 60, 90))).split()
        base[3:5] = ["quoted", "everywhere"]
        for i in range(25):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own[: len(own) - rng.randrange(6)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in ngram_join.join(docs, 2, 7, 10).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=repr) == components(rows, 2, 7, 10)


def test_join_of_a_very_long_text(spark):
    long_text = " ".join(f"w{i % 250_007}x{i % 7}" for i in range(500_000))
    rows = [(1, long_text), (2, long_text + " and more"), (3, "short text of a few words"), (4, long_text[: len(long_text) // 2]), (5, "short text of a few words")]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3}


def test_memory_of_trees_does_not_follow_the_longest_set():
    rng = np.random.default_rng(1)

    def peak(n):
        base = np.unique(rng.integers(0, 1 << 62, 63, dtype=np.uint64))
        sets = [np.unique(np.append(np.delete(base, rng.integers(0, 63)), rng.integers(0, 1 << 62, 2, dtype=np.uint64))) for _ in range(400)]
        sets = sorted([*sets, np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))], key=len)
        tracemalloc.start()
        found = ngram_join.linked(sets, None, ngram_join.Threshold(90, 100))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(found) == 399
        return most

    assert peak(200_000) < peak(100) + (16 << 20)
