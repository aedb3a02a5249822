"""Packing, BPE and language-model scores."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rowkin.llm import _chunks, bpe, language_model, packing

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
TEXT = st.text(st.sampled_from("ab'sStTrRevEmMlLdD  \n\t 12½²ªéÉßΣς.,!?-_<|中字かİ😀́\x1c\x85٣"), max_size=40)


@pytest.fixture(scope="module")
def byte_tokenizer():
    return tokenizers.Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word_tokenizer():
    return tokenizers.Tokenizer.from_file(WORD)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_byte_ids_equal_the_library(texts):
    tokenizer = tokenizers.Tokenizer.from_file(BYTE) if not hasattr(test_byte_ids_equal_the_library, "t") else test_byte_ids_equal_the_library.t
    test_byte_ids_equal_the_library.t = tokenizer
    ids, at = packing.encode_rows(pa.array(texts), BYTE)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_word_ids_and_decoding_equal_the_library(texts):
    tokenizer = test_word_ids_and_decoding_equal_the_library.__dict__.setdefault("t", tokenizers.Tokenizer.from_file(WORD))
    coder = bpe.coder(WORD)
    for text, (ids, decoded) in zip(texts, coder.encode_many(texts), strict=True):
        expected = tokenizer.encode(text, add_special_tokens=False).ids
        assert [int(x) for x in ids.split()] == expected == coder.encode(text)
        assert decoded == tokenizer.decode(expected, skip_special_tokens=False) == coder.decode(expected)


def test_long_fragments_merge_alike(byte_tokenizer):
    rng = random.Random(5)
    texts = ["a" * 3000, "ab" * 900, "".join(rng.choice("aeiouthn") for _ in range(4000)), "é" * 500]
    ids, at = packing.encode_rows(pa.array(texts), BYTE)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [byte_tokenizer.encode(t).ids for t in texts]


def test_bpe_query_on_odd_rows(docs, rows, no_docs, word_tokenizer):
    expected = []
    for d, t in rows:
        ids = word_tokenizer.encode(t or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), word_tokenizer.decode(ids, skip_special_tokens=False))]
        expected.append((d, len(ids), *sha))
    assert sorted((tuple(r) for r in bpe.encode_digests(docs, WORD).collect()), key=repr) == sorted(expected, key=repr)
    whole = {(r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in bpe.encode(docs, WORD).collect()}
    assert (5, 2, tuple(word_tokenizer.encode("Two Words").ids[1:-1] or word_tokenizer.encode("Two Words", add_special_tokens=False).ids)) in whole
    assert bpe.encode_digests(no_docs, WORD).count() == 0


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(docs, rows, no_docs, byte_tokenizer, capacity):
    got = packing.pack(docs, BYTE, capacity).collect()
    expected = Counter()
    for d, t in rows:
        ids = np.array([*byte_tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert len(ids) <= 2**20
        for k, (s, n) in enumerate(packing.cut(len(ids), capacity)):
            assert n == capacity or k == 0
            expected[d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    bins: dict = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    lengths = Counter(r["length"] for r in got)
    assert packing.least_sequences(lengths, capacity) <= len(bins) <= packing.least_sequences(lengths, capacity) + 2
    assert packing.pack(no_docs, BYTE).count() == 0


def test_fullest_bin_is_the_fullest():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        taken = packing.fullest(counts, 40)
        assert all(counts[n] >= c for n, c in taken.items()) and max(counts) in taken
        items = [n for n, c in counts.items() for _ in range(c)]
        items.remove(max(counts))
        sums = {0}
        for n in items:
            sums |= {s + n for s in sums}
        assert sum(n * c for n, c in taken.items()) == max(counts) + max(s for s in sums if s <= 40 - max(counts))


def brute_scores(rows, order=2, alpha=0.4):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for _, t in rows]
    grams = [[Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for n in range(1, order + 1)] for w in texts]
    total = [sum((g[n] for g in grams), Counter()) for n in range(order)]
    n_words, out = sum(map(len, texts)), []
    for (d, _), w, own in zip(rows, texts, grams, strict=True):
        score = backed = unseen = 0
        for i in range(len(w)):
            most = min(i, order - 1)
            for n in range(most, -1, -1):
                gram = tuple(w[i - n : i + 1])
                c = total[n][gram] - own[n][gram]
                if n and c > 0:
                    score += math.log(c / (total[n - 1][gram[:-1]] - own[n - 1][gram[:-1]])) + (most - n) * math.log(alpha)
                    break
                if not n:
                    score += math.log(max(c, 1) / max(1, n_words - len(w))) + most * math.log(alpha)
                    unseen += c < 1
            backed += n < most
        out.append((d, len(w), round(score / len(w), 6) if w else None, backed, unseen))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_equals_brute_force(docs, rows, no_docs, monkeypatch, order):
    monkeypatch.setattr(_chunks, "PARTITION_WORDS", 700)
    got = [(r[0], r[1], None if r[2] is None else round(r[2], 6), r[3], r[4]) for r in language_model.score(docs, order).collect()]
    expected = brute_scores(rows, order)
    assert len(got) == len(expected)
    for a, b in zip(sorted(got, key=repr), sorted(expected, key=repr), strict=True):
        assert a[:2] == b[:2] and a[3:] == b[3:] and (a[2] == b[2] or math.isclose(a[2], b[2], abs_tol=2e-6))
    assert language_model.score(no_docs).count() == 0


def test_classes_of_all_code_points_are_the_library_s():
    """Every assigned plane, between letters, digits and symbols, against the library with the word vocabulary."""
    import public_tokenizers
    from rowkin.llm import bpe
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    known, library = bpe.coder(path), Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    texts = [f"ab{chr(i)}9!{chr(i)}x" for i in (*range(0xD800), *range(0xE000, 0x34000), *range(0xE0000, 0xE0400))]
    for (ids, _), wanted in zip(known.encode_many(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids == " ".join(map(str, wanted.ids))
