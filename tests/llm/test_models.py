"""Quality classifier, exact top-k search, fingerprints and the pipeline."""

import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from rowkin.llm import fingerprint, quality, topk
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .conftest import passage


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    lines, steps = np.array([3, 1, 4, 2]), rng.normal(size=(2, 2))
    emission = rng.normal(size=lines.sum())
    good, moved, partition = quality.chains(emission, lines, steps)
    at, expected_moves, total = 0, np.zeros((2, 2)), 0.0
    for n in lines:
        own, weight, marginal, moves = emission[at : at + n], 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            w = math.exp(sum(e for e, v in zip(own, y, strict=True) if v) + sum(steps[a, b] for a, b in zip(y, y[1:], strict=False)))
            weight += w
            marginal += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                moves[a, b] += w
        assert np.allclose(good[at : at + n], marginal / weight)
        expected_moves += moves / weight
        total += math.log(weight)
        at += n
    assert np.allclose(moved, expected_moves) and math.isclose(partition, total)


def labelled(spark, n=300):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = "\n".join(passage(1000 + 10 * i + j, 12) + ("!!! $$$ ### ***" if bad else ".") for j in range(rng.randint(1, 6)))
        rows.append((i, text.upper() if bad else text))
        labels += [(i, int(not bad))] if i % 2 else [(i, int(not bad)), (i, int(not bad))]
    labels += [(None, 1), (5, None), (10**6, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_separates_held_out_documents(spark):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r for r in quality.score(docs, labels).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i]["held_out"] for i in held) and sum(r["held_out"] for r in got.values()) == len(held)
    assert np.mean([got[i]["predicted"] == int(i % 4 != 0) for i in held]) > 0.95
    kept = {r["doc_id"] for r in quality.keep_good(docs.withColumn("score", F.lit("clash")), labels).collect()}
    assert kept == {i for i, r in got.items() if r["predicted"]}


def test_quality_on_odd_rows(spark, docs, rows, no_docs):
    _, labels = labelled(spark)
    got = quality.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    none = labels.limit(0)
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5} and quality.score(no_docs, labels).count() == 0
    assert quality.keep_good(docs, none).columns == docs.columns and quality.keep_good(docs, none).count() == len(rows)


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("norm", T.StringType())])


@pytest.mark.parametrize("first, group", [(2048, 16384), (8, 40)])
def test_topk_equals_brute_force(spark, monkeypatch, first, group):
    for name, value in (("FIRST", first), ("GROUP", group), ("BLOCK", 16), ("QUERY_BLOCK", 3), ("SAMPLE", 50)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=12) * rng.choice([0.01, 1.0, 3.0])).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(30)]
    rows += [(400, None), (401, [1.0, None] * 6), (402, [float("nan")] * 12), (403, [float("inf")] * 12), (404, []), (405, [0.0] * 12), (410, [1.0, 2.0]), (411, [0.5, 2.0])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], VECTORS).repartition(3)
    usable = {i: np.floor(1024 * np.array(v, np.float64)).astype(np.int64) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    expected = []
    for q in usable:
        if q % 10 == 0:
            scores = sorted((-int(usable[q] @ v), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))
            expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:10], 1)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(frame, "vec_id % 10 = 0").collect())
    assert got == sorted(expected)
    assert topk.search(frame.limit(0), "vec_id % 10 = 0").count() == 0


def test_fingerprints(spark, docs, rows, no_docs):
    got = fingerprint.fingerprints(docs).collect()
    assert len(got) == len(rows) and fingerprint.fingerprints(no_docs).count() == 0
    clean = [(d, t or "") for d, t in rows if d is not None and d not in (13, 32)]
    by_id = {r["doc_id"]: r for r in got}
    order = sorted((d for d, _ in rows if d is not None), reverse=True)
    texts = dict(clean)
    for a, b in zip(order, order[1:], strict=False):
        if a in texts and b in texts:
            n = len(texts[a])
            edited = texts[a][: n - n // 3] + texts[b][: n // 3]
            assert by_id[a]["n_chars"] == n and by_id[a]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert by_id[10]["fingerprint"] == by_id[11]["fingerprint"] != by_id[12]["fingerprint"]
    assert 0.6 < by_id[31]["near_edited"] < 0.95 and by_id[31]["near_next"] < 0.3 and all(0 <= r["near_next"] <= 1 for r in got)
    assert by_id[11]["near_next"] == 1


def test_ranges_meet_in_order(spark):
    rows = [(i * 3 % 101, f"text {i * 3 % 101}") for i in range(101)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = {r["doc_id"]: r["next"]["text"] for r in fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string"), ["text"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {i: f"text {(i - 1) % 101}" for i in range(101)}


def test_fingerprints_are_homomorphic(spark):
    parts = ["first paragraph of some length, longer than one part of it", "second", "thirdé"]
    rows = [(0, "\n".join(parts)), (1, "\n".join(reversed(parts))), (2, parts[0] + "\n" + parts[2]), (3, parts[1])]
    frame = fingerprint.with_fingerprint(spark.createDataFrame(rows, "id long, text string"), "text", "p")
    p = {r["id"]: r["p"] for r in frame.collect()}
    assert p[0] == p[1]
    both = spark.createDataFrame([(p[0], p[2], p[3])], "whole array<long>, some array<long>, part array<long>")
    got = both.select(fingerprint.inserted(F.col("some"), F.col("part")).alias("a"), fingerprint.deleted(F.col("whole"), F.col("part")).alias("b")).first()
    assert got["a"] == p[0] and got["b"] == p[2]


def test_pipeline_equals_brute_force(spark, docs, rows, no_docs, tmp_path):
    """Every stage against a plain version of it on what its predecessor kept; run() against the stages in turn."""
    from collections import Counter

    import corpus_pipeline
    from tokenizers import Tokenizer

    from .test_dedup import components, expected_digests, words

    _, labels = labelled(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = [docs]
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, kept[-1].limit(0), str(tmp_path)).count() == 0
        step(spark, kept[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        kept.append(spark.read.parquet(f"{tmp_path}/{name}"))
    texts = [[(r["doc_id"], r["text"]) for r in k.collect()] for k in kept[:4]]
    assert all(k.columns == docs.columns for k in kept[:4])
    scores = [(r["doc_id"], r["predicted"]) for r in quality.score(docs, labels).collect()]
    assert Counter(d for d, _ in texts[1]) == Counter(d for d, p in scores if p) and len(texts[1]) < len(rows)
    apart = {d for d, _, c in components(texts[1], 5, 8, 10) if d == c}
    assert {d for d, _ in texts[2]} == apart and len(apart) < len({d for d, _ in texts[1]})
    cut = sorted(((d, hashlib.sha256(" ".join(words(t)).encode()).hexdigest()) for d, t in texts[3]), key=repr)
    assert cut == sorted(((d, sha) for d, _, _, sha in expected_digests(texts[2])), key=repr)
    tokenizer = Tokenizer.from_file(corpus_pipeline.tokenizer_path("byte_bpe_50k.json"))
    expected = Counter()
    for d, t in texts[3]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or min(len(ids), 2048)
        for k, start in enumerate([0, *range(first, len(ids), 2048)]):
            piece = ids[start : start + (2048 if k else first)]
            expected[d, k, start, len(piece), zlib.crc32(piece.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in kept[4].collect()) == expected == Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())


def test_topk_of_large_values(spark, caplog):
    """Exact beyond doubles' integers; scores beyond a long are its limits; what overflows after scaling takes no part."""
    rows = [(10, [1e20, 1.0]), (11, [1e20, 0.5]), (12, [-1e20, 0.0]), (13, [3.0, 1.0]), (14, [2.0**40, 1.0]), (20, [2.0**40, -1.0]), (21, [1e308, 1.0]), (22, [1e200, 1.0]), (30, [0.0, 0.0])]
    usable = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i != 21}
    expected = []
    for q in (10, 20, 30):
        scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(usable[q], v, strict=True)))), i) for i, v in usable.items() if i != q)
        expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:4], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(frame, "vec_id % 10 = 0", k=4).collect()) == expected


def test_topk_prunes_before_the_shuffle(spark, monkeypatch, caplog):
    for name, value in (("FIRST", 40), ("GROUP", 20), ("BLOCK", 8), ("QUERY_BLOCK", 4), ("VISITS", 2)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=8) / (1 + i % 25)).tolist()) for i in range(600)]
    usable = {i: np.floor(1024 * np.array(v)).astype(np.int64) for i, v in rows}
    expected = [(q, rank, i, -s) for q in usable if q % 7 == 0 for rank, (s, i) in enumerate(sorted((-int(usable[q] @ v), i) for i, v in usable.items() if i != q)[:3], 1)]
    with caplog.at_level("INFO", logger=topk.__name__):
        got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 7 = 0", k=3).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(expected)
    met, pairs = caplog.records[-1].args
    assert 0 < met < pairs / 2


def plain_print(text):
    """The fingerprint's sums and counters in plain Python."""
    found = re.findall(fingerprint.PART, text)
    pairs = [(xxhash.xxh64_intdigest(p.encode(), 42), p) for p in found]
    hashes = [[h for h, _ in pairs], [xxhash.xxh64_intdigest(struct.pack("<i", 1), h) for h, _ in pairs]]
    counts = [sum(h >> bit & 1 for h in own) for own in hashes for s in range(fingerprint.STEP) for bit in (s, s + fingerprint.STEP)]
    return len(found), [sum(h >> shift & 0xFFFFFFFF for h in own) for own in hashes for shift in (0, 32)], [2 * c - len(found) for c in counts]


def test_fingerprint_query_equals_brute_force(spark):
    """All documents of the smallest tables: fingerprints, edited texts and both likenesses."""
    from rowkin.llm import queries

    rows = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()), reverse=True)
    got = {r["doc_id"]: r for r in queries.op9_fingerprint(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)

    def shown(p):
        lanes = [p[2][i] + p[0] for i in range(len(p[2]))]
        longs = [(lanes[i] // 2) | (lanes[i + 1] // 2) << fingerprint.STEP for i in range(0, len(lanes), 2)]
        return "".join(f"{x:016x}" for x in [p[0], *p[1], *longs])

    def alike(a, b):
        norms = sum(x * x for x in a) + sum(x * x for x in b)
        return max(0.0, min(1.0, 2 * sum(x * y for x, y in zip(a, b, strict=True)) / norms)) if norms else 1.0

    prints = {d: plain_print(t) for d, t in rows}
    for (d, t), (e, following) in zip(rows, [*rows[1:], rows[0]], strict=True):
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        own, changed = prints[d], plain_print(edited)
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (shown(own), shown(changed))
        assert math.isclose(r["near_edited"], alike(own[2], changed[2]), abs_tol=1e-9) and math.isclose(r["near_next"], alike(own[2], prints[e][2]), abs_tol=1e-9)


def test_counters_do_not_carry(spark):
    """More equal lines than 20 bits count: every counter is the number of lines, or minus it."""
    n = (1 << 20) + 5
    frame = spark.range(1).select(F.concat(F.repeat(F.lit("a\n"), n), F.lit("b")).alias("text"), F.repeat(F.lit("a\n"), n).alias("other"))
    frame = fingerprint.with_fingerprint(fingerprint.with_fingerprint(frame, "text", "p"), "other", "q")
    row = frame.select(fingerprint.counters(F.col("p")).alias("a"), fingerprint.counters(F.col("q")).alias("b"), fingerprint.likeness(fingerprint.counters(F.col("p")), fingerprint.counters(F.col("q"))).alias("l")).first()
    assert {abs(x) for x in row["b"]} == {n} and max(abs(x) for x in row["a"]) <= n + 1 and row["l"] > 0.999


def test_parts_follow_their_words(spark):
    """A letter put in front of a long line changes the parts near it alone."""
    line = passage(77, 2000)
    frame = spark.createDataFrame([(line, "x" + line)], "a string, b string")
    frame = fingerprint.with_fingerprint(fingerprint.with_fingerprint(frame, "a", "p"), "b", "q")
    assert frame.select(fingerprint.likeness(fingerprint.counters(F.col("p")), fingerprint.counters(F.col("q")))).first()[0] > 0.9
