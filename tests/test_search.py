"""The block search against brute force, where few columns, copies, ties and several blocks put its bounds to use."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from rowkin.operators import blocking, search


def grams(text):
    return Counter(f" {w} "[i : i + 3] for w in text.split(" ") if w for i in range(len(w)))


@pytest.mark.parametrize("columns", [2, 16, 4096])
def test_best_of_blocks(monkeypatch, columns):
    monkeypatch.setattr(search, "COLUMNS", columns)
    monkeypatch.setattr(search, "PRODUCT_ROWS", 7)
    rng = random.Random(3)
    texts = [tuple(" ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, n))) for n in (9, 4)) for _ in range(120)]
    texts = sorted(set(texts))
    rows = [(str(i).encode(), str(i) if i % 3 == 0 else None, int(i % 3 == 0), int(i % 3 > 0), 1, *t) for i, t in enumerate(texts)]
    chunks = [search.chunk("X", rows[i : i + 25]) for i in range(0, len(rows), 25)]
    df = Counter()
    for c in chunks:
        for g, n in zip(*c["grams"], strict=True):
            df[int(g)] += int(n)
    known = np.array(sorted(g for g, n in df.items() if n >= 2))
    idf = np.array([math.log((1 + len(rows)) / (1 + df[g])) + 1 for g in known])
    plain = Counter((p, g) for t in texts for p in range(2) for g in grams(t[p]))
    weight = {g: math.log((1 + len(rows)) / (1 + n)) + 1 for g, n in plain.items() if n >= 2}
    assert len(weight) == len(known)

    def unit(text, p):
        w = {g: n * weight[p, g] for g, n in grams(text).items() if (p, g) in weight}
        size = math.sqrt(sum(v * v for v in w.values()))
        return {g: v / size for g, v in w.items()}

    units = [[unit(t[p], p) for p in range(2)] for t in texts]
    sides = [{s: search.Texts(c[s], c["grams"][0], known, idf, 2) for s in ("ours", "theirs")} for c in chunks]
    blocks = [search.Block([s["ours"] for s in part]) for part in (sides[:2], sides[2:])]
    for side in sides:
        best = [[] for _ in side["theirs"].keys]
        for block in blocks:
            search.improve(best, side["theirs"], block, 3, 2, 9)
        for key, own in zip(side["theirs"].keys, best, strict=True):
            r = int(key)
            scores = [(sum(sum(v * units[s][p].get(g, 0) for g, v in units[r][p].items()) for p in range(2)) / 2, s) for s in range(0, len(texts), 3)]
            expected = sorted((-round(x, 9), str(s)) for x, s in scores if x > 0)[:3]
            assert [b[1] for b in own] == [e[1] for e in expected]
            assert all(abs(b[0] - e[0]) < 2e-9 for b, e in zip(own, expected, strict=True))


def test_no_row_per_pair_and_gram(spark):
    """Pairs are summed within blocks: no join of the two sides' grams and no aggregate over pairs."""
    s1 = spark.createDataFrame([("X", i, f"aaa bbb {i % 7}") for i in range(40)], "country string, id long, n string")
    records = spark.createDataFrame([("X", 100 + i, f"aaa ccc {i % 5}") for i in range(60)], "country string, id long, n string")
    found = blocking.shortlist(s1, records, ["n"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "MapInArrow" in plan and "sum((w_r" not in plan
    rows = found.collect()
    assert len(rows) == 180 and {r["cand_id"] for r in rows if r["rec_id"] == "100"} == {"0", "14", "21"}
