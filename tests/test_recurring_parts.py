"""Texts whose names and addresses recur: products are made for distinct parts alone, and the best stay exact over several blocks."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from rowkin.operators import search

from tests.test_search import grams


@pytest.mark.parametrize("first", [1, 8, 2048])
def test_products_of_distinct_parts(monkeypatch, first):
    monkeypatch.setattr(search, "FIRST_ROWS", first)
    monkeypatch.setattr(search, "PRODUCT_ROWS", 5)
    rng = random.Random(5)
    names, addresses = (["".join(rng.choice("abc") for _ in range(rng.randint(2, 7))) for _ in range(n)] for n in (6, 9))
    texts = sorted({(n, a) for n in names for a in [*addresses, ""] if rng.random() < 0.8})
    rows = [(str(i).encode(), str(i) if i % 2 == 0 else None, int(i % 2 == 0), int(i % 2 > 0), 1, *t) for i, t in enumerate(texts)]
    chunks = [search.chunk("X", rows[i : i + 12]) for i in range(0, len(rows), 12)]
    df = Counter()
    for c in chunks:
        for g, n in zip(*c["grams"], strict=True):
            df[int(g)] += int(n)
    known = np.array(sorted(df))
    idf = np.array([math.log((1 + len(rows)) / (1 + df[g])) + 1 for g in known])
    weight = Counter((p, g) for t in texts for p in range(2) for g in grams(t[p]))

    def unit(text, p):
        w = {g: n * (math.log((1 + len(rows)) / (1 + weight[p, g])) + 1) for g, n in grams(text).items()}
        size = math.sqrt(sum(v * v for v in w.values()))
        return {g: v / size for g, v in w.items()}

    units = [[unit(t[p], p) for p in range(2)] for t in texts]
    sides = [{s: search.Texts(c[s], c["grams"][0], known, idf, 2) for s in ("ours", "theirs")} for c in chunks]
    blocks = [search.Block([s["ours"] for s in part]) for part in (sides[:2], sides[2:])]
    for block, part in zip(blocks, (texts[:24], texts[24:]), strict=True):
        assert [len(beside) for _, beside, _ in block.sides] == [len({t[p] for t in part[::2]}) for p in range(2)]
    for side in sides:
        best = [[] for _ in side["theirs"].keys]
        for block in blocks:
            search.improve(best, side["theirs"], block, 3, 2, 9)
        for key, own in zip(side["theirs"].keys, best, strict=True):
            r = int(key)
            scores = [(sum(sum(v * units[s][p].get(g, 0) for g, v in units[r][p].items()) for p in range(2)) / 2, s) for s in range(0, len(texts), 2)]
            assert [b[1] for b in own] == [e[1] for e in sorted((-round(x, 9), str(s)) for x, s in scores if x > 0)[:3]]
