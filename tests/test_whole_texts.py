"""The blocking queries over whole documents, against brute force on a small fixture."""

import math
import random
from collections import Counter

from rowkin.plans import queries

SAME = "the opening words of every document here are the same sixty characters or more "


def documents(spark, tmp_path) -> list[tuple[int, str]]:
    """Documents that differ from character 80 on; 1 continues as 4 does, 2 as 8 does."""
    rng = random.Random(7)
    tails = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)) for _ in range(3)]
    rows = [(0, SAME + tails[0]), (4, SAME + tails[1]), (8, SAME + tails[2]), (1, SAME + tails[1]), (2, SAME + tails[2] + " more"), (3, "other text")]
    spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    return rows


def grams(text):
    return Counter(f" {w} "[i : i + 3] for w in text.split() for i in range(len(w)))


def vectors(rows):
    df = Counter(g for _, t in rows for g in grams(t))
    idf = {g: math.log((1 + len(rows)) / (1 + n)) + 1 for g, n in df.items() if n >= 2}
    out = {}
    for i, t in rows:
        w = {g: n * idf[g] for g, n in grams(t).items() if g in idf}
        size = math.sqrt(sum(v * v for v in w.values()))
        out[i] = {g: v / size for g, v in w.items()}
    return df, out


def test_shortlist_of_whole_texts(spark, tmp_path):
    rows = documents(spark, tmp_path)
    _, unit = vectors(rows)
    expected = {}
    for r in (1, 2, 3):
        scores = [(-sum(v * unit[s].get(g, 0) for g, v in unit[r].items()), s) for s in (0, 4, 8)]
        expected |= {(r, s, k): -x for k, (x, s) in enumerate(sorted(scores)) if x < 0}
    got = {(r["rec_id"], r["cand_id"], r["rank"]): r["score"] for r in queries.QUERIES["topk_shortlist"](spark, str(tmp_path)).collect()}
    assert set(got) == set(expected) and all(abs(got[k] - expected[k]) < 1e-6 for k in got)
    assert (1, 4, 0) in got and (2, 8, 0) in got


def test_statistics_of_whole_texts(spark, tmp_path):
    rows = documents(spark, tmp_path)
    df, unit = vectors(rows)
    idf = {r["gram"]: r["df"] for r in queries.QUERIES["gram_idf"](spark, str(tmp_path)).collect()}
    assert idf == {g: n for g, n in df.items() if n >= 2}
    norms = {r["id"]: r["grams"] for r in queries.QUERIES["gram_norms"](spark, str(tmp_path)).collect()}
    assert norms == {i: len(w) for i, w in unit.items() if w}
