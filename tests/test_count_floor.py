"""Count-based floors, bar curves, saved models: against plain Python."""

import random

import pytest
from pyspark.sql import functions as F
from rowkin.plans import decision, models


def scored_pairs(seed, n, scores):
    r = random.Random(seed)
    return [("X", i, r.randrange(12), 0, r.choice(scores), r.random() < 0.5) for i in range(n)]


PAIRS = "country string, rec long, cand long, rnk int, prob double, y boolean"
CROWDED = [0.0, 1e-9, 0.2, 0.5, 0.500001, 0.9, 0.999999, 1.0 - 1e-9, 1.0] + [0.7 + i * 1e-6 for i in range(40)]


@pytest.mark.parametrize("target", [0.0, 0.4, 1.5, 3.0, 8.3, 1000.0])
def test_count_floor_is_the_nearest(spark, target):
    rows = scored_pairs(3, 150, CROWDED)
    pairs = spark.createDataFrame(rows, PAIRS)
    businesses = spark.createDataFrame([("X", c, 0) for c in range(12)], "country string, cand long, k long")
    got = decision.count_floor(pairs, spark.createDataFrame([("X", 0.5, target)], "country string, factor double, target double"), businesses)
    tops = {}
    for _, _, cand, _, prob, _ in rows:
        tops[cand] = max(prob, tops.get(cand, 0.0))
    kept = [tops[r[2]] for r in rows if r[4] >= 0.5 * tops[r[2]]]
    best = min(set(tops.values()), key=lambda t: (round(abs(sum(x >= t for x in kept) - target * 12), 9), -t))
    assert [r["floor"] for r in got.collect()] == [best]


def test_bar_curve_at_every_bar(spark):
    rows = scored_pairs(5, 200, [i / 40 for i in range(41)])
    held = {c: sum(1 for r in rows if r[2] == c and r[5]) * (c % 3 > 0) for c in range(15)}
    businesses = spark.createDataFrame([("X", c, k) for c, k in held.items()], "country string, cand long, k long")
    rules = spark.createDataFrame([("X", 0.0, 0.0)], "country string, floor double, factor double")
    got = {r["bar"]: r["f05"] for r in decision.bar_curve(spark.createDataFrame(rows, PAIRS), businesses, rules).collect()}
    assert sorted(got) == decision.BARS
    for bar, value in got.items():
        total = 0.0
        for c, k in held.items():
            mine = [r[5] for r in rows if r[2] == c and r[4] >= bar]
            tp, fp = sum(mine), len(mine) - sum(mine)
            total += 1.0 if k == 0 and fp == 0 else 1.25 * tp / (1.25 * tp + 0.25 * (k - tp) + fp)
        assert value == pytest.approx(total / len(held), abs=1e-8)


def test_second_scorer_is_read_again(spark, tmp_path):
    rows = [(f"north mill {i}", f"north mill {i if i % 2 else i + 7}", i % 2) for i in range(30)]
    pairs = spark.createDataFrame(rows, "a string, b string, y int")
    path = str(tmp_path / "second")
    first = models.text_scorer(64, 5, path)(pairs)(pairs, "s").orderBy("a").collect()
    flipped = pairs.withColumn("y", 1 - F.col("y"))  # a model that is there is not fitted again
    assert models.text_scorer(64, 5, path)(flipped)(pairs, "s").orderBy("a").collect() == first
    assert not (tmp_path / "second.part").exists()
