"""Decision rule, test-like training and sources on small hand-made tables."""

import pytest
from rowkin import schema
from rowkin.operators import blocking, testlike, translit
from rowkin.plans import decision
from rowkin.sources import tsv

PAIRS = "country string, rec string, cand string, rnk int, prob double, y boolean"


def pairs(spark, rows):
    return spark.createDataFrame([("X", *r) for r in rows], PAIRS)


def test_decide_takes_the_first_of_ties(spark):
    rows = pairs(spark, [("r", "a", 0, 0.9, True), ("r", "b", 1, 0.9, False), ("s", "a", 0, 0.1, False)])
    assert [(r["rec"], r["cand"]) for r in decision.decide(rows, 0.5).collect()] == [("r", "a")]


def test_drawbridge(spark):
    rows = pairs(spark, [("r1", "a", 0, 0.8, True), ("r2", "a", 0, 0.7, True), ("r3", "a", 0, 0.3, False), ("r4", "b", 0, 0.4, False)])
    rules = spark.createDataFrame([("X", 0.5, 0.8)], "country string, floor double, factor double")
    assert {r["rec"] for r in decision.drawbridge(rows, rules).collect()} == {"r1", "r2"}


@pytest.mark.parametrize("k, tp, fp, expected", [(2, 1, 0, 0.833333), (0, 0, 0, 1), (0, 0, 1, 0), (1, 1, 1, 0.555556), (3, 0, 0, 0)])
def test_f_score(spark, k, tp, fp, expected):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(k, tp, fp)], "k int, tp int, fp int").select(decision.f_score(F.col("tp"), F.col("fp"), F.col("k")).alias("f"))
    assert row.first()["f"] == pytest.approx(expected, abs=1e-6)


def test_safe_range(spark):
    rows = spark.createDataFrame([("X", i / 10, f) for i, f in enumerate([0.1, 0.9, 0.9005, 0.8])], "country string, bar double, f05 double")
    r = decision.safe_range(rows, "bar").first()
    assert (r["safe_lo"], r["safe_hi"]) == (0.1, 0.2)


def test_grids():
    assert (len(decision.FLOORS), len(decision.FACTORS), len(decision.BARS)) == (31, 11, 27) and decision.FLOORS[-1] == 0.9 and decision.BARS[-1] == 0.95


def test_count_bar(spark):
    rows = pairs(spark, [(f"r{i}", f"c{i}", 0, p, True) for i, p in enumerate([0.9, 0.8, 0.7])])
    rules = spark.createDataFrame([("X", 0.5, 0.5, 1.0), ("Y", 0.5, 0.5, 1.0)], "country string, floor double, factor double, target double")
    two = spark.createDataFrame([("X", "c0"), ("X", "c1"), ("Y", "z")], "country string, cand string")
    assert {r["country"]: r["bar"] for r in decision.count_bar(rows, rules, two).collect()} == {"X": 0.8, "Y": 1.0}


def test_floors_only_lower_matches(spark):
    rows = pairs(spark, [(f"r{i}", f"c{i % 7}", 0, (i * 37 % 100) / 100, i % 3 == 0) for i in range(60)])
    kept = [decision.drawbridge(rows, spark.createDataFrame([("X", f, 0.8)], "country string, floor double, factor double")).count() for f in (0.3, 0.6, 0.9)]
    assert kept == sorted(kept, reverse=True)


def test_counts_to_delete():
    assert testlike.n_to_delete(1000, 4700, 1000, 5800) == 190 and testlike.n_to_delete(10, 5, 0, 0) == 0


def test_compact(spark):
    short = spark.createDataFrame([("X", "r", 4, 0, 0.9), ("X", "r", 2, 1, 0.8), ("X", "r", 7, 2, 0.7)], "country string, rec_id string, cand_id int, rank int, score double")
    gone = spark.createDataFrame([(4,)], "cand_id int")
    assert [(r["cand_id"], r["rank"]) for r in blocking.compact(short, gone).orderBy("rank").collect()] == [(2, 0), (7, 1)]
    assert blocking.compact(short, gone.limit(0)).count() == 3


def test_twin_deletions_leave_one_of_each_pair(spark):
    rows = [("X", f"a{i}", f"a{j}", "core", "street") for i in range(5) for j in range(i + 1, 5)]
    twins = spark.createDataFrame(rows, "country string, id string, id_b string, core string, street string")
    gone = {r["id"] for r in testlike.twin_deletions(twins).collect()}
    assert len(gone) == 4 and gone == {r["id"] for r in testlike.twin_deletions(twins.repartition(3)).collect()}


def test_two_owners_fail(spark):
    truth = spark.createDataFrame([("a", "r"), ("b", "r")], schema.PAIRS)
    ids = spark.createDataFrame([("r",)], "entity_id string")
    with pytest.raises(ValueError, match="more than one owner"):
        testlike.owners(ids, truth, ids)


def test_shortlist_equals_brute_cosine(spark):
    import math
    from collections import Counter

    s1 = [("X", i, t) for i, t in enumerate(["red apple pie", "green apple", "blue sky inn", "apple apple", ""])]
    records = [("X", 100 + i, t) for i, t in enumerate(["red apples", "sky inn blue", "zzz", "apple", "apple", "", "a"])]

    def grams(t):
        return Counter(f" {w} "[i : i + 3] for w in t.split() for i in range(len(w)))

    every = [grams(t) for _, _, t in s1 + records]
    df = Counter(g for x in every for g in x)
    idf = {g: math.log((1 + len(every)) / (1 + n)) + 1 for g, n in df.items() if n >= 2}

    def vector(t):
        w = {g: n * idf[g] for g, n in grams(t).items() if g in idf}
        size = math.sqrt(sum(v * v for v in w.values()))
        return {g: v / size for g, v in w.items()}

    expected = []
    for _, r, t in records:
        scores = [(-round(sum(v * vector(u).get(g, 0) for g, v in vector(t).items()), 9), str(s)) for _, s, u in s1]
        expected += [(str(r), s, k, -score) for k, (score, s) in enumerate(sorted(x for x in scores if x[0] < 0)[:3])]
    frames = [spark.createDataFrame(x, "country string, id int, n string") for x in (s1, records)]
    got = [(r["rec_id"], r["cand_id"], r["rank"], r["score"]) for r in blocking.shortlist(*frames, ["n"]).collect()]
    assert [(a[:3], round(a[3], 7)) for a in sorted(got)] == [(a[:3], round(a[3], 7)) for a in sorted(expected)]


def test_romanise(spark):
    table = spark.createDataFrame([("दुकान", "shop"), ("कि", "")], "script string, latin string")
    rows = spark.createDataFrame([("1", "दुकान कि राम"), ("2", "Plain Name"), ("3", None)], "entity_id string, business_name string")
    got = {r["entity_id"]: r["latin"] for r in translit.romanise(rows, "business_name", table, "entity_id", "latin").collect()}
    assert got["1"].startswith("shop ki ") and got["2"] == "Plain Name" and got["3"] == ""
    assert translit.ascii_letters("राम") == "raama"


def test_tsv_round_trip(spark, tmp_path):
    path = tmp_path / "train_source1.tsv"
    path.write_text('entity_id\tmore\tbusiness_name\tbusiness_address\tcountry\nS1-1\tx\ta "quoted\r name\t\tUS\nS1-2\tx\tb\tc\tIN\n', newline="")
    rows = tsv.read_source(spark, str(path)).collect()
    assert [(r["entity_id"], r["business_address"]) for r in rows] == [("S1-1", None), ("S1-2", "c")] and '"' in rows[0]["business_name"]
    with pytest.raises(tsv.SourceError):
        tsv.read_source(spark, str(path), schema.TRUTH)
    ids = spark.createDataFrame([("S1-2", 0), ("S1-1", 1), ("S1-3", 2)], "entity_id string, position int")
    found = spark.createDataFrame([("S1-1", "S3-9"), ("S1-1", "S2-1")], schema.PAIRS)
    digest = tsv.write_outputs(ids, found, found, str(tmp_path / "out")).collect()
    assert [(r["rows"], r["filled"], r["ids"]) for r in digest] == [(3, 1, 2)] * 2
    lines = [line for f in sorted((tmp_path / "out" / "matching_results").glob("part-*")) for line in f.read_text().splitlines() if not line.startswith("source1")]
    assert lines == ["S1-2\t", "S1-1\tS2-1,S3-9", "S1-3\t"]
    with pytest.raises(tsv.SourceError, match="match_outside"):
        tsv.write_outputs(ids, found, found.limit(1), str(tmp_path / "out"))
