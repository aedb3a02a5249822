"""Scalar text operators, addresses and similarities against hand-made goldens."""

import random

import pytest
from pyspark.sql import functions as F
from rowkin.functions import address, similarity, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("value, expected", [
    ("  Café-ÜBER №5 ", "cafe uber No5"), ("Joe’s & Sons, L.L.C.", "joe s sons l l c"), (None, ""), ("", ""), ("कि दुकान", "कि दुकान"),
])
def test_clean(spark, value, expected):
    assert one(spark, value, text.clean) == expected


@pytest.mark.parametrize("value, expected", [("0110 Main 000 St 7", ["110", "0", "7"]), (None, []), ("x", []), ("٠١ 2", ["٠١", "2"])])
def test_numbers(spark, value, expected):
    assert one(spark, value, text.numbers) == expected


@pytest.mark.parametrize("value, expected", [("The Acme Co. LLC", "acme"), ("Acme L.L.C.", "acme c l l"), (None, "")])
def test_core(spark, value, expected):
    assert one(spark, value, lambda c: text.core(text.clean(c))) == expected


@pytest.mark.parametrize("value, expected", [("acme l l c", ["llc"]), ("a pvt ltd", ["limited", "private"]), ("x", []), ("xl l co", []), ("acme co", ["co"])])
def test_legal_forms(spark, value, expected):
    assert one(spark, value, text.legal_forms) == expected


@pytest.mark.parametrize("short, word, expected", [("mfg", "manufacturing", True), ("m", "mm", False), ("mg", "mg", False), ("mz", "manufacturing", False), ("a.", "a.b", True)])
def test_abbreviations(spark, short, word, expected):
    row = spark.createDataFrame([(short, word)], "a string, b string").select(text.is_abbreviation(F.col("a"), F.col("b")).alias("y"))
    assert row.first()["y"] == expected == similarity.shortens(short, word)


def test_flags(spark):
    assert [one(spark, v, text.is_dba) for v in ("X d.b.a. Y", "a k a z", "we t/a us", "database", None)] == [True, True, True, False, False]
    assert [one(spark, v, text.is_web) for v in ("www.x", "x.COM", "x.company", None)] == [True, True, False, False]
    assert [one(spark, v, text.web_label) for v in ("Buy at Shop-1.com now", "ab.com", None)] == ["shop-1", "", ""]
    assert [one(spark, v, text.no_latin) for v in ("123", "a", None)] == [True, False, True]
    assert one(spark, None, lambda c: text.no_latin(c, null_counts=False)) is None
    assert one(spark, "12/3", text.lead) == 12


def test_addresses(spark):
    assert address.tokens("Suite #200 12A Oak Rd") == ["suite", "#", "200", "12a", "oak", "rd"]
    goldens = {
        "No. 0110, 40th St": [("premise", "110", "")], "Suite #200 12A Oak Rd": [("unit", "200", ""), ("premise", "12", "a")], "#5 Elm": [("hash", "5", "")],
        "12 / 3 Hwy 09": [("premise", "12/3", ""), ("road", "9", "")], "7ab Lane": [], "221b Baker St": [("premise", "221", "b")],
        "Plot 12 Sector 0045": [("premise", "12", ""), ("area", "45", "")], "Road #7": [("hash", "7", "")], "": [],
    }
    for raw, expected in goldens.items():
        assert address.numbers(raw) == expected
    got = one(spark, "#5 Elm", address.address_digest)
    assert (got["primary_value"], got["primary_suffix"], got["unit"]) == ("5", "", [])
    assert one(spark, "10 Elm #5", address.address_digest)["unit"] == ["5"] and one(spark, None, address.address_digest)["primary_value"] is None


def test_ratios():
    assert similarity.ratio("main st", "maine st") == pytest.approx(93.3333, abs=1e-3) and similarity.ratio("acme", "acme llc") == pytest.approx(66.6667, abs=1e-3)
    assert similarity.ratio("", "") == 100 and similarity.token_set_ratio("", "a") == 0 and similarity.token_set_ratio("a b", "b a c") == 100
    assert similarity.partial_ratio("abc", "xxabcxx") == 100 and similarity.partial_ratio("", "") == 100 and similarity.partial_ratio("", "a") == 0
    assert similarity.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-5) and similarity.jaro_winkler("dwayne", "duane") == pytest.approx(0.84, abs=1e-5)


def test_kernels_against_tables():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab c") for _ in range(rng.randint(0, 9))) for _ in range(2))
        lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                lcs[i + 1][j + 1] = lcs[i][j] + 1 if x == y else max(lcs[i][j + 1], lcs[i + 1][j])
        assert similarity.common_subsequence(a, b) == lcs[-1][-1]
        if a and b:
            best = 0.0
            for short, long_ in [(a, b)] * (len(a) <= len(b)) + [(b, a)] * (len(b) <= len(a)):
                n = len(short)
                windows = [long_[i : i + n] for i in range(len(long_) - n + 1)] + [long_[:i] for i in range(1, n)] + [long_[-i:] for i in range(1, n)]
                best = max([best, *(similarity.ratio(short, w) for w in windows)])
            assert similarity.partial_ratio(a, b) == pytest.approx(best)


def test_alignment():
    assert similarity.align("acme mfg".split(), "acme manufacturing".split()) == ([], [], 0, 1)
    assert similarity.align("ibm".split(), "international business machines".split()) == ([], [], 0, 1)
    assert similarity.align("johnson paint".split(), "jonson pool".split()) == (["paint"], ["pool"], 1, 0)
    assert similarity.best_differing("acme red llc".split(), "acme reed inc".split()) == (pytest.approx(85.714, abs=1e-2), "red", "reed")
    assert similarity.bag_difference(["a", "b", "a"], ["a"]) == ["a", "b"]
