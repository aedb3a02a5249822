"""Document frequencies cover all records unless a sample is asked for."""

import inspect

from rowkin.operators import blocking


def test_all_records_fit_by_default(spark):
    for f in (blocking.fit_rows, blocking.vectors, blocking.shortlist):
        assert all(p.default is None for n, p in inspect.signature(f).parameters.items() if n in ("size", "sample"))
    s1 = spark.createDataFrame([("X", 1, "aaa")], "country string, id long, n string")
    records = spark.createDataFrame([("X", 10 + i, "aaa bbb") for i in range(9)], "country string, id long, n string")
    assert blocking.fit_rows(records).count() == 9 and blocking.fit_rows(records, 4).count() == 4
    got = {(r["id"], r["gram"]) for r in blocking.vectors(s1, records, ["n"]).collect()}
    assert len({i for i, _ in got}) == 10 and all((10 + i, "bbb") in got for i in range(9))
    assert blocking.shortlist(s1, records, ["n"]).count() == 9 == blocking.shortlist(s1, records, ["n"], sample=4).count()


def test_large_inputs_are_not_sampled(spark):
    """More records of one country than the former sample of a million: all of them fit."""
    records = spark.range(1_000_500).selectExpr("'X' as country", "id")
    assert blocking.fit_rows(records).count() == 1_000_500
