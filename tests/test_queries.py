"""Every registered query against DuckDB on the smallest tables, and the end-to-end pipeline on noised copies."""

import math
import os

import duckdb
import pytest
from rowkin import fixtures
from rowkin.plans import oracles, pipeline, queries
from rowkin.sources import tsv

SF = "/root/testdata/sf0.001"
TABLES = "part supplier lineitem nation documents pages".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    return None if isinstance(value, float) and math.isnan(value) else round(float(value), 6) + 0.0


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    expected = duck.execute(oracles.ORACLES[name])
    names = [d[0] for d in expected.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, got.collect()) == rows_of(names, expected.fetchall())


@pytest.mark.parametrize("name", ["sim_token_set", "word_align", "best_word_pair", "address_parse", "model_stacker", "deleted_twins"])
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_all_features_are_there(spark):
    from rowkin.operators.features import FEATURES

    rows = queries.QUERIES["features_all"](spark, SF)
    assert len(FEATURES) == 78 and rows.columns == ["country", "rec_id", "cand_id", *FEATURES]
    assert all(v is not None for r in rows.collect() for v in r)


def test_end_to_end(spark, tmp_path):
    """Train on three quarters of the businesses, link the rest, and check the outputs against the known owners."""
    s1 = fixtures.p_s1(spark, SF).withColumnRenamed("k", "owner_k")
    other = fixtures.p_ot(spark, SF)
    names = ["entity_id", "business_name", "business_address", "country"]
    for split, keep in (("train", "coalesce(owner_k, 1) % 4 <> 0"), ("test", "coalesce(owner_k, 0) % 4 = 0")):
        parts = {"source1": s1.filter(keep), "source2": other.filter(f"entity_id like 'S2%' and {keep}"), "source3": other.filter(f"entity_id like 'S3%' and {keep}")}
        truth = spark.sql(fixtures.P_TRUTH, p_ot=other.filter(keep))
        lists = tsv.id_lists(parts["source1"].select("entity_id"), truth, "matched_entity_ids").withColumnRenamed("entity_id", "source1_entity_id")
        for name, frame in {**{k: v.select(*names) for k, v in parts.items()}, "ground_truth": lists}.items():
            path = tmp_path / split / f"{split}_{name}.tsv"
            path.parent.mkdir(exist_ok=True)
            lines = ["\t".join(frame.columns)] + ["\t".join(v or "" for v in r) for r in frame.collect()]
            path.write_text("\n".join(lines) + "\n")
    settings = pipeline.Settings(held_out=0.4, evaluation=1.0, cheap_rounds=3, cheap_least=2, tree_rounds=3, tree_least=2, pair_first=200, pair_more=100)
    args = (spark, str(tmp_path), str(tmp_path / "out"), str(tmp_path / "work"), settings)
    digests = {r["file"]: r for r in pipeline.run(*args).collect()}
    assert digests["matching_results"]["rows"] == 50 and digests["matching_results"]["ids"] <= digests["candidate_pairs"]["ids"]
    matches = [
        line.split("\t") for f in (tmp_path / "out" / "matching_results").glob("part-*") for line in f.read_text().splitlines() if not line.startswith("source1")
    ]
    owner = {r["entity_id"]: f"S1-{r['owner_k']}" for r in other.collect() if r["owner_k"] is not None}
    found = [(a, b) for a, ids in matches for b in ids.split(",") if b]
    assert found and sum(owner.get(b) == a for a, b in found) / len(found) > 0.6
    assert {r["file"]: r["sha256"] for r in pipeline.run(*args).collect()} == {k: r["sha256"] for k, r in digests.items()}
