"""Pairs for the second scorer, and queries that must not compare nothing."""

import duckdb
import pytest
from rowkin import session
from rowkin.plans import oracles, pipeline


def test_pairs_follow_the_shares_of_countries(spark):
    rows = [("AB"[i % 4 == 0], f"r{i}", f"c{i}", f"text {i // 2}", f"other {i // 2}") for i in range(200)]
    pairs = spark.createDataFrame(rows, "country string, rec_id string, cand_id string, a string, b string")
    got = pipeline.pair_sample(pairs, 20, 12)
    assert got.columns == pairs.columns
    found = got.collect()
    assert len(found) == 32 == len({r["rec_id"] for r in found})
    assert sum(r["country"] == "B" for r in found[:]) == 5 + 3
    assert pipeline.pair_sample(pairs, 500, 500).count() == 200
    assert pipeline.pair_sample(pairs.limit(0), 20, 12).count() == 0


def test_shared_folder_is_named_on_a_cluster():
    class Context:
        def __init__(self, master, path):
            self.master, self.path = master, path

        def getConf(self):
            return {"spark.checkpoint.dir": self.path}

    assert session.shared_folder(Context("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert session.shared_folder(Context("local[4]", None)).startswith("file://")
    with pytest.raises(RuntimeError):
        session.shared_folder(Context("local-cluster[3,2,3000]", None))


@pytest.mark.parametrize("name", ["translit_aligned", "twins_small_cap", "flag_script", "n_to_delete", "sim_common_prefix"])
def test_checked_rows_differ(name):
    con = duckdb.connect()
    for t in "part supplier lineitem nation documents pages".split():
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    rows = con.execute(oracles.ORACLES[name]).fetchall()
    assert len(rows) > 1 and len({r[-1] for r in rows}) > 1
    if name == "twins_small_cap":
        assert len(rows) < len(con.execute(oracles.ORACLES["twins"]).fetchall())
