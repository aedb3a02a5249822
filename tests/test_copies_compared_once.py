"""Entities of one content are compared once: what the string kernels see grows with distinct contents, not with copies."""

from pyspark.sql import functions as F
from rowkin.operators import features, translit

SOURCE = "entity_id string, business_name string, business_address string"


def test_copies_share_comparisons(spark, monkeypatch):
    made = []

    def staged(rows, kept=features.staged):
        out = kept(rows)
        made.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(features, "staged", staged)
    names = [("red mill llc", "12 Elm St #5"), ("blue mill", None), ("blue mill", "")]  # no address isn't an empty one
    s1 = [(f"S1-{i}", *names[i % 3]) for i in range(30)]
    records = [(f"S{2 + i % 2}-{i}", *names[i % 3]) for i in range(60)] + [("S3-D", "red mills shop", "012 Elm Street")]
    s1, records = (translit.prepare(spark.createDataFrame(x, SOURCE)).withColumn("country", F.lit("XX")) for x in (s1, records))
    pairs = [("XX", f"S{2 + i % 2}-{i}", f"S1-{i % 3 + 3 * j}", j, 1.0, 1.0, 1.0) for i in range(60) for j in range(3)] + [("XX", "S3-D", "S1-0", 0, 0.5, 0.5, 0.5)]
    pairs = spark.createDataFrame(pairs, "country string, rec_id string, cand_id string, rank int, score double, cos_n double, cos_a double")
    rows = {(r["rec_id"], r["cand_id"]): r for r in features.comparisons(pairs, s1, records).collect()}
    assert [n for columns, n in made if "name_ratio" in columns] == [4]
    assert len(rows) == 181
    for i in range(60):
        for j in range(3):
            r = rows[f"S{2 + i % 2}-{i}", f"S1-{i % 3 + 3 * j}"]
            assert (r["name_ratio"], r["rank"], r["is_s3"], r["addr_missing"]) == (100, j, i % 2, i % 3 == 1)
            # names are counted in rows, not in contents
            assert abs(r["freq_name_biz"] - [2.3978953, 3.0445224, 3.0445224][i % 3]) < 1e-6
            assert r["in_degree"] == (20 + (i % 3 == 0) if j == 0 else 0)
    other = rows["S3-D", "S1-0"]
    # log1p(30) names hold "mill", 10 hold "red"; no Source 1 name holds "shop", but fewer than 20 records do
    assert other["hn_equal"] == 1 and other["shop_words"] == 0 and abs(other["freq_rarest_shared"] - 2.3978953) < 1e-6 and other["in_degree"] == 21


def test_shop_words_count_copies(spark):
    s1 = spark.createDataFrame([("XX", "s", "mill", 1)], "country string, entity_id string, n string, copies long")
    records = spark.createDataFrame([("XX", "a", "mill depot", 19), ("XX", "b", "depot", 1), ("XX", "c", "hut", 19)], "country string, entity_id string, n string, copies long")
    assert {r["entity_id"]: r["shop_words"] for r in features.shop_words(s1, records, copies="copies").collect()} == {"a": 1, "b": 1, "c": 0}
