"""The comparison columns are made in steps: the last plan joins staged pairs with staged entities and nothing else."""

from pyspark.sql import functions as F
from rowkin.operators import features, translit


def source(spark, rows):
    return translit.prepare(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string")).withColumn("country", F.lit("XX"))


def test_plan_stays_small_and_rows_whole(spark):
    s1 = source(spark, [("S1-1", "red mill", "12 Elm St #5"), ("S1-2", "blue mill", "7 Oak Road"), ("S1-3", "", None)])
    records = source(spark, [("S3-1", "red mills shop", "12 Elm"), ("S2-2", "mill blue", None), ("S2-3", "", "7 Oak")])
    pairs = [("S3-1", "S1-1", 0, 0.9), ("S3-1", "S1-2", 1, 0.4), ("S2-2", "S1-2", 0, 0.8), ("S2-3", "S1-3", 0, 0.2)]
    pairs = spark.createDataFrame([("XX", *p, p[3], p[3]) for p in pairs], "country string, rec_id string, cand_id string, rank int, score double, cos_n double, cos_a double")
    out = features.comparisons(pairs, s1, records)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") < 8 and plan.count("Window") == 0
    got = sorted((r["rec_id"], r["cand_id"], r["num_shared"], r["hn_equal"], r["grp_rank"], r["grp_distinct_nums"], r["in_degree"]) for r in out.collect())
    assert got == [
        ("S2-2", "S1-2", 0, -1, 0, 0, 1), ("S2-3", "S1-3", 0, -1, 0, 1, 1), ("S3-1", "S1-1", 1, 1, 0, 1, 1), ("S3-1", "S1-2", 0, 0, 1, 0, 1),
    ]
