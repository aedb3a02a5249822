"""Every document has its trigrams in the gram table."""

from collections import Counter

from rowkin.plans import queries


def test_grams_of_all_documents(spark, tmp_path):
    rows = [(i, f"text number {'abcdefgh'[i]} aaa aaa") for i in range(8)]
    spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["id"], r["gram"]): r["tf"] for r in queries.QUERIES["grams"](spark, str(tmp_path)).collect()}
    expected = Counter((i, f" {w} "[k : k + 3]) for i, t in rows for w in t.split() for k in range(len(w)))
    assert got == dict(expected)
