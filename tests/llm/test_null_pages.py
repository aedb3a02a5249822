"""Pages without a page_id in the archives."""

from rowkin.llm import warc


def test_null_page_id(spark):
    rows = [(None, "u", "x" * 200), (None, None, None), (7, "v", "x" * 200), (9, "w", "x" * 200)]
    folder, index = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read(folder, index).collect()), key=repr)
    assert got == sorted([(None, 200, "response", None), (None, 0, "response", None), (7, 200, "response", None), (9, 200, "revisit", 7)], key=repr)
