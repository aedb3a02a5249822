"""Reading archives back copies each record once, and deals records out by their stored bytes."""

import hashlib

import pyarrow as pa
from rowkin.llm import warc


def test_each_record_is_cut_out_once(monkeypatch):
    payloads = [bytes([65 + i]) * 500 for i in range(20)]
    members = [warc.record(i, "http://a/", p, hashlib.sha256(p).hexdigest(), None) for i, p in enumerate(payloads)]
    data, taken = b"".join(members), []

    class Block(bytes):
        def __getitem__(self, key):
            taken.append(len(out := super().__getitem__(key)))
            return Block(out)

    class Store:
        def open_input_file(self, _):
            return self

        def read_at(self, n, start):
            return Block(data[start : start + n])

    monkeypatch.setattr(warc, "file_system", lambda _: (Store(), ""))
    lengths = [len(m) for m in members]
    offsets = [sum(lengths[:i]) for i in range(20)]
    batch = pa.RecordBatch.from_pydict({"archive": ["x"] * 20, "offset": offsets, "length": lengths})
    rows = [r for b in warc._read([batch], "", True) for r in b.to_pylist()]
    assert [r["payload"] for r in rows] == payloads
    assert sum(taken) == len(data)


def test_tasks_follow_stored_bytes(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://a/{i}", "".join(chr(97 + (i * j) % 23) for j in range(400))) for i in range(60)], "page_id long, url string, html string")
    folder, index = warc.write(pages)
    monkeypatch.setattr(warc, "TASK_BYTES", 4 << 10)
    out = warc.read(folder, index)
    assert out.rdd.getNumPartitions() > 1
    assert sorted(r["page_id"] for r in out.collect()) == list(range(60))
    assert warc.read(folder, index.filter("page_id < 0")).count() == 0
