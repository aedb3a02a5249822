"""Corpus-wide counts of hashed terms, exchanged by chunks of documents.

A chunk's distinct terms are packed by hash partition, so a term sends no more rows than there are chunks, however many
documents hold it. Each partition joins equal terms, sums their counts, and answers every chunk in the order its terms came.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkin.llm import _words
from rowkin.llm._io import pieces, release, stage, utf8

CHUNK_BYTES = 4 << 20
#: Words whose terms are counted in one hash partition, about.
PARTITION_WORDS = 1 << 20
#: (text bytes, offsets) of a chunk to its distinct terms, ascending, and their counts.
Terms = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for whole in batches:
        for batch in pieces(whole, "text", CHUNK_BYTES):
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("doc_id")
            known, values = np.array(ids.is_valid()), ids.fill_null(0).to_numpy()
            raw = b"".join([known.astype(np.uint8).tobytes(), values.astype("<i8").tobytes(), offsets.astype("<i8").tobytes(), data.tobytes()])
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(_words.word_spans(data, offsets)[0])]), pa.array([batch.num_rows], pa.int32()), pa.array([pack.compress(raw)], pa.binary())],
                ["n_words", "n_docs", "docs"],
            )


def chunk_table(docs: DataFrame) -> DataFrame:
    """chunk, n_words, n_docs, docs (compressed) of documents (doc_id long, text string), written to the shared folder."""
    rows = docs.mapInArrow(_packed, "n_words long, n_docs int, docs binary").withColumn("chunk", F.monotonically_increasing_id())
    return stage(rows, "chunks")


def unpack(docs: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(known ids, ids, text bytes, offsets) of a chunk."""
    raw = zstandard.ZstdDecompressor().decompress(docs)
    known = np.frombuffer(raw, np.uint8, n).astype(bool)
    ids = np.frombuffer(raw, "<i8", n, n)
    offsets = np.frombuffer(raw, "<i8", n + 1, 9 * n)
    return known, ids, np.frombuffer(raw, np.uint8, offset=9 * n + 8 * (n + 1)), offsets


def planes(values: np.ndarray) -> bytes:
    """Byte planes: the bytes of equal weight side by side, which compress well."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def from_planes(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


def partition_bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each hash partition's keys begin in ascending keys: partitions are equal ranges of the hash."""
    limits = np.array([(i << 64) // parts for i in range(parts)], np.uint64)
    return np.append(np.searchsorted(keys, limits), len(keys))


def _exploded(batches: Iterator[pa.RecordBatch], terms: Terms, parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, n, docs in zip(*(batch.column(c).to_pylist() for c in ("chunk", "n_docs", "docs")), strict=True):
            _, _, data, offsets = unpack(docs, n)
            keys, counts = terms(data, offsets)
            at = partition_bounds(keys, parts)
            full = np.flatnonzero(np.diff(at))
            keys_, counts_ = [], []
            for p in full:
                own = keys[at[p] : at[p + 1]]
                keys_.append(planes(np.append(own[:1], np.diff(own))))
                counts_.append(planes(counts[at[p] : at[p + 1]].astype(np.uint32)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)), pa.array([chunk] * len(full), pa.int64()), pa.array(keys_, pa.binary()), pa.array(counts_, pa.binary())],
                ["part", "chunk", "keys", "counts"],
            )


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part: joins equal terms of one partition, sums their counts, answers every chunk."""

    def answer(part: int, rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        keys = [np.cumsum(from_planes(k, np.uint64), dtype=np.uint64) for _, k, _ in rows]
        counts = np.concatenate([from_planes(c, np.uint32) for _, _, c in rows])
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(which, counts).astype(np.uint64)[which]
        ends = np.cumsum([len(k) for k in keys])
        blobs = [planes(total[e - len(k) : e]) for e, k in zip(ends, keys, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _, _ in rows], pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "part", "totals"]
        )

    part, rows = None, []
    for batch in batches:
        for p, chunk, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "chunk", "keys", "counts")), strict=True):
            if p != part:
                if rows:
                    yield answer(part, rows)
                part, rows = p, []
            rows.append((chunk, keys, counts))
    if rows:
        yield answer(part, rows)
    release()


def with_totals(chunks: DataFrame, terms: Terms, n_words: int) -> DataFrame:
    """Rows for ``chunks_with_totals``: each chunk's answers, then its documents, side by side in one partition."""
    parts = max(1, -(-n_words // PARTITION_WORDS))
    packed = chunks.select("chunk", "n_docs", "docs").mapInArrow(lambda it: _exploded(it, terms, parts), "part int, chunk long, keys binary, counts binary")
    packed = packed.repartition(min(parts, 4096), "part").sortWithinPartitions("part", "chunk")
    totals = packed.mapInArrow(_summed, "chunk long, part int, totals binary")
    answers = totals.select("chunk", F.lit(0).alias("kind"), "part", F.lit(0).alias("n_docs"), F.col("totals").alias("blob"))
    texts = chunks.select("chunk", F.lit(1).alias("kind"), F.lit(-1).alias("part"), "n_docs", F.col("docs").alias("blob"))
    return answers.unionByName(texts).repartition("chunk").sortWithinPartitions("chunk", "kind", "part")


def chunks_with_totals(batches: Iterator[pa.RecordBatch]):
    """(known ids, ids, text bytes, offsets, totals of the chunk's terms in ascending order) of every chunk."""
    chunk, totals = None, []
    for batch in batches:
        for at, kind, n, blob in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "n_docs", "blob")), strict=True):
            if at != chunk:
                chunk, totals = at, []
            if kind == 0:
                totals.append(blob)
            else:
                yield *unpack(blob, n), np.concatenate([np.zeros(0, np.uint64), *(from_planes(t, np.uint64) for t in totals)])
    release()
