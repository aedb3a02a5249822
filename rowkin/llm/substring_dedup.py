"""Substring dedup (3) with prefix-partitioned suffix trees.

A repeat of at least ``window`` words is an internal node of the suffix tree whose string depth reaches the window. Only
suffixes that can lie below such a node matter: every window has one anchor, the 8-word prefix of least hash in it, so equal
windows have equal anchors, and the windows around one anchor make a region that goes into one tree.

* Anchors whose prefix stands in one document alone are dropped before any text moves.
* Regions that are equal to their ends are one leaf: all but those of the smallest document repeat it, whatever the tree says.
* The leaves are partitioned by their prefix. A prefix with more leaves than a task should hold is lengthened: the places that
  the anchor can take in a window are halved, and each half shares more words (8, 29, 40, 45, 48, 50 for windows of 50), so
  leaves part as soon as their words do. At full length a partition is one node, and equal leaves are one leaf again.
* Each task builds the subtrees of its prefixes level by level: node numbers at depth 1, 2, 4, ... words come from pairs of
  nodes at half the depth, and leaves that are alone leave early. Nodes at full depth that hold several documents are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkin.llm import _words
from rowkin.llm._io import join_counted, pieces, release, remove, stage, utf8

WINDOW = 50
PREFIX = 8
#: Words whose subtrees a task builds at once, and leaves (of at most 92 words) under one prefix before it is lengthened.
TREE_WORDS, GROUP = 1 << 20, 1 << 14
PLACE = np.uint64((1 << 28) - 1)
SECOND = np.uint64(0x2545F4914F6CDD1D)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n, have = len(values) - width + 1, 1
    if n <= 0:
        return values[:0]
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[:n], values[width - have : width - have + n])


def anchors(words: np.ndarray, rows: np.ndarray, window: int, prefix: int):
    """(key, row, first window, last window, anchor) of every anchor; positions count words of the whole array."""
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none.astype(np.uint64), none, none, none, none
    grams = _words.ngram_hashes(words, prefix)
    marked = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    best = (sliding_min(marked, window - prefix + 1) & PLACE).astype(np.int64)
    starts = np.flatnonzero(rows[: len(best)] == rows[window - 1 :])
    at = best[starts]
    head = np.ones(len(at), bool)
    head[1:] = (at[1:] != at[:-1]) | (rows[starts[1:]] != rows[starts[:-1]])
    heads = np.flatnonzero(head)
    return grams[at[heads]], rows[starts[heads]], starts[heads], starts[np.append(heads[1:], len(at)) - 1] if len(heads) else none, at[heads]


def whole_hashes(first: np.ndarray, last: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Hash of a region from those of its first and last window, which cover it, as windows around an anchor overlap."""
    return _words.mix(first + _words.mix(last ^ SECOND) + windows.astype(np.uint64))


NODE = "key long, whole long, doc_id long, row_mark long, starts array<int>, windows int, shift int, low int, high int"
NODE_NAMES = [f.split()[0] for f in NODE.split(", ")]


def _anchored(batches: Iterator[pa.RecordBatch], window: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """The distinct regions of each text, with the first words of all their places."""
    for batch in (b for whole in batches for b in pieces(whole, "text")):
        words, rows, _, _ = _words.hashed_words(*utf8(batch.column("text")))
        key, row, first, last, at = anchors(words, rows, window, prefix)
        begin = _words.row_bounds(rows, batch.num_rows)
        hashes = _words.ngram_hashes(words, window)
        equal = whole_hashes(hashes[first], hashes[last], last - first + 1)
        order = np.lexsort((first, equal, key, row))
        key, row, first, last, at, equal = (x[order] for x in (key, row, first, last, at, equal))
        heads = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (equal[1:] != equal[:-1]))[: len(key)])
        starts = pa.ListArray.from_arrays(pa.array(np.append(heads, len(key)).astype(np.int32)), pa.array((first - begin[row]).astype(np.int32)))
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.array(x[heads].view(np.int64)) for x in (key, equal)), *(batch.column(c).take(pa.array(row[heads])) for c in ("doc_id", "row_mark")), starts,
                *(pa.array(x.astype(np.int32)) for x in ((last - first + 1)[heads], (at - first)[heads], np.zeros(len(heads)), np.full(len(heads), window - prefix))),
            ],
            NODE_NAMES,
        )


def hashes_at(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each start."""
    out = np.zeros(len(starts), np.uint64)
    for j in range(n):
        out = out * _words.GRAM_BASE + words[starts + j]
    return _words.mix(out)


def _placed(batch: pa.RecordBatch):
    """(text bytes, starts and ends of words, their hashes, places, row of each place, first word of each place) of texts with places."""
    data, offsets = utf8(batch.column("text"))
    words, rows, starts, ends = _words.hashed_words(data, offsets)
    listed = batch.column("places")
    row, places = np.repeat(np.arange(batch.num_rows), np.array(listed.value_lengths().fill_null(0))), listed.flatten()
    return data, starts, ends, words, places, row, _words.row_bounds(rows, batch.num_rows)[row] + pc.list_element(places.field("starts"), 0).to_numpy()


def moved(lists: pa.ListArray, by: np.ndarray) -> pa.ListArray:
    """Every list with its own number added to all its values."""
    size = np.array(lists.value_lengths())
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array((lists.flatten().to_numpy() + np.repeat(by, size)).astype(np.int32)))


def _lengthened(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The leaves of large prefixes, each as two leaves of longer prefixes: the windows that hold the anchor early, and late."""
    for batch in (b for whole in batches for b in pieces(whole, "text")):
        _, _, _, words, places, row, first = _placed(batch)
        windows, shift, low, high = (places.field(c).to_numpy().astype(np.int64) for c in ("windows", "shift", "low", "high"))
        middle = (low + high) // 2
        for lo, hi in ((low, middle), (middle + 1, high)):
            head, tail = np.maximum(shift - hi, 0), np.minimum(shift - lo, windows - 1)
            some = np.flatnonzero((head <= tail) & (lo <= hi))
            lo, hi, head, tail, at, r = lo[some], hi[some], head[some], tail[some], first[some], row[some]
            key = np.zeros(len(some), np.uint64)
            for n in np.unique(hi - lo):  # words that all windows with the anchor at lo to hi share
                own = np.flatnonzero(hi - lo == n)
                key[own] = hashes_at(words, (at + shift[some] - lo)[own], window - int(n))
            key = _words.mix(key ^ (lo * 65536 + hi).astype(np.uint64))
            equal = whole_hashes(hashes_at(words, at + head, window), hashes_at(words, at + tail, window), tail - head + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(x.view(np.int64)) for x in (key, equal)), *(batch.column(c).take(pa.array(r)) for c in ("doc_id", "row_mark")),
                    moved(places.field("starts").take(pa.array(some)), head), *(pa.array(x.astype(np.int32)) for x in (tail - head + 1, shift[some] - head, lo, hi)),
                ],
                NODE_NAMES,
            )


REGION = "key long, doc_id long, row_mark long, starts array<int>, words string"


def _regions(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The words of each leaf."""
    for batch in (b for whole in batches for b in pieces(whole, "text")):
        data, starts, ends, _, places, row, first = _placed(batch)
        last = first + places.field("windows").to_numpy() + window - 2
        text = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[first], ends[last], strict=True)]
        ids = [batch.column(c).take(pa.array(row)) for c in ("doc_id", "row_mark")]
        yield pa.RecordBatch.from_arrays([places.field("key"), *ids, places.field("starts"), pa.array(text, pa.string())], [f.split()[0] for f in REGION.split(", ")])


def nodes_at_depth(symbols: np.ndarray, room: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, their node) for the nodes of string depth ``depth`` that hold two suffixes or more.

    ``room``: symbols from each position to the end of its text. Node numbers at twice a depth come from pairs of numbers.
    """
    _, node = np.unique(symbols, return_inverse=True)
    have, at = 1, np.arange(len(symbols))
    numbers = node.astype(np.int64)
    while True:
        step = min(have, depth - have)
        if step == 0:
            return at, numbers[at]
        at = np.flatnonzero((room >= have + step) & (numbers >= 0))
        at = at[numbers[at + step] >= 0]
        _, found, count = np.unique(numbers[at] * len(symbols) + numbers[at + step], return_inverse=True, return_counts=True)
        alone = count[found] < 2  # a leaf of its own from here on: no deeper node holds it and another
        have += step
        numbers = np.full(len(symbols), -1, np.int64)
        numbers[at[~alone]] = found[~alone]
        at = at[~alone]


COVERED = "doc_id long, row_mark long, starts array<int>, begin int, stop int"


def _subtrees(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: the ranges of words, from a leaf's first, that repeat a document of smaller doc_id."""

    def grown(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        words, owner, _, _ = _words.hashed_words(*utf8(rows["words"]))
        bounds = _words.row_bounds(owner, rows.num_rows)
        suffix, node = nodes_at_depth(words, bounds[owner + 1] - np.arange(len(words)), window)
        doc = rows["doc_id"].to_numpy()[owner[suffix]]
        order = np.argsort(node, kind="stable")
        heads = np.flatnonzero(np.append(True, np.diff(node[order]) > 0)) if len(order) else order
        least = np.minimum.reduceat(doc[order], heads) if len(heads) else doc
        smallest = np.empty(len(order), np.int64)
        smallest[order] = np.repeat(least, np.diff(np.append(heads, len(order))))
        repeats = np.sort(suffix[doc > smallest])
        head = np.append(True, (np.diff(repeats) > 1) | (np.diff(owner[repeats]) > 0))[: len(repeats)]
        first, last = repeats[head], repeats[np.append(head[1:], True)[: len(repeats)]]
        own = owner[first]
        kept = [rows[c].combine_chunks().take(pa.array(own)) for c in ("doc_id", "row_mark", "starts")]
        ranges = [pa.array((x - bounds[own]).astype(np.int32)) for x in (first, last + window)]
        return pa.RecordBatch.from_arrays([*kept, *ranges], [f.split()[0] for f in COVERED.split(", ")])

    held, size = [], 0
    for batch in (b for whole in batches for b in pieces(whole, "words")):
        key = batch.column("key").to_numpy()
        new = np.append(True, key[1:] != key[:-1])
        if held:
            new[0] = held[-1].column("key")[-1].as_py() != key[0]
        at = 0
        for head in np.flatnonzero(new).tolist():
            if size + (head - at) * 2 * window >= TREE_WORDS:
                yield grown([*held, batch.slice(at, head - at)])
                held, size, at = [], 0, head
        held.append(batch.slice(at))
        size += (len(key) - at) * 2 * window
    if held:
        yield grown(held)
    release()


def _met(nodes: DataFrame, keys: list[str], *more) -> DataFrame:
    """``nodes`` with the least and greatest doc_id and the number of rows of their keys, however many rows one key has."""
    own = nodes.groupBy(*keys).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    for condition in more:
        own = own.filter(condition)
    return join_counted(nodes, own, keys, nodes.count())


def repeated_spans(own: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """doc_id, row_mark, starts, begin, stop: words ``begin`` to ``stop`` from each of ``starts`` are covered by windows that also
    start in a document of smaller doc_id.

    Prefixes are lengthened in rounds, each of which reads only texts with leaves of large prefixes; a window of 50 has 7 at most.
    """
    texts = own.filter("doc_id is not null")

    def with_places(leaves: DataFrame) -> DataFrame:  # as many as one text has room for
        return texts.join(leaves.groupBy("doc_id", "row_mark").agg(F.collect_list(F.struct(*NODE_NAMES)).alias("places")), ["doc_id", "row_mark"])

    nodes = stage(texts.mapInArrow(lambda it: _anchored(it, window, prefix), NODE), "anchors")
    found = []
    while True:
        shared = stage(_met(nodes, ["key"], "least < most").select(*NODE_NAMES), "shared")
        leaves = stage(_met(shared, ["key", "whole"]).select(*NODE_NAMES, "least"), "leaves")
        copied = leaves.filter("doc_id > least").select(*COPIED, F.lit(0).alias("begin"), (F.col("windows") + window - 1).alias("stop"))
        leaders = leaves.filter("doc_id = least").drop("least")
        groups = stage(_met(leaders, ["key"], "least < most").select(*NODE_NAMES, (F.col("n") > GROUP).alias("large")), "groups")
        regions = with_places(groups.filter("not large")).mapInArrow(lambda it: _regions(it, window), REGION)
        covered = regions.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _subtrees(it, window), COVERED)
        found.append(stage(copied.unionByName(covered), "found"))
        large = groups.filter("large")
        later = None if large.isEmpty() else stage(with_places(large).mapInArrow(lambda it: _lengthened(it, window), NODE), "anchors")
        for done in (nodes, shared, leaves, groups):
            remove(done)
        if later is None:
            return reduce(DataFrame.unionByName, found)
        nodes = later


COPIED = ["doc_id", "row_mark", "starts"]


def covered_words(n: int, spans: list[dict]) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    for s in spans or []:
        starts = np.array(s["starts"], np.int64)
        np.add.at(step, starts + s["begin"], 1)
        np.add.at(step, starts + s["stop"], -1)
    return np.cumsum(step[:-1]) > 0


def _kept(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "text"):
            data, offsets = utf8(batch.column("text"))
            starts, ends, rows = _words.word_spans(data, offsets)
            bounds = _words.row_bounds(rows, batch.num_rows).tolist()
            raw, spans = data.tobytes(), batch.column("spans").to_pylist()
            counts, gone, out = [], [], []
            for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                text = raw[offsets[i] : offsets[i + 1]]
                hit = covered_words(b - a, spans[i])
                counts.append(b - a)
                gone.append(int(hit.sum()))
                if not texts:
                    words = text.split() if not gone[-1] else [raw[starts[j] : ends[j]] for j in np.flatnonzero(~hit) + a]
                    out.append(hashlib.sha256(b" ".join(words)).hexdigest())
                elif not gone[-1]:
                    out.append(batch.column("text")[i].as_py())
                else:  # a kept word keeps the white space after it
                    edges = np.append(starts[a:b], offsets[i + 1])
                    change = np.flatnonzero(np.append(True, hit[1:] != hit[:-1]))
                    stops = np.append(change[1:], b - a)
                    parts = [raw[edges[x] : edges[y]] for x, y in zip(change, stops, strict=True) if not hit[x]]
                    out.append((raw[offsets[i] : edges[0]] * bool(not hit[0]) + b"".join(parts)).decode("utf-8", "replace"))
            made = [pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())]
            if texts:
                yield pa.RecordBatch.from_arrays([batch.column("rest"), made[2]], ["rest", "text"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _marked(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """Rows of doc_id, text (and rest) with the spans to remove."""
    rows = docs.withColumn("row_mark", F.xxhash64("doc_id", "text"))
    found = repeated_spans(rows.select("doc_id", "row_mark", "text"), window, prefix)
    spans = found.groupBy("doc_id", "row_mark").agg(F.collect_list(F.struct("starts", "begin", "stop")).alias("spans"))
    return rows.join(spans, ["doc_id", "row_mark"], "left").drop("row_mark")


def digests(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document (doc_id, text).

    Words ``[^\\x20\\x09-\\x0D]+`` covered by a window of ``window`` words that also starts in a document of smaller doc_id are
    removed; windows are judged on the input. Null text has no words; rows without doc_id lose nothing and remove nothing;
    rows that repeat a doc_id give a row each and don't remove from each other; other columns are ignored.
    """
    marked = _marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), window, prefix)
    return marked.select("doc_id", "text", "spans").mapInArrow(
        lambda it: _kept(it, False), "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """The documents with repeated words cut out of ``text`` (and ``n_chars`` renewed if there is one); other columns stay.

    No row goes: a text that repeats smaller documents as a whole becomes empty. Null and empty texts and rows without doc_id
    stay as they are; rows that repeat a doc_id don't remove from each other; a kept word keeps the white space after it.
    """
    others = [n for n in docs.columns if n != "text"]
    packed = docs.select(F.struct(*others).alias("rest"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = packed.schema["rest"].dataType.simpleString()
    marked = _marked(packed, window, prefix).select("rest", "text", "spans")
    out = marked.mapInArrow(lambda it: _kept(it, True), f"rest {kind}, text string").select("rest.*", "text")
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
