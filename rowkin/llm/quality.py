"""Quality classifier (5): a linear-chain conditional random field over the lines of a document.

Every line gets features of its own and of its neighbours; the field labels lines good or bad jointly. It is trained by
maximum likelihood on lines that inherit their document's label, from a bounded sample of labelled documents. A document's
score is the mean of its lines' forward-backward marginals, weighted by their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkin.llm import _words
from rowkin.llm._io import pieces, utf8

#: Labelled documents used for training at most, those with the smallest hashes of doc_id.
TRAIN_DOCUMENTS = 2000
#: Features of a document that is learnt from take at most so many bytes, so the driver gets 256 MB at most.
TRAIN_DOCUMENT_BYTES = 1 << 17
THRESHOLD = 0.3
STEPS, RATE, RIDGE = 150, 0.08, 1e-4
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\v\f", ".", ",;:", "!?", "\"'()-", "|"]


def _byte_classes() -> np.ndarray:
    """Index of each byte's class; other ASCII symbols come next, then bytes beyond ASCII."""
    out = np.full(256, len(CLASSES), np.uint8)
    for i, members in enumerate(CLASSES):
        out[[ord(c) for c in members]] = i
    out[128:] = len(CLASSES) + 1
    return out


BYTE_CLASS, N_CLASSES = _byte_classes(), len(CLASSES) + 2


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, its length in bytes, lines of each row). A row without text is one empty line."""
    n_rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    rows = np.repeat(np.arange(n_rows), 1 + np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]))
    starts = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((starts, np.concatenate([np.arange(n_rows), np.searchsorted(offsets, breaks, "right") - 1])))
    starts = starts[order]
    ends = np.append(starts[1:], len(data))
    last = np.append(rows[1:] != rows[:-1], True) if len(rows) else np.zeros(0, bool)
    ends = np.where(last, offsets[rows + 1], ends - 1)
    lens = ends - starts
    n = len(starts)
    line_of = np.repeat(np.arange(n), np.where(last, ends, ends + 1) - starts)  # a line's break counts as its white space
    counts = np.bincount(line_of * N_CLASSES + BYTE_CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(np.float64)
    counts[:, len(CLASSES)] -= ~last  # the break itself
    words, word_line, word_at, word_end = _words.hashed_words(data, np.append(starts, len(data)) if n else offsets, lower=True)
    n_words = np.bincount(word_line, minlength=n).astype(np.float64)
    _, distinct_line = _words.distinct_by_row(words, word_line)
    distinct = np.bincount(distinct_line, minlength=n)
    long_words = np.bincount(word_line, weights=(word_end - word_at) > 14, minlength=n)
    marked = np.zeros(len(words), bool)
    if len(words):
        marked = BYTE_CLASS[data[word_end - 1]] == len(CLASSES)
    symbol_ends = np.bincount(word_line, weights=marked, minlength=n)
    sums = np.zeros(n, np.uint64)
    np.add.at(sums, word_line, _words.mix(words + np.uint64(7)))
    _, which, times = np.unique(np.stack([rows.astype(np.uint64), sums]), axis=1, return_inverse=True, return_counts=True) if n else (0, np.zeros(0, int), np.zeros(0))
    repeated = (times[which.ravel()] > 1) & (n_words > 0) if n else np.zeros(0, bool)
    size, w = np.maximum(lens, 1), np.maximum(n_words, 1)
    share = counts / size[:, None]
    letters = counts[:, 0] + counts[:, 1] + counts[:, -1]
    own = np.column_stack([
        share, np.sqrt(share[:, [1, 2, 6, 8, 9]]), np.log1p(lens), np.log1p(n_words), letters / w, distinct / w, long_words / w,
        symbol_ends / w, repeated, counts[:, 4] / w, counts[:, 6] / w, counts[:, 1] / np.maximum(letters, 1), counts[:, 8] / w,
        counts[:, 9] / w, n_words < 4, lens == 0,
    ])
    none = np.zeros((1, own.shape[1]))
    first = np.append(True, last[:-1]) if n else last
    before = np.where(first[:, None], 0.0, np.concatenate([none, own[:-1]])) if n else own
    after = np.where(last[:, None], 0.0, np.concatenate([own[1:], none])) if n else own
    return np.column_stack([own, before, after, first, last]).astype(np.float32), lens, np.bincount(rows, minlength=n_rows)


@dataclass
class LineField:
    """Weights of the field: line features (standardised) for label good against bad, and label transitions."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    steps: np.ndarray  # 2 x 2, from label to label

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias

    def marginals(self, emission: np.ndarray, lines: np.ndarray) -> np.ndarray:
        return chains(emission, lines, self.steps)[0]


def chains(emission: np.ndarray, lines: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all chains at once: P(good) per line, expected transitions (2 x 2), sum of log partitions.

    ``emission``: log score of good against bad per line; ``lines``: length of each chain (at least 1). The t-th lines of all
    chains that have one are handled together, longest chains first.
    """
    order = np.argsort(-lines, kind="stable")
    starts = (np.cumsum(lines) - lines)[order]
    size = lines[order]
    most = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(most), "left")  # chains longer than t
    score = np.zeros((len(emission), 2))
    score[:, 1] = emission
    ahead, behind = np.zeros_like(score), np.zeros_like(score)
    for t in range(most):
        at = starts[: live[t]] + t
        ahead[at] = score[at]
        if t:
            from_ = ahead[at - 1]
            ahead[at] += np.logaddexp(from_[:, :1] + steps[0], from_[:, 1:] + steps[1])
    for t in range(most - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        on = score[at + 1] + behind[at + 1]
        behind[at] = np.logaddexp(on[:, :1] + steps[:, 0], on[:, 1:] + steps[:, 1])
    both = ahead + behind
    whole = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - whole)
    moved = np.zeros((2, 2))
    inner = np.ones(len(emission), bool)
    inner[starts + size - 1] = False
    at = np.flatnonzero(inner)
    if len(at):
        for a in (0, 1):
            for b in (0, 1):
                moved[a, b] = np.exp(ahead[at, a] + steps[a, b] + score[at + 1, b] + behind[at + 1, b] - whole[at]).sum()
    return good, moved, float(whole[starts].sum()) if len(starts) else 0.0


def fit(x: np.ndarray, lines: np.ndarray, labels: np.ndarray) -> LineField:
    """Maximum likelihood with a small ridge, by Adam over all chains. Every line carries its document's label."""
    mean, scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64)
    scale = np.where(scale > 1e-6, scale, 1.0)
    z = (x - mean) / scale
    truth = np.repeat(labels, lines).astype(np.float64)
    observed = np.zeros((2, 2))
    for label in (0, 1):
        observed[label, label] = (lines[labels == label] - 1).sum()
    params = np.zeros(z.shape[1] + 5)
    first, second = np.zeros_like(params), np.zeros_like(params)
    n = len(z)
    for i in range(1, STEPS + 1):
        w, bias, steps = params[:-5], params[-5], params[-4:].reshape(2, 2)
        good, moved, _ = chains(z @ w + bias, lines, steps)
        miss = truth - good
        gradient = np.concatenate([z.T @ miss / n - RIDGE * w, [miss.mean()], (observed - moved).ravel() / n - RIDGE * params[-4:]])
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        params = params + RATE * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.999**i)) + 1e-8)
    return LineField(mean, scale, params[:-5], float(params[-5]), params[-4:].reshape(2, 2))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "text"):
            x, _, lines = line_features(*utf8(batch.column("text")))
            at = np.append(0, np.cumsum(lines))
            rows = pa.array([x[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), rows], ["doc_id", "label", "features"])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> LineField | None:
    """Fit the field on labelled rows outside the held-out fold; None where both labels can't be seen.

    Labels that contradict each other for one doc_id count as bad; the sample's bounds are TRAIN_DOCUMENTS and
    TRAIN_DOCUMENT_BYTES (documents beyond it are scored, but not learnt from).
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCUMENTS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(known), "doc_id").mapInArrow(_sampled, "doc_id long, label int, features binary")
    found = found.filter(F.length("features") <= TRAIN_DOCUMENT_BYTES)
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(TRAIN_DOCUMENTS).collect()
    if len({r["label"] for r in rows}) < 2:
        return None
    width = line_features(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0].shape[1]
    x = [np.frombuffer(r["features"], np.float32).reshape(-1, width) for r in rows]
    return fit(np.concatenate(x), np.array([len(v) for v in x]), np.array([r["label"] for r in rows]))


def document_scores(field: LineField | None, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals of each row's lines; 0.5 everywhere without a field."""
    if field is None:
        return np.full(len(offsets) - 1, 0.5)
    x, lens, lines = line_features(data, offsets)
    good = field.marginals(field.emissions(x), lines)
    weight = np.maximum(lens, 1).astype(np.float64)
    rows = np.repeat(np.arange(len(lines)), lines)
    return np.clip(np.bincount(rows, good * weight, len(lines)) / np.bincount(rows, weight, len(lines)), 0.0, 1.0)


def _scored(batches: Iterator[pa.RecordBatch], field: LineField | None, carried: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "text"):
            made = pa.array(document_scores(field, *utf8(batch.column("text"))), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(carried), made], [carried, "score"])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document (doc_id, text), learnt from ``labels`` (doc_id, quality).

    Only the text enters a score. Null and empty texts are one empty line; repeated rows give a row each; other columns are
    ignored; without usable labels every score is 0.5.
    """
    field = train(docs, labels)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = own.mapInArrow(lambda it: _scored(it, field, "doc_id"), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score reaches THRESHOLD, with all their columns.

    A null or empty text counts as one empty line and goes by that line's score; equal texts go or stay together, and rows that
    repeat a document, or have no doc_id, are each judged by their own text; without usable labels all stay.
    """
    field = train(docs, labels)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _scored(it, field, "row"), f"row {kind}, score double").filter(F.col("score") >= THRESHOLD).select("row.*")
