"""LM scoring (6): stupid-backoff scores computed relationally from n-gram counts of the corpus itself.

The corpus is cut into chunks of documents, stored compressed. Each chunk explodes into its n-grams, pre-aggregated to one row
per distinct n-gram and packed by hash partition, so that no n-gram sends more rows than there are chunks. Each partition joins
the packed rows of equal n-grams and sums their counts: the count table. The totals return to their chunks in the order the
n-grams came, and each chunk sums the scores of its documents. A document's own n-grams are taken off the counts first, as
otherwise every n-gram would have been seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkin.llm import _words
from rowkin.llm._chunks import chunk_table, chunks_with_totals, with_totals

ORDER, ALPHA = 2, 0.4


def chunk_grams(data: np.ndarray, offsets: np.ndarray, order: int):
    """For each n up to ``order``: (hash of the n-gram that ends at each word, whether it lies within one row); rows."""
    words, rows, _, _ = _words.hashed_words(data, offsets, lower=True)
    out = []
    for n in range(1, order + 1):
        hashes, whole = np.zeros(len(words), np.uint64), np.zeros(len(words), bool)
        if len(words) >= n:
            hashes[n - 1 :] = _words.ngram_hashes(words, n) + np.uint64(n)
            whole[n - 1 :] = rows[n - 1 :] == rows[: len(rows) - n + 1]
        out.append((hashes, whole))
    return out, rows


def table_keys(grams) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a chunk, all orders together, ascending, and how often each stands."""
    return np.unique(np.concatenate([h[w] for h, w in grams]), return_counts=True)


def own_counts(hashes: np.ndarray, whole: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How often each word's n-gram stands in its own row."""
    out = np.zeros(len(hashes), np.int64)
    at = np.flatnonzero(whole)
    if len(at):
        order = np.lexsort((hashes[at], rows[at]))
        h, r = hashes[at][order], rows[at][order]
        head = np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]))
        which = np.cumsum(head) - 1
        out[at[order]] = np.bincount(which)[which]
    return out


def row_scores(grams, rows: np.ndarray, n_rows: int, keys: np.ndarray, totals: np.ndarray, n_words: int):
    """(words, sum of log scores, words that backed off, words unseen elsewhere) of each row.

    A word's score is the count of the longest n-gram ending there that other documents hold too, over the count of its
    context, times ALPHA for every order given up; a word no other document holds counts as seen once.
    """
    size = np.bincount(rows, minlength=n_rows)
    seen = []
    for hashes, whole in grams:
        count = np.zeros(len(hashes), np.int64)
        count[whole] = totals[np.searchsorted(keys, hashes[whole])].astype(np.int64)
        seen.append(count - own_counts(hashes, whole, rows))
    elsewhere = np.maximum(n_words - size[rows], 1)
    score = np.log(np.maximum(seen[0], 1) / elsewhere)
    level = np.zeros(len(rows), np.int64)
    for n in range(1, len(grams)):
        found = np.flatnonzero((seen[n] > 0) & grams[n][1])
        score[found] = np.log(seen[n][found] / seen[n - 1][found - 1])
        level[found] = n
    # the first words of a text have no longer context to give up
    start = np.searchsorted(rows, np.arange(n_rows))
    most = np.minimum(np.arange(len(rows)) - start[rows], len(grams) - 1) if len(rows) else level
    score = score + (most - level) * math.log(ALPHA)
    return size, np.bincount(rows, score, n_rows), np.bincount(rows, level < most, n_rows).astype(np.int64), np.bincount(rows, seen[0] < 1, n_rows).astype(np.int64)


SCORES = "doc_id long, n_words long, log_score double, n_backoff long, n_unseen long"


def chunk_terms(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    return table_keys(chunk_grams(data, offsets, order)[0])


def _scored(batches: Iterator[pa.RecordBatch], order: int, n_words: int) -> Iterator[pa.RecordBatch]:
    for known, ids, data, offsets, totals in chunks_with_totals(batches):
        grams, rows = chunk_grams(data, offsets, order)
        keys, _ = table_keys(grams)
        size, sums, backed, unseen = row_scores(grams, rows, len(ids), keys, totals, n_words)
        mean = sums / np.maximum(size, 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=~known), pa.array(size.astype(np.int64)), pa.array(mean, mask=size == 0), pa.array(backed), pa.array(unseen)],
            [f.split()[0] for f in SCORES.split(", ")],
        )


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, log_score (mean natural logarithm per word), n_backoff, n_unseen of every document (doc_id, text).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; n-grams don't cross documents. Counts cover all rows less the row
    that is scored, so copies vouch for each other. Null and empty texts have no words and a null score; repeated rows give a
    row each; other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = chunk_table(own)
    n_words = int(chunks.agg(F.sum("n_words")).first()[0] or 0)
    met = with_totals(chunks, lambda data, offsets: chunk_terms(data, offsets, order), n_words)
    return met.mapInArrow(lambda it: _scored(it, order, n_words), SCORES)
