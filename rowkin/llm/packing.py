"""Best-fit packing (8): documents into sequences of bounded length by minimum bin slack.

Only lengths matter to a packing, and a piece has at most ``capacity`` different lengths. Spark tokenises the texts and
counts the lengths; the driver packs that histogram (at most ``capacity`` rows whatever the corpus holds): for each bin it
fixes the longest remaining length and fills the rest by a subset-sum dynamic program whose reachable sums are the bits of
one integer, takes the fullest combination, and repeats it for as many bins as its scarcest length allows. The resulting
patterns, again bounded by ``capacity``, are dealt to the pieces by their rank within their length; ranks come from two
levels of counts, so a length that a third of all pieces share is never gathered in one task.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowkin.llm import _pretokens
from rowkin.llm._io import pieces, stage, utf8
from rowkin.llm._merges import Merges
from rowkin.llm.bpe import byte_letters

CAPACITY = 2048
RANK_BUCKETS = 256
#: Distinct pieces a worker remembers before it starts afresh; bounds memory, not results.
MEMO = 1_000_000
_tables: dict[str, "PieceTable"] = {}


class PieceTable:
    """Token ids of the distinct pieces seen so far, looked up by hash; unseen ones are merged together in one batch."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.kinds = _pretokens.classes_of(self.tokenizer.pre_tokenizer)
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab, merges = spec["model"]["vocab"], [tuple(m) for m in spec["model"]["merges"]]
        self.byte_ids = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.merges = Merges([(vocab[a], vocab[b]) for a, b in merges], [vocab[a + b] for a, b in merges], len(vocab))
        self.clear()

    def clear(self) -> None:
        self.memo = _pretokens.Memo()
        self.lens, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def look_up(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place of each key; the new ones' text stands at ``starts`` to ``ends``, in code points of ``data``."""
        if len(self.memo) > MEMO:
            self.clear()
        places, new = self.memo.places_of(keys)
        if len(new):
            raw, lens = _pretokens.piece_bytes(data, starts[new], ends[new])
            ids, lens = self.merges.apply(self.byte_ids[raw], lens)
            self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
            self.lens = np.concatenate([self.lens, lens])
        return places


def piece_table(path: str) -> PieceTable:
    if path not in _tables:
        _tables[path] = PieceTable(path)
    return _tables[path]


def encode_rows(column, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(token ids of all rows, n + 1 offsets) of an Arrow string column, as the byte-level tokenizer gives them."""
    known = piece_table(path)
    data, offsets = utf8(column)
    raw = data.tobytes()
    if any(s.encode() in raw for s in known.special):  # the library cuts these strings out first
        got = [known.tokenizer.encode(x or "", add_special_tokens=False).ids for x in column.to_pylist()]
        return np.concatenate([np.zeros(0, np.uint32), *(np.array(x, np.uint32) for x in got)]), np.cumsum([0, *map(len, got)])
    cps, at = _pretokens.code_points(data, offsets)
    starts = _pretokens.byte_level_starts(cps, at, known.kinds)
    ends = np.append(starts[1:], len(cps))[: len(starts)]
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    keys, first, which = _pretokens.distinct_pieces(cps, starts, ends)
    where = known.look_up(keys, data, starts[first], ends[first])
    begins = np.cumsum(known.lens) - known.lens
    lens = known.lens[where][which]
    ids = _pretokens.gather(known.ids, begins[where][which], lens)
    total = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lens, out=total[1:])
    return ids, total[np.searchsorted(starts, at)]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of full length but the first, which takes the remainder."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _pieces_of(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "text", 2 << 20):
            ids, at = encode_rows(batch.column("text"), path)
            rows: list[tuple] = []
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                rows += [(doc_id, k, s, n, zlib.crc32(own[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(own), capacity))]
            ids_, ks, starts, lens, crcs = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids_, pa.int64()), pa.array(ks, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lens, crcs))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )


def tokenised_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda it: _pieces_of(it, path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest multiset of available lengths that contains the longest one and fits: {length: copies}."""
    lengths = sorted(counts, reverse=True)
    longest = lengths[0]
    room = capacity - longest
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # (length, copies, sums reachable before)
    for n in lengths:
        have = min(counts[n] - (n == longest), room // n) if n <= room else 0
        copies = 1
        while have > 0 and not reach >> room & 1:
            copies = min(copies, have)
            steps.append((n, copies, reach))
            reach |= (reach << n * copies) & mask
            have -= copies
            copies *= 2
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, {longest: 1}
    for n, copies, before in reversed(steps):
        if not before >> total & 1:
            taken[n] = taken.get(n, 0) + copies
            total -= n * copies
    return taken


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """[(bins, {length: copies in each})] that use up ``counts``; at most two patterns for each distinct length and copy count."""
    left, out = {n: c for n, c in counts.items() if c > 0}, []
    while left:
        taken = fullest(left, capacity)
        bins = min(left[n] // c for n, c in taken.items())
        for n, c in taken.items():
            left[n] -= bins * c
            if not left[n]:
                del left[n]
        out.append((bins, taken))
    return out


def dealt(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, copies in a sequence, offset of the first copy) by rank."""
    rows: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for bins, taken in patterns:
        offset = 0
        for n in sorted(taken, reverse=True):
            rows.setdefault(n, []).append((ranks.get(n, 0), sequence, taken[n], offset))
            ranks[n] = ranks.get(n, 0) + bins * taken[n]
            offset += n * taken[n]
        sequence += bins
    return {n: np.array(x, np.int64) for n, x in rows.items()}


def _placed(batches: Iterator[pa.RecordBatch], deal: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            own = length == n
            row = deal[int(n)][np.searchsorted(deal[int(n)][:, 0], rank[own], "right") - 1]
            nth = rank[own] - row[:, 0]
            sequence[own] = row[:, 1] + nth // row[:, 2]
            offset[own] = row[:, 3] + nth % row[:, 2] * n
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pack every document (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is one piece that holds
    the end token alone; repeated rows and doc_ids are packed as often as they stand; other columns are ignored; an empty
    table gives an empty result.
    """
    cut_up = stage(tokenised_pieces(docs, path, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}
    deal = dealt(minimum_bin_slack(counts, capacity))
    bucketed = cut_up.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_BUCKETS)).cast("int"))
    sums = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = bucketed.withColumn("nth", F.row_number().over(within)).join(sums, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") - 1 + F.col("ahead")).alias("rank"))
    return ranked.mapInArrow(
        lambda it: _placed(it, deal),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )


def least_sequences(lengths: dict[int, int], capacity: int = CAPACITY) -> int:
    """No packing can use fewer sequences than this."""
    return math.ceil(sum(n * c for n, c in lengths.items()) / capacity)
