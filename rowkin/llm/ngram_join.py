"""N-gram Jaccard join (1) with signature trees.

A document is its set of distinct word shingles, as 64-bit hashes. Equal sets collapse into one class. The classes that can
reach the threshold share a shingle in their prefixes under any global order, here rare shingles first, by exact counts over
all documents, so chance and quoted passages seldom meet; sharing sends them under one root. Below each root stand signature
trees, one for each band of set sizes: their nodes hold the OR of their sets' token bitmaps, the range of set sizes and the most
tokens that bitmaps can hide. A dual traversal of a band and itself or the next one descends only into node pairs whose greatest
possible overlap reaches the threshold, and the pairs left are compared exactly unless they are already connected.

Roots too large for one task are split in two rounds. In the first, each block of a band meets itself and the classes with most
copies of its band and the two beside it, which connects groups of near copies without their pairs. In the second, sets meet
per prefix shingle, and only where a shingle's holders are still in several clusters; of a shingle that too many hold, blocks of
its largest cluster meet blocks of the others, but not each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkin.llm import _words
from rowkin.llm._chunks import chunk_table, chunks_with_totals, with_totals
from rowkin.llm._components import connected_components
from rowkin.llm._io import join_counted, release, remove, stage, utf8

FAN = 8
#: Sets and tokens in a block; larger roots are split.
BLOCK_SETS, BLOCK_TOKENS = 1024, 1 << 20
#: Node pairs, and bytes of their bitmaps, that are tested at once.
CHUNK, CHUNK_BYTES = 1 << 15, 1 << 24


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of at least over / under, in exact integer arithmetic."""

    over: int
    under: int

    def reached(self, common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.under * common >= self.over * (a + b - common)

    def least_common(self, total: np.ndarray) -> np.ndarray:
        """Smallest overlap of two sets whose sizes add up to ``total``."""
        return -(-self.over * total // (self.over + self.under))

    def prefix(self, size: np.ndarray) -> np.ndarray:
        """Tokens of which a set and any set alike share at least one, in any global order."""
        return size + (-self.over * size // self.under) + 1

    def sizes_apart(self, small, large):
        return self.under * small < self.over * large


def shingle_rows(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row of the batch's text, rows ascending."""
    data, offsets = utf8(batch.column("text"))
    words, rows, _, _ = _words.hashed_words(data, offsets, lower=True)
    return _words.distinct_by_row(*_words.shingles(words, rows, batch.num_rows, k))


def chunk_terms(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a chunk and the number of its documents that hold each."""
    words, rows, _, _ = _words.hashed_words(data, offsets, lower=True)
    return np.unique(_words.distinct_by_row(*_words.shingles(words, rows, len(offsets) - 1, k))[0], return_counts=True)


SETS = "doc_id long, n_shingles long, set_a long, set_b long, prefix array<long>, text binary"


def _sets(batches: Iterator[pa.RecordBatch], k: int, threshold: Threshold) -> Iterator[pa.RecordBatch]:
    """Size, two sums of its hashes and the shared prefix shingles of each document; its text (compressed) if there are any."""
    pack = zstandard.ZstdCompressor(level=3)
    for known, ids, data, offsets, totals in chunks_with_totals(batches):
        n_rows = len(ids)
        words, word_rows, _, _ = _words.hashed_words(data, offsets, lower=True)
        hashes, rows = _words.distinct_by_row(*_words.shingles(words, word_rows, n_rows, k))
        n = np.bincount(rows, minlength=n_rows)
        ends = np.cumsum(n)
        sums = []
        for salt in (0x1B873593, 0x85EBCA6B):
            total = np.zeros(len(hashes) + 1, np.uint64)
            np.cumsum(_words.mix(hashes ^ np.uint64(salt)), out=total[1:])
            sums.append((total[ends] - total[ends - n]).view(np.int64))
        held = totals[np.searchsorted(np.unique(hashes), hashes)] if len(hashes) else totals
        order = np.lexsort((hashes, held, rows))
        nth = np.arange(len(hashes)) - np.repeat(ends - n, n)
        # shingles that one document alone holds come first and meet nothing
        taken = (nth < np.repeat(np.where(n > 0, threshold.prefix(n), 0), n)) & (held[order] > 1)
        shared = np.bincount(rows[taken], minlength=n_rows)
        prefix = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(shared)).astype(np.int32)), pa.array(hashes[order][taken].view(np.int64)))
        raw = data.tobytes()
        text = [pack.compress(raw[offsets[i] : offsets[i + 1]]) if shared[i] and known[i] else None for i in range(n_rows)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=~known), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), prefix, pa.array(text, pa.binary())],
            ["doc_id", "n_shingles", "set_a", "set_b", "prefix", "text"],
        )


class SignatureTree:
    """Levels of nodes over sets ordered by size, sets themselves at the bottom.

    Each node: OR of bitmaps, least and greatest set size, and the greatest excess of a set's size over its bitmap's bits.
    """

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.sets = sets
        sizes = np.array([len(s) for s in sets], np.int64)
        maps = np.zeros((len(sets), bits // 8), np.uint8)
        shift = np.uint64(64 - (bits.bit_length() - 1))
        for i, s in enumerate(sets):
            at = (s >> shift).astype(np.int64)
            np.bitwise_or.at(maps[i], at >> 3, (1 << (at & 7)).astype(np.uint8))
        maps = maps.view(np.uint64)
        excess = sizes - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, sizes, sizes, excess)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, excess = self.levels[-1]
            heads = np.arange(0, len(maps), FAN)
            self.levels.append(
                (np.bitwise_or.reduceat(maps, heads), np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads), np.maximum.reduceat(excess, heads))
            )


def possible(a: SignatureTree, b: SignatureTree, level: tuple[int, int], p: np.ndarray, q: np.ndarray, threshold: Threshold) -> np.ndarray:
    """Which node pairs may hold a pair of sets that reaches the threshold (indices into p and q): by size, then by bitmaps."""
    (maps_a, low_a, high_a, excess_a), (maps_b, low_b, high_b, excess_b) = a.levels[level[0]], b.levels[level[1]]
    least = threshold.least_common(low_a[p] + low_b[q])
    near = ~threshold.sizes_apart(high_a[p], low_b[q]) & ~threshold.sizes_apart(high_b[q], low_a[p]) & (np.minimum(high_a[p], high_b[q]) >= least)
    at = np.flatnonzero(near)
    most = np.bitwise_count(maps_a[p[at]] & maps_b[q[at]]).sum(1, dtype=np.int64) + np.minimum(excess_a[p[at]], excess_b[q[at]])
    return at[most >= least[at]]


def bands(sizes: np.ndarray, threshold: Threshold) -> np.ndarray:
    """Band of each of ascending sizes: sets of a band can only be alike to sets of it, the one before and the next."""
    out, first, band = np.zeros(len(sizes), np.int64), None, -1
    for at in np.flatnonzero(np.append(True, sizes[1:] != sizes[:-1])) if len(sizes) else ():
        if first is None or threshold.sizes_apart(first, sizes[at]):
            # a gap wider than the ratio leaves a band number out, so that sets on both its sides are no neighbours
            band += 1 if first is None or not threshold.sizes_apart(sizes[at - 1], sizes[at]) else 2
            first = sizes[at]
        out[at:] = band
    return out


def linked(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: Threshold) -> list[tuple[int, int]]:
    """Links that connect all sets of ``a`` (against ``b``, or among themselves) whose similarity reaches the threshold.

    Sets must be ordered by size. Indices into ``a`` and ``b``; a spanning forest of the similarity graph, not all its pairs.
    Trees are built per band of sizes, so that a long set widens the bitmaps of sets of its own length only.
    """
    if not a or b is not None and not b:
        return []
    sides = [a] if b is None else [a, b]
    starts = [0] if b is None else [0, len(a)]
    sizes = np.array([len(s) for side in sides for s in side], np.int64)
    order = np.argsort(sizes, kind="stable")
    band = np.empty(len(sizes), np.int64)
    band[order] = bands(sizes[order], threshold)
    ranges = []  # of each side: band -> (first index, end) in the side
    for side, start in zip(sides, starts, strict=True):
        own = band[start : start + len(side)]
        heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        ranges.append({int(own[h]): (int(h), int(e)) for h, e in zip(heads, np.append(heads[1:], len(own)), strict=True)})
    trees: dict[tuple[int, int, int], SignatureTree] = {}

    def tree(side: int, n: int, bits: int) -> SignatureTree:
        if (side, n, bits) not in trees:
            for key in [k for k in trees if k[1] < n - 1]:
                del trees[key]
            trees[side, n, bits] = SignatureTree(sides[side][slice(*ranges[side][n])], bits)
        return trees[side, n, bits]

    group = np.arange(len(sizes))
    out: list[tuple[int, int]] = []
    last = len(sides) - 1
    for n in sorted({*ranges[0], *ranges[last]}):
        pairs = [(0, n, last, n), (0, n, last, n + 1)] + ([(0, n + 1, last, n)] if last else [])
        for s, m, r, o in pairs:
            if m in ranges[s] and o in ranges[r]:
                most = max(len(sides[s][ranges[s][m][1] - 1]), len(sides[r][ranges[r][o][1] - 1]))
                bits = max(64, 1 << int(4 * most - 1).bit_length())
                same = (s, m) == (r, o)
                first, second = tree(s, m, bits), tree(r, o, bits)
                for i, j in _descend(first, second, same, group, starts[s] + ranges[s][m][0], starts[r] + ranges[r][o][0], threshold):
                    out.append((i + ranges[s][m][0], j + ranges[r][o][0]))
    return out


def _descend(first: SignatureTree, second: SignatureTree, same: bool, group: np.ndarray, at: int, other: int, threshold: Threshold) -> Iterator[tuple[int, int]]:
    """Links between two trees (or within one); ``group`` marks what is connected, the trees' sets from ``at`` and ``other`` on."""
    limit = max(1, min(CHUNK, CHUNK_BYTES // first.levels[0][0][0].nbytes))
    stack = [(len(first.levels) - 1, len(second.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, p, q = stack.pop()
        if la == 0 and lb == 0:
            apart = group[p + at] != group[q + other]
            p, q = p[apart], q[apart]
        if len(p) > limit:
            stack += [(la, lb, p[i : i + limit], q[i : i + limit]) for i in range(0, len(p), limit)][::-1]
            continue
        good = possible(first, second, (la, lb), p, q, threshold)
        p, q = p[good], q[good]
        if not len(p):
            continue
        if la == 0 and lb == 0:
            for i, j in zip(p.tolist(), q.tolist(), strict=True):
                if group[i + at] != group[j + other]:
                    x, y = first.sets[i], second.sets[j]
                    if threshold.reached(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                        group[group == group[j + other]] = group[i + at]
                        yield i, j
            continue
        step = np.arange(FAN)
        da, db = la > 0 and la >= lb, lb > 0 and lb >= la
        p2 = (p[:, None] * FAN + step).ravel() if da else p
        q2 = np.repeat(q, FAN) if da else q
        keep = p2 < len(first.levels[la - da][0])
        p2, q2 = p2[keep], q2[keep]
        if db:
            p2, q2 = np.repeat(p2, FAN), (q2[:, None] * FAN + step).ravel()
            keep = q2 < len(second.levels[lb - db][0])
            p2, q2 = p2[keep], q2[keep]
        if same:
            keep = p2 < q2 if la - da == 0 else p2 <= q2
            p2, q2 = p2[keep], q2[keep]
        stack.append((la - da, lb - db, p2, q2))


def _joined(batches: Iterator[pa.RecordBatch], k: int, threshold: Threshold) -> Iterator[pa.RecordBatch]:
    """Rows sorted by root: the texts of one or two blocks of sets; yields the links found."""

    def met(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        sides = [sorted(((len(t), d, t) for s, d, t in rows if s == side), key=lambda x: x[:2]) for side in (0, 1)]
        sets = [[t for _, _, t in side] for side in sides]
        found = linked(sets[0], sets[1] if sides[1] else None, threshold)
        other = sides[1] or sides[0]
        return pa.RecordBatch.from_arrays(
            [pa.array([sides[0][i][1] for i, _ in found], pa.int64()), pa.array([other[j][1] for _, j in found], pa.int64())], ["a", "b"]
        )

    unpack = zstandard.ZstdDecompressor()
    root, rows = None, []
    for whole in batches:
        for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
            texts = pa.array([unpack.decompress(t).decode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()], pa.string())
            hashes, owner = shingle_rows(pa.RecordBatch.from_arrays([texts], ["text"]), k)
            ends = np.cumsum(np.bincount(owner, minlength=batch.num_rows))
            columns = (batch.column(c).to_pylist() for c in ("root", "side", "doc_id"))
            for at, side, doc_id, end, start in zip(*columns, ends, np.append(0, ends), strict=False):
                if at != root:
                    if len(rows) > 1:
                        yield met(rows)
                    root, rows = at, []
                if end > start:
                    rows.append((side, doc_id, hashes[start:end].copy()))
        release()
    if len(rows) > 1:
        yield met(rows)
    release()


def _blocks(sets: str = "sets", tokens: str = "tokens"):
    return F.ceil(F.greatest(F.col(sets) / BLOCK_SETS, F.col(tokens) / BLOCK_TOKENS)).cast("int")


def _band(threshold: Threshold):
    """Band of a set's size: limits lie the threshold's ratio apart, so that only a band and those beside it can meet."""
    ratio = threshold.under / threshold.over
    return F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(float(np.log(ratio * (1 + 1e-9)))) - F.lit(1e-9)).cast("int")


def _blocks_and_hubs(split: DataFrame) -> DataFrame:
    """doc_id, root, side of the first round of large roots (component, band, doc_id, n_shingles, copies)."""
    per = split.groupBy("component", "band").agg(
        F.count("*").alias("sets"), F.sum("n_shingles").alias("tokens"), F.max(F.struct("copies", (-F.col("doc_id")).alias("hub"))).alias("hub")
    )
    per = per.select("component", "band", _blocks().alias("blocks"), (-F.col("hub.hub")).alias("doc_id"))
    own = split.join(per.drop("doc_id"), ["component", "band"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    hubs = per.select("component", "doc_id", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    hubs = hubs.join(per.drop("doc_id"), ["component", "band"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    root = F.concat_ws("/", "component", "band", "block").alias("root")
    return own.select("doc_id", root, F.lit(0).alias("side")).unionByName(hubs.select("doc_id", root, F.lit(0).alias("side")))


def _by_key(holders: DataFrame) -> DataFrame:
    """doc_id, root, side of the second round: holders (key, band, doc_id, n_shingles, cluster) of keys that several clusters hold.

    Keys with equal holders count once. Of a key that too many hold, units are a band's sets in the key's largest cluster, and
    those in others; units of one band or of neighbouring ones meet block by block, but two of the largest cluster don't.
    """
    marks = [F.bit_xor(F.xxhash64("doc_id", F.lit(salt))).alias(f"holders_{salt}") for salt in (1, 2)]
    keys = holders.groupBy("key").agg(F.min("cluster").alias("least"), F.max("cluster").alias("most"), F.count("*").alias("n"), F.sum("n_shingles").alias("tokens"), *marks)
    alone = keys.filter("least < most").groupBy("n", "tokens", "holders_1", "holders_2").agg(F.min("key").alias("key")).select("key", "n", "tokens")
    large = (F.col("n") > BLOCK_SETS) | (F.col("tokens") > BLOCK_TOKENS)
    met = stage(join_counted(holders, alone, ["key"], holders.count()).withColumn("large", large), "holders")
    whole = met.filter("not large").select("doc_id", F.concat(F.lit("key/"), F.col("key")).alias("root"), F.lit(0).alias("side"))
    rest = met.filter("large").select("key", "band", "doc_id", "n_shingles", "cluster")
    greatest = rest.groupBy("key", "cluster").count().groupBy("key").agg(F.max(F.struct("count", "cluster")).alias("top")).select("key", "top.cluster", F.lit(1).alias("main"))
    rest = rest.join(greatest, ["key", "cluster"], "left").withColumn("unit", F.col("band") * 2 + F.coalesce("main", F.lit(0)))
    units = rest.groupBy("key", "unit").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("tokens")).select("key", "unit", _blocks().alias("blocks"))
    rest = rest.join(units, ["key", "unit"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    left, right = (units.select("key", F.col("unit").alias(f"unit_{i}"), F.col("blocks").alias(f"blocks_{i}")) for i in (1, 2))
    one, two = F.col("unit_1"), F.col("unit_2")
    pairs = left.join(right, "key").filter((one <= two) & (F.shiftright(two, 1) - F.shiftright(one, 1) <= 1) & (one.bitwiseAND(two).bitwiseAND(F.lit(1)) == 0))
    block, other = F.col("block"), F.col("other")
    ahead = rest.select("key", F.col("unit").alias("unit_1"), "doc_id", "block").join(pairs, ["key", "unit_1"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks_2") - 1)))
    swapped = (one == two) & (block > other)
    ahead = ahead.select(
        "doc_id", F.concat_ws("/", "key", one, F.when(swapped, other).otherwise(block), two, F.when(swapped, block).otherwise(other)).alias("root"), swapped.cast("int").alias("side")
    )
    behind = rest.select("key", F.col("unit").alias("unit_2"), "doc_id", "block").join(pairs.filter("unit_1 < unit_2"), ["key", "unit_2"])
    behind = behind.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks_1") - 1)))
    behind = behind.select("doc_id", F.concat_ws("/", "key", one, other, two, block).alias("root"), F.lit(1).alias("side"))
    return whole.unionByName(ahead).unionByName(behind)


def join(docs: DataFrame, k: int = 5, over: int = 8, under: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id of every document (doc_id, text): similarity of word k-shingle sets >= over / under.

    component_id is the smallest doc_id reachable by links, itself included. Texts are lower-cased for A-Z; a text of fewer
    than k words is one shingle; null and empty texts have none and stand alone, as do rows without doc_id (null component).
    Rows that repeat a doc_id are one node, and give a row each. Other columns are ignored.
    """
    threshold = Threshold(over, under)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = chunk_table(own)
    n_words = int(chunks.agg(F.sum("n_words")).first()[0] or 0)
    met = with_totals(chunks, lambda data, offsets: chunk_terms(data, offsets, k), n_words)
    sets = stage(met.mapInArrow(lambda it: _sets(it, k, threshold), SETS), "sets")
    remove(chunks)
    key = ["n_shingles", "set_a", "set_b"]
    full = sets.filter("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1").select(*key, "rep", "n")
    marked = sets.select("doc_id", *key).join(classes, key, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    lone = full.drop("text").join(classes, key, "left").filter("rep is null or rep = doc_id")
    keys = lone.select(F.explode("prefix").alias("key"), "n_shingles", "doc_id")
    # every holder of a key is linked to its smallest one: map-side minima and a join that can be split, whatever the key's size
    first = keys.groupBy("key").agg(F.min(F.struct("n_shingles", "doc_id")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    stars = keys.join(first.select("key", F.col("first.doc_id").alias("b")), "key").select(F.col("doc_id").alias("a"), "b")
    near = connected_components(stars)
    sizes = lone.groupBy(F.col("doc_id").alias("node")).agg(F.max("n_shingles").alias("n_shingles"), F.max(F.coalesce("n", F.lit(1))).alias("copies"))
    members = stage(near.join(sizes, "node").select(F.col("node").alias("doc_id"), "n_shingles", "copies", "component"), "members")
    sums = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("tokens"))
    sums = sums.withColumn("large", (F.col("n") > BLOCK_SETS) | (F.col("tokens") > BLOCK_TOKENS))
    marked_members = stage(join_counted(members, sums.drop("tokens"), ["component"], members.count()).withColumn("band", _band(threshold)), "members")
    split = marked_members.filter("large")
    whole = marked_members.filter("not large").select("doc_id", F.col("component").cast("string").alias("root"), F.lit(0).alias("side"))
    # compressed texts travel to their roots, not their tokens, which take more room
    texts = full.filter("text is not null").select("doc_id", "text")

    def met(rooted: DataFrame) -> DataFrame:
        sent = texts.join(rooted, "doc_id").repartition("root").sortWithinPartitions("root", "side", "doc_id")
        return sent.mapInArrow(lambda it: _joined(it, k, threshold), "a long, b long")

    links = stage(met(whole.unionByName(_blocks_and_hubs(split))), "links")
    if not split.isEmpty():
        clusters = connected_components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
        own = split.select("doc_id", "band").join(clusters, "doc_id", "left").withColumn("cluster", F.coalesce("cluster", "doc_id"))
        links = links.unionByName(met(_by_key(stage(keys.join(own, "doc_id"), "holders"))))
    # equal sets of other rows that repeat a doc_id reach its class through the doc_id itself
    same = marked.filter("n_shingles > 0 and rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    repeated = full.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("a"))
    links = links.unionByName(same.join(repeated, "a", "left_semi"))
    groups = connected_components(links).select(F.col("node").alias("rep"), "component")
    out = marked.join(groups, "rep", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("component_id"))
    return out


def keep_one(docs: DataFrame, k: int = 5, over: int = 8, under: int = 10) -> DataFrame:
    """The documents without all but the one of smallest doc_id of each group of near duplicates, with all their columns.

    Null and empty texts are alike to nothing and stay, as do rows without doc_id. Rows that repeat a doc_id are one document:
    they stay or go together. An empty table gives an empty one.
    """
    groups = join(docs, k, over, under).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_anti")
