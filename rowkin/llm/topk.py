"""Exact top-k search (4): norm-sorted inner products with SVD-rotated partial sums and Cauchy-Schwarz bounds.

Vectors are scaled to integers, rotated by the singular vectors of a bounded sample (any rotation keeps inner products, a good
one puts most of them into the first components), dealt into groups by descending length and packed into blocks. A first pass
over the longest vectors gives every query a k-th score to start from. Queries are then packed by how long a vector must be to
reach that score, and a query block travels only to the groups that are long enough, the first so many: the early stop of
norm-sorted search, taken before anything is shuffled. In a group, blocks are skipped by the same rule, and in the rest the
partial sum over the leading components plus the product of the residual lengths bounds each score; only pairs whose bound
reaches the k-th score are multiplied out, in exact integers. Groups that many query blocks visit are copied to several tasks.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowkin.llm._io import stage

log = logging.getLogger(__name__)
SCALE = 1024
#: Rows used to fit the rotation (smallest hashes of vec_id) and rows of the first pass (greatest lengths).
SAMPLE, FIRST = 4096, 2048
GROUP, BLOCK, QUERY_BLOCK = 16384, 1024, 256
#: Query blocks that one task takes past a group.
VISITS = 64
SLACK = 1e-9
LEAST, MOST = -(1 << 63), (1 << 63) - 1
PACKED = "dim int, ids binary, vectors binary, floors binary, bound double"
PACKED_NAMES = [f.split()[0] for f in PACKED.split(", ")]
SCALED = "vec_id long, dim int, norm double, vector binary"


def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, dim, length and the integer components (little-endian doubles) of the vectors that take part."""
    for batch in batches:
        ids, dims, norms, packed = [], [], [], []
        column = batch.column("embedding")
        for vec_id, value in zip(batch.column("vec_id").to_pylist(), column, strict=True):
            if vec_id is None or not value.is_valid or value.values.null_count:
                continue
            x = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(x).all():
                continue
            with np.errstate(over="ignore"):
                x = np.floor(SCALE * x)
            if not np.isfinite(x).all():
                continue
            ids.append(vec_id)
            dims.append(len(x))
            norms.append(float(lengths(x[None])[0]))
            packed.append(x.astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64()), pa.array(packed, pa.binary())],
            ["vec_id", "dim", "norm", "vector"],
        )


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths of rows, also of those whose squares overflow."""
    top = np.abs(x).max(axis=1, initial=0)
    with np.errstate(over="ignore"):
        return np.where(top > 0, top * np.sqrt(((x / np.where(top > 0, top, 1)[:, None]) ** 2).sum(1)), 0.0)


def rotation(sample: np.ndarray) -> np.ndarray:
    """Right singular vectors of the sample's directions, as columns, by falling singular value."""
    unit = sample / np.maximum(np.abs(sample).max(axis=1, initial=0), 1)[:, None]
    return np.linalg.svd(unit, full_matrices=True)[2].T if len(sample) else np.eye(sample.shape[1])


class Block:
    """Vectors of one dimension: integers, rotated form, lengths and residual lengths beyond the leading components."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, turn: np.ndarray | None):
        self.ids, self.vectors = ids, vectors
        self.lead = max(1, vectors.shape[1] // 4)
        with np.errstate(over="ignore", invalid="ignore"):
            turned = vectors @ turn if turn is not None and turn.shape[0] == vectors.shape[1] else vectors
        self.head = turned[:, : self.lead]
        self.norms = lengths(vectors)
        self.rest = lengths(turned[:, self.lead :])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows of ``a`` with rows of ``b`` (all pairs), within the limits of a long."""
    if a.size and b.size and not np.abs(a).max() * np.abs(b).max() * a.shape[1] < 1 << 53:
        exact = [[max(LEAST, min(MOST, sum(int(x) * int(y) for x, y in zip(u, v, strict=True)))) for v in b] for u in a]
        return np.array(exact, object).reshape(len(a), len(b))
    return (a @ b.T).astype(np.int64)


def at_most(score: int) -> float:
    """The greatest double that isn't above a score."""
    near = float(score)
    return near if int(near) <= score else float(np.nextafter(near, -np.inf))


class Best:
    """The k best (score, vec_id) of each query of a block so far, with the scores they must reach."""

    def __init__(self, queries: Block, k: int, floors: np.ndarray):
        self.queries, self.k, self.floors = queries, k, floors.astype(np.float64)
        self.found: list[list[tuple[int, int]]] = [[] for _ in queries.ids]

    def offer(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            order = np.lexsort((ids, -scores))[: self.k] if scores.dtype != object else sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.k]
            scores, ids = scores[order], ids[order]
        merged = self.found[row] + [(-int(s), int(i)) for s, i in zip(scores, ids, strict=True)]
        merged.sort()
        self.found[row] = merged[: self.k]
        if len(self.found[row]) == self.k:
            self.floors[row] = max(self.floors[row], at_most(-self.found[row][-1][0]))

    def visit(self, block: Block) -> None:
        q = self.queries
        if not len(block.ids) or block.vectors.shape[1] != q.vectors.shape[1]:
            return
        with np.errstate(over="ignore", invalid="ignore"):  # what overflows is no bound
            reach = q.norms * block.norms.max()
            live = np.flatnonzero(~(reach * (1 + SLACK) + 1 < self.floors))
            if not len(live):
                return
            slack = SLACK * reach[live][:, None] + 1e-3
            bound = q.head[live] @ block.head.T + q.rest[live][:, None] * block.rest + slack
        hit = ~(bound < self.floors[live][:, None]) & (q.ids[live][:, None] != block.ids)
        for k, row in enumerate(live):
            at = np.flatnonzero(hit[k])
            if len(at):
                scores = products(q.vectors[row : row + 1], block.vectors[at])[0]
                enough = np.array(scores >= self.floors[row], bool)
                if enough.any():
                    self.offer(row, scores[enough], block.ids[at[enough]])


def unpacked(ids: bytes, vectors: bytes, dim: int, turn: np.ndarray | None) -> Block:
    own = np.frombuffer(ids, "<i8")
    return Block(own, np.frombuffer(vectors, "<f8").reshape(len(own), dim), turn)


def _packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive vectors of one dimension in blocks of ``size``, their floors, and the greatest bound; the order of rows is kept."""
    held: list[tuple] = []

    def block():
        ids, vectors, floors, bounds = zip(*(r[1:] for r in held), strict=True)
        packed = [np.array(ids, "<i8").tobytes(), b"".join(vectors), np.array(floors, "<f8").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int32()), *(pa.array([x], pa.binary()) for x in packed), pa.array([max(bounds)], pa.float64())], PACKED_NAMES)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("dim", "vec_id", "vector", "floor", "bound")), strict=True):
            if held and (row[0] != held[0][0] or len(held) == size):
                yield block()
                held = []
            held.append(row)
    if held:
        yield block()


def _started(batches: Iterator[pa.RecordBatch], first: list[Block], turn, k: int) -> Iterator[pa.RecordBatch]:
    """Queries with the k-th score that each reaches among the first blocks (minus infinity: fewer than k), and minus the length
    that a vector must have to reach it."""
    for whole in batches:
        for batch in (whole.slice(i, QUERY_BLOCK) for i in range(0, whole.num_rows, QUERY_BLOCK)):
            ids, dims, norms = (batch.column(c).to_numpy() for c in ("vec_id", "dim", "norm"))
            vectors, floors = batch.column("vector").to_pylist(), np.full(len(ids), -np.inf)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                best = Best(unpacked(ids[own].tobytes(), b"".join(vectors[i] for i in own), int(dim), turn), k, floors[own])
                for block in first:
                    best.visit(block)
                floors[own] = best.floors
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                needed = np.where(floors <= 1, 0.0, (floors - 1) / (norms * (1 + SLACK)))
            needed = np.nan_to_num(needed, nan=0.0, posinf=np.inf)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "dim", "vector")), pa.array(floors), pa.array(-needed)], ["vec_id", "dim", "vector", "floor", "bound"])


def _visiting(batches: Iterator[pa.RecordBatch], longest: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How many groups a query block visits: those, longest first, whose longest vector is long enough for one of its queries."""
    for batch in batches:
        n = np.searchsorted(-longest, batch.column("bound").to_numpy(), "right")
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n.astype(np.int32))], [*batch.schema.names, "visits"])


def _searched(batches: Iterator[pa.RecordBatch], turn, k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group and copy, candidates before queries: a group's blocks stay in memory while query blocks pass by."""
    group, blocks = None, []
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("group", "copy", "kind", "dim", "ids", "vectors", "floors"))
        for *at, kind, dim, ids, vectors, floors in zip(*columns, strict=True):
            if at != group:
                group, blocks = at, []
            if kind == 0:
                blocks.append(unpacked(ids, vectors, dim, turn))
                continue
            best = Best(unpacked(ids, vectors, dim, turn), k, np.frombuffer(floors, "<f8"))
            for block in blocks:
                best.visit(block)
            rows = [(int(q), i, -s) for q, found in zip(best.queries.ids, best.found, strict=True) for s, i in found]
            if rows:
                a, b, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, c)], ["query_id", "vec_id", "score"])


def search(vectors: DataFrame, queries, k: int = 10) -> DataFrame:
    """The k greatest integer inner products of every query with all other rows: query_id, rank (from 1), vec_id, score.

    ``vectors``: vec_id, embedding; ``queries``: a condition that picks the query rows. Components are floored after scaling
    by 1024. Vectors that are null, hold a null or non-finite component, or one that is not finite after scaling, take no part;
    only vectors of equal dimension meet; scores beyond a long are its limits; ties go to the smaller vec_id; rows that repeat
    a vec_id count as that query's own. Other columns are ignored. The driver holds two numbers for each 16,384 vectors.
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    rows = stage(plain.mapInArrow(scaled, SCALED), "scaled")
    n = rows.count()
    sample = [r["vector"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("vector").limit(SAMPLE).collect()]
    by_dim: dict[int, list] = {}
    for x in sample:
        by_dim.setdefault(len(x) // 8, []).append(np.frombuffer(x, "<f8"))
    most = max(by_dim, key=lambda d: len(by_dim[d]), default=0)
    turn = rotation(np.stack(by_dim[most])) if most else None
    head = rows.orderBy(F.desc("norm"), "vec_id").select("vec_id", "dim", "vector").limit(FIRST).collect()
    first = []
    for dim in sorted({r["dim"] for r in head}):
        own = [r for r in head if r["dim"] == dim]
        first.append(Block(np.array([r["vec_id"] for r in own]), np.stack([np.frombuffer(r["vector"], "<f8") for r in own]), turn))
    groups = max(1, -(-n // GROUP))
    dealt = rows.repartitionByRange(groups, F.desc("norm"), F.xxhash64("vec_id")).withColumn("group", F.spark_partition_id())
    ordered = dealt.sortWithinPartitions("dim", F.desc("norm"), "vec_id").withColumns({"floor": F.lit(0.0), "bound": F.col("norm")})
    blocks = stage(ordered.mapInArrow(_packed_in_group, "group int, " + PACKED), "blocks")
    bounds = dict(blocks.groupBy("group").agg(F.max("bound")).collect())
    longest = np.array([bounds.get(g, 0.0) for g in range(groups)])
    longest = np.maximum.accumulate(longest[::-1])[::-1]
    asked = rows.filter(queries).mapInArrow(lambda it: _started(it, first, turn, k), "vec_id long, dim int, vector binary, floor double, bound double")
    asked = asked.repartitionByRange("dim", "bound", "vec_id").sortWithinPartitions("dim", "bound", "vec_id").mapInArrow(lambda it: _packed(it, QUERY_BLOCK), PACKED)
    asked = stage(asked.mapInArrow(lambda it: _visiting(it, longest), PACKED + ", visits int"), "queries")
    ends = dict(asked.groupBy("visits").count().collect())
    visits = np.cumsum([ends.get(g + 1, 0) for g in reversed(range(groups))])[::-1]  # query blocks that come as far as each group
    log.info("%d of %d pairs of a query block and a group meet", visits.sum(), groups * sum(ends.values()))
    copies = spark.createDataFrame([(g, int(-(-v // VISITS))) for g, v in enumerate(visits.tolist()) if v] or [(0, 1)], "group int, copies int")
    candidates = blocks.join(copies, "group").select("group", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), *PACKED_NAMES)
    paths = asked.filter("visits > 0").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("visits") - 1))).join(copies, "group")
    passing = paths.select("group", F.pmod(F.xxhash64("ids"), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("kind"), *PACKED_NAMES)
    met = candidates.unionByName(passing).repartition("group", "copy").sortWithinPartitions("group", "copy", "kind")
    found = met.mapInArrow(lambda it: _searched(it, turn, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _packed_in_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group = [0]

    def seen():
        for batch in batches:
            if batch.num_rows:
                group[0] = batch.column("group")[0].as_py()
            yield batch

    for block in _packed(seen(), BLOCK):
        yield pa.RecordBatch.from_arrays([pa.array([group[0]], pa.int32()), *block.columns], ["group", *PACKED_NAMES])
