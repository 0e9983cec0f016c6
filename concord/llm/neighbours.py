"""Approximate nearest neighbours by an inverted multi-index (operator 3).

A vector is quantised in two halves, each against `cells` centroids of its own; the pair of centroids is the
vector's cell in the index. A query sorts both halves' centroids by their share of the measure and
walks through the pairs by the sum, best first, with a heap, until the cells passed hold a given share of all
entries; the entries of these cells, and no others, are reranked by the exact measure on the original vectors.

Centroids come from k-means on FIT_ROWS vectors at most (those with the least hash of vec_id); the index
holds every row. The number of centroids grows with the square root of the rows. How many entries a walk passes is
measured, not set: the nearest neighbours of TRIED vectors are found by brute force, and the share is the one
within which walks from these vectors meet TARGET of them. Vectors close to uniform on a sphere need a large
share, vectors with some structure a small one.

Entries are dealt by cell into blocks, a cell of many entries over several. A task reads a block's entries
and then the queries that probe it, as a stream, so no entry is copied for queries and memory holds
one block and a batch of queries; it returns each query's best TOP there.

Nearness is the largest inner product, in double precision; ties go to the smaller vec_id.

Defined cases: vectors that are null, zero, of another length than most, or that hold null or non-finite
components take no part, nor do rows without vec_id; repeated rows of a vec_id count once, with their best
score; a query's own vec_id is no candidate; with fewer candidates all are returned; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm import common

TOP = 20
TARGET = 0.96
TRIED = 96
FIT_ROWS = 20_000
FIT_STEPS = 12
#: Entries of a cell on average, while there are few enough.
CELL = 4
BLOCKS, LEAST_BLOCK, LARGEST_BLOCK = 24, 8192, 32_768
#: Queries whose walks are one task.
WALKS = 128


@dataclass(frozen=True)
class Index:
    """Codebooks of both halves, entries in each cell, each cell's first block and number of blocks, and the share of entries that a walk passes."""

    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray
    block: np.ndarray
    spread: np.ndarray
    probed: float

    @property
    def blocks(self) -> int:
        return int((self.block + self.spread).max())

    def sums(self, q: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The centroids' inner products with queries (rows), summed for each of some cells (columns); always in the same order."""
        half = self.first.shape[1]
        a, b = (np.stack([codebook @ part for part in parts]) for codebook, parts in ((self.first, q[:, :half]), (self.second, q[:, half:])))
        return a[:, cells // len(self.second)] + b[:, cells % len(self.second)]

    @property
    def size(self) -> int:
        return int(self.counts.sum())


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0))
    good = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(good)
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (usual.n if usual else 0))


def kmeans(x: np.ndarray, k: int, steps: int = FIT_STEPS) -> np.ndarray:
    """Lloyd's algorithm from k rows at even distances; empty clusters take the worst-served rows."""
    centre = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(steps):
        d = (centre**2).sum(1)[None] - 2 * x @ centre.T
        own = d.argmin(1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        centre[n > 0] = sums[n > 0] / n[n > 0, None]
        if (empty := np.flatnonzero(n == 0)).size:
            centre[empty] = x[np.argsort(-d[np.arange(len(x)), own], kind="stable")[: empty.size]]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre**2).sum(1)[None] - 2 * x @ centre.T).argmin(1)


def centroids(n: int) -> int:
    """For each half; their square is the number of cells."""
    return int(min(max(round((n / CELL) ** 0.5), 2), 1024))


def fit(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).collect()
    x = np.array([r.vector for r in sample])
    k, half = min(centroids(n), len(x)), (x.shape[1] + 1) // 2
    return kmeans(x[:, :half], k), kmeans(x[:, half:], k) if x.shape[1] > half else np.zeros((1, 0))


def build(rows: DataFrame) -> tuple[Index, DataFrame] | None:
    """(index, entries): entries have vec_id, vector and block; None for no rows. rows: from usable()."""
    spark = rows.sparkSession
    n = rows.count()
    if not n:
        return None
    first, second = fit(rows, n)
    half = first.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1)
                cell = nearest(x[:, :half], first) * len(second) + nearest(x[:, half:], second)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(cell.astype(np.int32))], names=["vec_id", "vector", "cell"])

    celled = common.materialize(rows.mapInArrow(assign, "vec_id long, vector array<double>, cell int"), "index-entries")
    counts = np.zeros(len(first) * len(second), dtype=np.int64)
    for r in celled.groupBy("cell").count().collect():  # a row for each cell, at most 1024 x 1024
        counts[r.cell] = r["count"]
    size = min(max(-(-n // BLOCKS), LEAST_BLOCK), LARGEST_BLOCK)
    spread = np.maximum(1, -(-counts // size)).astype(np.int32)
    block = np.zeros(len(counts), dtype=np.int32)
    at, room = 0, size
    for cell, c in enumerate(counts.tolist()):  # cells follow each other in blocks; a large one has blocks of its own
        if spread[cell] > 1:
            at += room < size
            block[cell] = at
            at, room = at + int(spread[cell]), size
            continue
        if c > room:
            at, room = at + 1, size
        block[cell] = at
        room -= c
    index = Index(first, second, counts, block, spread, 1.0)
    index = replace(index, probed=measured_share(rows, celled, index))
    places = spark.createDataFrame(pd.DataFrame({"cell": np.arange(len(counts), dtype=np.int32), "block": block, "spread": spread}))
    entries = celled.join(F.broadcast(places), "cell").withColumn("block", (F.col("block") + F.pmod(F.xxhash64("vec_id"), F.col("spread"))).cast("int"))
    return index, entries.select("vec_id", "vector", "cell", "block")


def measured_share(rows: DataFrame, celled: DataFrame, index: Index, tried: int = TRIED, target: float = TARGET, top: int = TOP) -> float:
    """The share of entries within which walks from tried vectors meet the target share of their true nearest."""
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(tried).collect()
    ids, q = np.array([r.vec_id for r in sample]), np.array([r.vector for r in sample])

    def nearest_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own, cells = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1), batch.column("vec_id").to_numpy(), batch.column("cell").to_numpy()
            score = q @ x.T
            score[ids[:, None] == own[None]] = -np.inf
            m = min(top, len(own))
            at = np.argpartition(-score, m - 1, axis=1)[:, :m] if m else np.zeros((len(q), 0), dtype=int)
            who = np.repeat(np.arange(len(q)), m)
            at = at.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(who.astype(np.int32)), pa.array(score[who, at]), pa.array(cells[at])], names=["query", "score", "cell"])

    found = celled.mapInArrow(nearest_here, "query int, score double, cell int").where(F.col("score") > float("-inf"))
    found = common.materialize(found, "tried")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cell"))
    truth = found.withColumn("rank", rank).where(F.col("rank") <= top).select("query", "cell").collect()  # tried * top rows
    if not truth:
        return 1.0
    cells = np.flatnonzero(index.counts)
    passed = []
    for k, own in enumerate(index.sums(q, cells)):
        order = np.argsort(-own, kind="stable")
        upto = np.empty(len(cells))
        upto[order] = np.cumsum(index.counts[cells][order])
        passed += [upto[np.searchsorted(cells, r.cell)] for r in truth if r["query"] == k]
    return min(1.0, float(np.quantile(passed, target)) / index.size)


def walk(q: np.ndarray, index: Index, counts: list[int], wanted: int) -> tuple[float, set[int]]:
    """Pass cells in falling order of the centroids' inner products with the query until they hold so many entries: (the last sum, the blocks met)."""
    half = index.first.shape[1]
    a, b = index.first @ q[:half], index.second @ q[half:]
    i_order, j_order = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    first, second = (i_order * len(b)).tolist(), j_order.tolist()
    a, b = a[i_order].tolist(), b[j_order].tolist()
    heap = [(-(a[0] + b[0]), 0, 0)]
    met, held, last = set(), 0, 0.0
    while heap and held < wanted:
        last, i, j = heap[0]
        cell = first[i] + second[j]
        if counts[cell]:
            held += counts[cell]
            met.add(cell)
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
        if j + 1 < len(b):
            heapq.heapreplace(heap, (-(a[i] + b[j + 1]), i, j + 1))
        else:
            heapq.heappop(heap)
    cells = np.fromiter(met, dtype=np.int64, count=len(met))
    blocks = set(index.block[cells].tolist())
    for cell in cells[index.spread[cells] > 1].tolist():
        blocks.update(range(int(index.block[cell]), int(index.block[cell] + index.spread[cell])))
    return -last, blocks


class BlockOfEntries:
    """One block's entries by cell, and the reranking of queries that probe some of its cells."""

    def __init__(self, index: Index, ids: np.ndarray, x: np.ndarray, cells: np.ndarray) -> None:
        order = np.lexsort((ids, cells))
        self.index, self.ids, self.x = index, ids[order], x[order]
        self.cells, starts = np.unique(cells[order], return_index=True)
        self.ends = np.append(starts, len(ids))
        self.repeats = len(ids) - len(np.unique(ids))

    def rerank(self, query_ids: np.ndarray, q: np.ndarray, last: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query_id, vec_ids, scores) of each query's best here, ties to the smaller id, each id once."""
        passed = self.index.sums(q, self.cells) >= last[:, None]
        rough = np.full((len(q), len(self.ids)), -np.inf)
        for c in np.flatnonzero(passed.any(axis=0)):  # only the cells that are probed, each for the queries that probe it
            lo, hi = self.ends[c], self.ends[c + 1]
            asking = np.flatnonzero(passed[:, c])
            rough[asking, lo:hi] = q[asking] @ self.x[lo:hi].T
        rough[query_ids[:, None] == self.ids[None]] = -np.inf
        most = top + self.repeats
        for query_id, vector, scores in zip(query_ids.tolist(), q, rough, strict=True):
            if most < len(scores):
                least = np.partition(scores, len(scores) - most)[len(scores) - most]
                keep = np.flatnonzero((scores >= least - 1e-9 * (1 + abs(least))) & (scores > -np.inf))
            else:
                keep = np.flatnonzero(scores > -np.inf)
            exact = (self.x[keep] * vector).sum(axis=1)  # row by row in one order, so equal vectors score equally anywhere
            order = np.lexsort((self.ids[keep], -exact))
            if self.repeats:
                order = order[np.sort(np.unique(self.ids[keep][order], return_index=True)[1])]
            yield query_id, self.ids[keep][order[:top]], exact[order[:top]]


def search(queries: DataFrame, index: Index, entries: DataFrame, top: int = TOP, probed: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score. queries: from usable(), with vec_id the query's id; probed: in place of the measured share."""
    wanted = int(np.ceil((index.probed if probed is None else probed) * index.size))
    queries = common.materialize(queries.groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    row = "block int, query_id long, vec_id long, vector array<double>, cell int, last double"
    names = [f.split()[0] for f in row.split(", ")]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = index.counts.tolist()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in names}
            for query_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                last, blocks = walk(np.array(vector), index, counts, wanted)
                for block in blocks:
                    for column, value in zip(out.values(), (block, query_id, None, vector, None, last), strict=True):
                        column.append(value)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=names)

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1)

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come block by block, a block's entries before its queries."""
        at, held, block = None, [], None
        for batch in batches:
            keys, asked = batch.column("block").to_numpy(), ~np.isnan(batch.column("last").to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (asked[1:] != asked[:-1])) + 1 if len(keys) else []
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True) if len(keys) else ():
                part = batch.slice(lo, hi - lo)
                if at != keys[lo]:
                    at, held, block = keys[lo], [], None
                if not asked[lo]:
                    held.append((part.column("vec_id").to_numpy(), matrix(part), part.column("cell").to_numpy()))
                    continue
                if block is None:
                    block = BlockOfEntries(index, *[np.concatenate(v) for v in zip(*held, strict=True)])
                    held = []
                step = max(1, (1 << 21) // len(block.ids))  # 16 MB of scores
                for start in range(0, part.num_rows, step):
                    some = part.slice(start, step)
                    found = list(block.rerank(some.column("query_id").to_numpy(), matrix(some), some.column("last").to_numpy(), top))
                    ids, scores = np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    n = queries.count()
    asked = common.materialize(queries.repartition(max(1, min(-(-n // WALKS), 10_000))).mapInArrow(probe, row), "probes")
    none = lambda kind: F.lit(None).cast(kind)
    held = entries.select("block", none("long").alias("query_id"), "vec_id", "vector", "cell", none("double").alias("last"))
    by_block = held.unionByName(asked).repartitionById(max(1, index.blocks), F.col("block")).sortWithinPartitions("block", F.col("last").isNotNull())
    found = common.materialize(by_block.mapInArrow(rerank, "query_id long, vec_id long, score double"), "nearest")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


@common.finished
def op3_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    built = build(rows)
    if built is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(rows.where(F.col("vec_id") % 20 == 0), *built)
