"""Exact top-k search by integer inner product, pruned with multi-resolution segment statistics.

For vectors cut into segments of length l with means m and deviations s, the squared distance is at least the sum of
l * ((mq - mx)**2 + (sq - sx)**2); with the vectors' norms that bounds the inner product from above:
q.x <= sum of l * (mq * mx + sq * sx). A candidate block is held against a query block at 1, 4 and 16 segments; what can't reach a
query's k-th best so far goes, and exact products are computed for the survivors only.

The queries are the stated set: they travel to the workers in blocks of bounded size, with a floor per query (the k-th best of a
fixed-size probe of candidates, itself exact), and every candidate partition is read once per block. A partition emits at most
k rows a query; a window with a group limit, applied before its shuffle too, joins them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayside.llm.common import Scratch, trimmed, tune

#: Values (components) of queries that are sent to the workers at once.
BLOCK_VALUES = 2_000_000
#: Candidates that give each query its first floor.
PROBE = 512
LEVELS = (1, 4, 16)
LONG = (1 << 63) - 1


def _exact(values: np.ndarray) -> np.ndarray:
    """floor(256 * x) as float64, which holds every such integer of a float or double exactly."""
    return np.floor(256.0 * values)


def segments(x: np.ndarray, parts: int) -> np.ndarray:
    """Per segment sqrt(l) * mean and sqrt(l) * deviation, so that a dot product of two rows is the bound."""
    edges = np.unique(np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int))
    size = np.diff(edges)
    total = np.add.reduceat(x, edges[:-1], axis=1)
    square = np.add.reduceat(x * x, edges[:-1], axis=1)
    return np.hstack([total / np.sqrt(size), np.sqrt(np.maximum(square - total * total / size, 0))])


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows, saturated to 64 bits."""
    if not q.size or not x.size or np.abs(q).max() * np.abs(x).max() * q.shape[-1] < 2**53:
        return (q * x).sum(-1).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for r, s in zip(q, x, strict=True)]
    return np.array([max(-LONG - 1, min(LONG, v)) for v in exact], np.int64)


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray) -> None:
        self.k, self.floor = k, floor.copy()  # scores below the floor can't be among the k best
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.n = n

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score.astype(np.float64), query)) if not len(score) or np.abs(score).max() < 2**53 else np.array(sorted(range(len(query)), key=lambda i: (query[i], -int(score[i]), ids[i])))
        query, score, ids = query[order], score[order], ids[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        last = rank == self.k - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last])
        self.query, self.score, self.id = query[keep], score[keep], ids[keep]


def search(best: Best, q: np.ndarray, q_id: np.ndarray, coarse: list[np.ndarray], x: np.ndarray, x_id: np.ndarray, finer: list[np.ndarray]) -> None:
    """Offer all rows of ``x`` to all queries, coarse to fine; ``coarse`` and ``finer`` are the segments of both, by level."""
    slack = 1e-9 * (np.abs(q).sum(1).max(initial=0) * np.abs(x).max(initial=0) + 1) + 1e-6
    qi = xi = None
    for level, fine in enumerate(finer):
        if level == 0:
            qi, xi = np.nonzero(coarse[0] @ fine.T + slack >= best.floor[:, None])
        else:
            for lo in range(0, len(qi), 1 << 17):
                s = slice(lo, lo + (1 << 17))
                bound = np.einsum("ij,ij->i", coarse[level][qi[s]], fine[xi[s]])
                bad = bound + slack < best.floor[qi[s]]
                qi[s][bad] = -1
            keep = qi >= 0
            qi, xi = qi[keep], xi[keep]
    keep = q_id[qi] != x_id[xi]
    qi, xi = qi[keep], xi[keep]
    for lo in range(0, len(qi), 1 << 15):
        s = slice(lo, lo + (1 << 15))
        a, b = qi[s], xi[s]
        score = products(q[a], x[b])
        good = score >= best.floor[a]
        best.add(a[good], score[good], x_id[b[good]])


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of a batch, by dimension."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    lists = batch.column(1)
    offsets = lists.offsets.to_numpy()
    values = _exact(lists.values.to_numpy(zero_copy_only=False).astype(np.float64))
    size = np.diff(offsets)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield ids[rows], values[offsets[rows][:, None] + np.arange(d)]


def _partition(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        groups = [(q_id, q, floor, [segments(q, p) for p in LEVELS] if q.shape[1] else [], Best(len(q), k, floor)) for q_id, q, floor in shared.value]
        by_size = {g[1].shape[1]: g for g in groups}
        for batch in batches:
            for ids, x in _matrices(batch):
                if (g := by_size.get(x.shape[1])) is None:
                    continue
                q_id, q, _, coarse, best = g
                for lo in range(0, len(ids), 512):
                    finer = [segments(x[lo : lo + 512], p) for p in LEVELS] if q.shape[1] else []
                    for at in range(0, len(q_id), 2048):
                        part = slice(at, at + 2048)
                        if q.shape[1]:
                            view = Best(0, k, best.floor[part])
                            search(view, q[part], q_id[part], [c[part] for c in coarse], x[lo : lo + 512], ids[lo : lo + 512], finer)
                            best.add(view.query + at, view.score, view.id)
                        else:
                            a, b = np.nonzero(q_id[part][:, None] != ids[lo : lo + 512][None, :])
                            best.add(a + at, np.zeros(len(a), np.int64), ids[lo + b])
        for q_id, _, _, _, best in groups:
            found.append((q_id[best.query], best.id, best.score))
        columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return run


def usable(column: str) -> Column:
    """Whether a vector is there and all its components are there and finite."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(False))


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 5, block_values: int = BLOCK_VALUES) -> DataFrame:
    """The ``k`` vectors of largest integer inner product with each query, ties to the smaller vec_id.

    ``vectors`` and ``queries``: vec_id, embedding (array of float or double; other columns are ignored). Each component x counts
    as floor(256 * x); products beyond 64 bits saturate. Returns query_id, rank (from 1), vec_id, score; fewer than ``k`` rows for
    a query with fewer candidates. A vector is never a candidate of the query with its own vec_id.

    Edge cases: vectors that are null or hold a null or non-finite component, or have a null vec_id, take no part; vectors of
    different lengths aren't compared; repeated rows are candidates each (rows that repeat a query's vec_id ask once); empty
    vectors score 0; an empty table gives an empty result.
    """
    tune(spark)
    shape = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    candidates = vectors.select(*shape).where(usable("embedding") & F.col("vec_id").isNotNull())
    asked = queries.select(*shape).where(usable("embedding") & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    probe = candidates.limit(PROBE).toPandas()
    scratch, out = Scratch(spark, "top-k"), None
    for i, block in enumerate(_blocks(asked, block_values)):
        shared = []
        for d in sorted({len(v) for _, v in block}):
            q_id = np.array([a for a, v in block if len(v) == d], np.int64)
            q = _exact(np.array([v for _, v in block if len(v) == d], np.float64).reshape(len(q_id), d))
            best = Best(len(q_id), k, np.full(len(q_id), -np.inf))
            same = [j for j, v in enumerate(probe["embedding"]) if len(v) == d]
            if d and same:
                x = _exact(np.array([probe["embedding"][j] for j in same], np.float64))
                finer = [segments(x, p) for p in LEVELS]
                for at in range(0, len(q_id), 256):
                    view = Best(0, k, best.floor[at : at + 256])
                    search(view, q[at : at + 256], q_id[at : at + 256], [segments(q[at : at + 256], p) for p in LEVELS], x, probe["vec_id"].to_numpy()[same], finer)
                    best.add(view.query + at, view.score, view.id)
            shared.append((q_id, q, best.floor))
        part = candidates.mapInArrow(trimmed(_partition(spark.sparkContext.broadcast(shared), k)), "query_id long, vec_id long, score long")
        done = scratch.write(part, f"block-{i}")
        out = done if out is None else out.unionByName(done)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # at most k rows a query and partition; Spark cuts each partition's, and then each query's, to k before a whole window is seen
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(queries: DataFrame, limit: int) -> Iterator[list[tuple[int, list[float]]]]:
    block, size = [], 0
    for vec_id, vector in queries.toLocalIterator():
        if block and size + len(vector) + 1 > limit:
            yield block
            block, size = [], 0
        block.append((vec_id, vector))
        size += len(vector) + 1
    if block:
        yield block
