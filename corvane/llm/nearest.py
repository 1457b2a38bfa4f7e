"""Approximate nearest neighbours by inner product, with collision-counting hashing.

Vectors get one more component that makes their norms equal, and queries a zero there, so the largest
inner product is the smallest distance.  Each of PROJECTIONS random lines gives a hash, a
vector's projection, and each shard of vectors keeps one sorted array for each line.  For a query,
windows centred on its own projections grow by virtual rehashing, a factor of GROWTH a round; a vector
that falls into the windows of at least THRESHOLD of the lines is verified by its true inner
product.  A query is done when its k-th best is nearer than the windows' radius, or when the windows
hold everything; nothing else ends it, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_tasks

PROJECTIONS = 48
#: Half a window for a radius of 1, and the share of lines on which a vector must collide.
HALF_WINDOW, THRESHOLD = 1.36, 0.65
GROWTH, FIRST_RADIUS = 1.2, 0.7
#: Vectors of a shard: at most, and at least where tasks would be idle.
MOST, LEAST = 1 << 18, 1 << 13
QUERIES_AT_ONCE = 64


class CollisionIndex:
    """The sorted projections of a shard's vectors, divided by `unit`, the largest norm."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, unit: float, seed: int = 20):
        self.ids, self.vectors, self.unit = ids, vectors, unit
        n, d = vectors.shape
        vectors = vectors / unit
        self.lines = np.random.default_rng(seed).standard_normal((d + 1, PROJECTIONS))
        rest = np.sqrt(np.maximum(1 - (vectors**2).sum(axis=1), 0))
        hashes = vectors @ self.lines[:-1] + rest[:, None] * self.lines[-1]
        self.order = np.argsort(hashes, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(hashes.T, self.order, axis=1)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, exact: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, ids, inner products) of the k best that were verified, best first; with exact, all are."""
        original, queries = queries, queries / self.unit
        centre = queries @ self.lines[:-1]
        lengths, n = (queries**2).sum(axis=1), len(self.ids)
        needed = 0 if exact else int(np.ceil(THRESHOLD * PROJECTIONS))
        counts = np.zeros((len(queries), n), np.uint8)
        lo = np.stack([np.searchsorted(s, c) for s, c in zip(self.sorted, centre.T)])
        hi = lo.copy()
        scores = np.full((len(queries), n), -np.inf)
        open_, radius = np.arange(len(queries)), FIRST_RADIUS
        verified = np.zeros(len(queries), np.int64)
        while len(open_):
            low = np.stack([np.searchsorted(s, c - HALF_WINDOW * radius) for s, c in zip(self.sorted, centre.T[:, open_])])
            high = np.stack([np.searchsorted(s, c + HALF_WINDOW * radius, "right") for s, c in zip(self.sorted, centre.T[:, open_])])
            left = []
            for i, q in enumerate(open_):
                parts = []
                for o, a, b, c, d in zip(self.order, low[:, i].tolist(), lo[:, q].tolist(), hi[:, q].tolist(), high[:, i].tolist()):
                    if a < b:
                        parts.append(o[a:b])
                    if c < d:
                        parts.append(o[c:d])
                if parts:
                    counts[q] += np.bincount(np.concatenate(parts), minlength=n).astype(np.uint8)
                lo[:, q], hi[:, q] = np.minimum(lo[:, q], low[:, i]), np.maximum(hi[:, q], high[:, i])
                new = np.flatnonzero((counts[q] >= needed) & (scores[q] == -np.inf))
                if len(new):
                    scores[q, new] = self.vectors[new] / self.unit @ queries[q]
                    verified[q] += len(new)
                done = verified[q] >= n
                if not done and verified[q] > k:
                    own = scores[q] if not (self.ids == query_ids[q]).any() else np.where(self.ids == query_ids[q], -np.inf, scores[q])
                    kth = np.partition(own, n - k)[n - k] if n >= k else -np.inf
                    done = kth > -np.inf and 1 + lengths[q] - 2 * kth <= radius**2
                if not done and not (low[:, i].any() or (high[:, i] < n).any()):
                    done = True  # the windows hold everything
                if not done:
                    left.append(q)
            open_, radius = np.array(left, np.int64), radius * GROWTH
        for q in range(len(queries)):
            own = np.flatnonzero((scores[q] > -np.inf) & (self.ids != query_ids[q]))
            if len(own) > k:  # all that tie with the k-th stay, but for rounding
                kth = np.partition(scores[q, own], len(own) - k)[len(own) - k]
                own = own[scores[q, own] >= kth - 1e-9 * max(1.0, abs(kth))]
            # summed row by row, so equal vectors have equal scores
            with np.errstate(over="ignore", invalid="ignore"):
                found = (self.vectors[own] * original[q]).sum(axis=1)
            order = np.lexsort((self.ids[own], -found))[:k]
            yield query_ids[q], self.ids[own[order]], found[order]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v, an array of doubles, of vectors with finite components, not all zero."""
    v = F.col(vector_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    return rows.where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shards: int | None = None, exact: bool = False) -> DataFrame:
    """Each query's k nearest found: query_id, rank (from 1), vec_id, score.  With exact, all vectors are verified.

    Every vector is in one shard's index; every shard sees every query, in blocks, and gives its k
    best; these are merged by query.  Scores are inner products in double precision; ties go to the
    smaller vec_id; a query is never its own neighbour.  Of rows that repeat a vec_id the one of the least vector
    counts, among vectors and among queries.  Vectors null, zero, holding null or
    non-finite components, of another length than the most common, or without an id take no part; an empty
    table, or no queries, gives no rows.  Other columns are not read.  Projections are of vectors divided by the largest
    norm, so large ones don't overflow there; a score that overflows is infinite.
    """
    spark = vectors.sparkSession
    good = usable(vectors, id_col, vector_col)
    # a row's norm by way of its largest component, so that no square overflows
    most = F.array_max(F.transform("v", F.abs))
    norm = most * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / most) * (x / most)))
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.least(norm, F.lit(1e308))).alias("unit"))
    found = sizes.orderBy(F.desc("n"), "d").limit(1).collect()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n, unit = found[0]
    shards = shards or max(-(-n // MOST), min(n_tasks(spark), -(-n // LEAST)))
    own = good.where(F.size("v") == d).select(F.pmod(F.hash("vec_id"), F.lit(shards)).alias("shard"), F.lit(0).alias("asks"), "vec_id", "v")
    asked = usable(queries, id_col, vector_col).where(F.size("v") == d)
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"), "vec_id", "v")
    dealt = own.unionByName(sent).repartition(shards, "shard").sortWithinPartitions("shard", "asks", "vec_id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, index, held, last = None, None, [], None

        def matrix(batch: pa.RecordBatch) -> np.ndarray:
            return batch.column(3).flatten().to_numpy().reshape(-1, d)

        for batch in batches:
            keys = batch.column(0).to_numpy()
            for key in np.unique(keys):
                part = batch.slice(int(np.searchsorted(keys, key)), int((keys == key).sum()))
                if key != shard:
                    shard, index, held, last = key, None, [], None
                # of rows that repeat an id the first stays
                same = np.stack([part.column(1).to_numpy(), part.column(2).to_numpy()], axis=1)
                new = np.any(same != np.concatenate([[same[0] if last is None else last], same[:-1]]), axis=1)
                new[0] |= last is None
                part, last = part.filter(pa.array(new)), same[-1]
                asks = part.column(1).to_numpy()
                first = int(np.searchsorted(asks, 1))
                if first:
                    held.append((part.column(2).to_numpy()[:first], matrix(part)[:first]))
                for a in range(first, len(asks), QUERIES_AT_ONCE):
                    if index is None and held:
                        index, held = CollisionIndex(*(np.concatenate(x) for x in zip(*held)), unit), []
                    if index is None:
                        break
                    ask = part.slice(a, QUERIES_AT_ONCE)
                    for q, ids, scores in index.search(ask.column(2).to_numpy(), matrix(ask), k, exact):
                        yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.full(len(ids), q), pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.float64())})

    local = dealt.mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
