"""Approximate nearest neighbours by collision counting (query-aware hashing).

Each of ``projections`` random lines orders the vectors of a block in one sorted
array. A query opens a window around its own projection in every array; a vector
in at least ``threshold`` of the windows is a candidate and is verified by its
exact cosine. The windows then grow to the next radius (virtual rehashing: only
what is new is counted) until the k-th best verified vector lies within the
radius for which a vector is expected in more than the threshold of windows. Once
k vectors are known, their distance is the largest radius that can be needed.

Vectors stay where they are read; the queries go round in bounded blocks. Every
vector takes part, no candidate is cut off, and equal vectors have equal counts.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors indexed together, and queries sent to the tasks at once (bytes).
BLOCK_ROWS, QUERY_BYTES = 8192, 1 << 20
PROJECTIONS, SHARE = 112, 0.765
#: Half the window over the radius: a vector at that distance collides in 0.826
#: of the windows.
REACH = 1.36
#: First radius, and the steps it grows by below and above 0.6 (unit vectors are
#: at most 2 apart).
FIRST, GROW_FAST, GROW_SLOW = 0.05, 2.0, 1.1


def usable(vec):
    """Column: neither null nor zero, and all components finite numbers."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


class Nearest:
    """The best k so far of each query: by score, then by smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.ids, self.scores = [np.empty(0, np.int64)] * queries, [np.empty(0)] * queries

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores])
        best = np.lexsort((ids, -scores))
        _, first = np.unique(ids[best], return_index=True)  # a repeated id counts once
        best = best[np.sort(first)[:self.k]]
        self.ids[q], self.scores[q] = ids[best], scores[best]

    def radius(self, q: int) -> float:
        """Distance of the k-th best unit vector, or infinity."""
        s = self.scores[q]
        return math.sqrt(max(0.0, 2 - 2 * s[-1])) if len(s) == self.k else math.inf


def search_block(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, lines: np.ndarray,
                 share: float, best: Nearest) -> None:
    """Find neighbours of all queries in one block and add them to ``best``."""
    n, m = len(x), lines.shape[1]
    threshold = math.ceil(share * m)
    norms, q_norms = np.sqrt((x * x).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    place = (x / norms[:, None]) @ lines
    order = np.argsort(place, axis=0, kind="stable")
    place = np.take_along_axis(place, order, 0)
    order, arrays = np.ascontiguousarray(order.T), np.ascontiguousarray(place.T)
    centre = (queries / q_norms[:, None]) @ lines
    low = np.stack([np.searchsorted(arrays[i], centre[:, i]) for i in range(m)], axis=1)
    high, live = low.copy(), np.arange(len(queries))
    counts, done = np.zeros((len(queries), n), np.int64), np.zeros((len(queries), n), bool)
    radius = np.array([FIRST if best.radius(q) == math.inf else best.radius(q) for q in live])
    while len(live):
        wide = radius[live] * REACH
        new_low = np.stack([np.searchsorted(arrays[i], centre[live, i] - wide) for i in range(m)], axis=1)
        new_high = np.stack([np.searchsorted(arrays[i], centre[live, i] + wide, "right") for i in range(m)], axis=1)
        still = []
        for at, q in enumerate(live):
            l0, l1, h0, h1 = new_low[at].tolist(), low[q].tolist(), high[q].tolist(), new_high[at].tolist()
            fresh = [order[i, l0[i]:l1[i]] for i in range(m)] + [order[i, h0[i]:h1[i]] for i in range(m)]
            counts[q] += np.bincount(np.concatenate(fresh), minlength=n)
            found = np.flatnonzero((counts[q] >= threshold) & ~done[q])
            if len(found):
                done[q, found] = True
                found = found[ids[found] != query_ids[q]]
                scores = (x[found] * queries[q]).sum(axis=1) / (norms[found] * q_norms[q])
                best.add(q, ids[found], scores)
            enough, r = best.radius(q), radius[q]
            if enough > r:
                still.append(at)
                grown = r * (GROW_FAST if r < 0.6 else GROW_SLOW) if r <= 2 else math.inf
                radius[q] = min(enough, grown)
        low[live], high[live] = new_low, new_high
        live = live[still]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
            projections: int = PROJECTIONS, share: float = SHARE, seed: int = 11) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest vectors found for
    each of ``queries`` (rows like those of ``vectors``), by largest cosine in
    double precision, ties to the smaller id.

    Vectors that are null, zero, or hold null or non-finite components take no
    part, on either side; nor do those of another length than the most common
    one. A row without an id is neither query nor found. A vector is no neighbour
    of a query with its id; a repeated id is found once. With fewer than ``k``
    vectors all are returned; empty tables give an empty result."""
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        return (df.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull())
                .select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")))

    data = clean(vectors)
    common = data.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "query_id long, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = common["d"]
    data = data.where(F.size("vec") == dims)
    asked = materialize(clean(queries).where(F.size("vec") == dims).dropDuplicates(["id"]), "ann-queries")
    passes = max(1, math.ceil(asked.count() * dims * 8 / QUERY_BYTES))
    lines = np.random.default_rng(seed).standard_normal((dims, projections))

    found = None
    for p in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == p).orderBy("id").collect()  # about QUERY_BYTES
        if not rows:
            continue
        shared = spark.sparkContext.broadcast((np.array([r["id"] for r in rows], np.int64), np.array([r["vec"] for r in rows])))
        part = data.mapInArrow(_searcher(shared, lines, share, k, dims), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # a task returns at most k rows a query: this groups k rows for each task
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(shared, lines: np.ndarray, share: float, k: int, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        best, held, size = Nearest(len(queries), k), [], 0

        def search():
            ids = np.concatenate([i for i, _ in held])
            x = np.concatenate([v for _, v in held])
            for a in range(0, len(ids), BLOCK_ROWS):
                search_block(x[a:a + BLOCK_ROWS], ids[a:a + BLOCK_ROWS], queries, query_ids, lines, share, best)
            held.clear()

        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, dims)))
                size += b.num_rows
                if size >= BLOCK_ROWS:
                    search()
                    size = 0
        if held:
            search()
        n = np.fromiter(map(len, best.ids), np.int64, len(query_ids))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, n)), pa.array(np.concatenate(best.ids) if len(n) else []),
                                          pa.array(np.concatenate(best.scores) if len(n) else [])], ["query_id", "vec_id", "score"])

    return run
