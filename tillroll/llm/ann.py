"""Approximate nearest neighbours by query-aware collision counting.

Vectors are dealt into blocks and queries into chunks; every block meets
every chunk once (a stated query set against all rows, in blocks).  A block
keeps one sorted array for each of ``PROJECTIONS`` random projections.  A
query opens a window around its own projection in every array and widens all
of them by ``WIDEN`` a round (virtual rehashing); a vector seen in at least
``THRESHOLD`` of the windows is verified by its exact distance.  A query stops
when its k-th verified distance is within the radius that the windows cover,
or when the windows hold the whole block.  No number of candidates or
verified vectors is capped.

A vector within the radius falls in a window with chance 0.82 (half width
1.35 radii), so it passes the threshold of 0.72 with chance about 0.97.

Defined results: vectors that are null, empty, zero or hold null or
non-finite components take no part, neither do null ids; vectors are compared
with those of the same length only; of rows that repeat an id one (the
smallest vector) counts; equal distances go to the smaller id; fewer than k
candidates give them all; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

PROJECTIONS = 48
THRESHOLD = 0.72
HALF_WIDTH = 1.35
WIDEN = 1.3
#: First half width, in standard deviations of the projections.
FIRST = 0.15
BLOCK_ROWS = 16_384
CHUNK_QUERIES = 4_096


@lru_cache(maxsize=4)
def _directions(dim: int) -> np.ndarray:
    return np.random.default_rng(97).standard_normal((dim, PROJECTIONS))


class Block:
    """Sorted projection arrays over some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        p = vectors @ _directions(vectors.shape[1])
        order = np.argsort(p, axis=0, kind="stable")
        self.values = [p[order[:, j], j] for j in range(PROJECTIONS)]
        self.order = [order[:, j].astype(np.int32) for j in range(PROJECTIONS)]
        self.unit = float(p.std(axis=0).mean()) or 1.0

    def search(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest found, nearest first."""
        n = len(self.ids)
        mine = q @ _directions(len(q))
        need = math.ceil(THRESHOLD * PROJECTIONS)
        seen = np.zeros(n, np.int16)
        verified = np.zeros(n, bool)
        verified[self.ids == query_id] = True  # the query's own row is no candidate
        found: list[np.ndarray] = []
        distance: list[np.ndarray] = []
        lo = hi = None
        half = FIRST * self.unit
        while True:
            new_lo = [int(np.searchsorted(v, x - half, side="left")) for v, x in zip(self.values, mine)]
            new_hi = [int(np.searchsorted(v, x + half, side="right")) for v, x in zip(self.values, mine)]
            if lo is None:
                fresh = [o[a:b] for o, a, b in zip(self.order, new_lo, new_hi)]
            else:
                fresh = [o[a:b] for o, a, b in zip(self.order, new_lo, lo)] \
                    + [o[a:b] for o, a, b in zip(self.order, hi, new_hi)]
            lo, hi = new_lo, new_hi
            seen += np.bincount(np.concatenate(fresh), minlength=n).astype(np.int16)
            hit = np.flatnonzero((seen >= need) & ~verified)
            if len(hit):
                verified[hit] = True
                found.append(hit)
                distance.append(np.sqrt(((self.vectors[hit] - q) ** 2).sum(axis=1)))
            whole = all(a == 0 and b == n for a, b in zip(lo, hi))
            if found:
                at, d = np.concatenate(found), np.concatenate(distance)
                if whole or len(d) >= k and np.partition(d, k - 1)[k - 1] <= half / HALF_WIDTH:
                    best = np.lexsort((self.ids[at], d))[:k]
                    return self.ids[at][best], d[best]
            elif whole:
                return np.empty(0, np.int64), np.empty(0)
            half *= WIDEN


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def _matrix(t: pa.Table, id_name: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, one row an id."""
    ids = t.column(id_name).to_numpy()
    flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    m = flat.reshape(len(ids), -1).astype(np.float64)
    order = np.lexsort((*m.T[::-1], ids))
    ids, m = ids[order], m[order]
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    return ids[first], m[first]


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id",
                       vector_col: str = "embedding", block_rows: int = BLOCK_ROWS,
                       chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest
    found of every row for which ``is_query`` holds, among all other rows."""
    # Null components turn to NaN, which _usable has already refused.
    usable = vectors.where(_usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = usable.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"),
                         is_query.alias("is_query"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("q")).first()
    blocks, chunks = max(1, math.ceil(size["n"] / block_rows)), max(1, math.ceil(size["q"] / chunk_queries))
    cell = [F.size("v").alias("dim")]
    stored = rows.select(*cell, "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"),
                         F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    asked = rows.where("is_query").select(*cell, F.col("vec_id").alias("query_id"), "v",
                                          F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(chunks)).alias("chunk"),
                                          F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    keys = ["dim", F.col("block").cast("long").alias("block"), F.col("chunk").cast("long").alias("chunk")]
    schema = "query_id long, vec_id long, score double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_v, out_d = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if left.num_rows and right.num_rows:
            block = Block(*_matrix(left, "vec_id"))
            for query_id, q in zip(*_matrix(right, "query_id")):
                ids, d = block.search(int(query_id), q, k)
                out_q.append(np.full(len(ids), query_id, np.int64))
                out_v.append(ids.astype(np.int64))
                out_d.append(d)
        return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v),
                         "score": np.concatenate(out_d)})

    stored = stored.select(*keys, "vec_id", "v").groupBy("dim", "block", "chunk")
    asked = asked.select(*keys, "query_id", "v").groupBy("dim", "block", "chunk")
    near = stored.cogroup(asked).applyInArrow(run, schema)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
