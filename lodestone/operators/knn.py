"""Exact nearest neighbours with filters before the search and blocks skipped without loss.

Rows gather around pivots: each belongs to its nearest one. By the triangle inequality no row of a block is nearer to a
query than the query's distance to the pivot less the block's radius. Every query first visits its nearest blocks, until
they hold k rows; the k-th best found there is a bound, and of the others only blocks that may hold something nearer are
visited. Cosine distances are looked at as distances of unit vectors, for which the inequality holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import SETTINGS
from lodestone.sources.versioned import settle

#: Rounding of scores, and of doubles: bounds are widened by this much, so that no tie is lost.
SLACK = 2e-6


def matrix(t: pa.Table | pa.RecordBatch, dim: int) -> np.ndarray:
    col = t["v"].combine_chunks() if isinstance(t, pa.Table) else t.column(t.schema.get_field_index("v"))
    return np.array(col.flatten(), np.float64).reshape(-1, dim)


def units(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x


def gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)))


@dataclass
class Pivots:
    """What is known of the blocks: one value a pivot."""

    metric: str
    dim: int
    pivots: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    subs: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """At least how far each query is from the rows of each block."""
        return np.maximum(0.0, gaps(units(q, self.metric), self.pivots) - self.radii[None, :] - SLACK)

    def first(self, low: np.ndarray, k: int) -> np.ndarray:
        """Which blocks each query visits first: by rising bound until they hold k rows."""
        order = np.argsort(low, axis=1, kind="stable")
        held = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        out = np.zeros(low.shape, bool)
        np.put_along_axis(out, order, held < k, 1)
        return out & (self.sizes > 0)[None, :]


@dataclass
class Blocks:
    """Rows by pivot (chunk_id, file_id, v, block, sub)."""

    rows: DataFrame
    at: Pivots


def build(vectors: DataFrame, dim: int, metric: str = "cosine", pivots: int = 128, row_block: int = 4096, seed: int = 3) -> Blocks:
    """vectors (chunk_id, file_id, v: array). Null vectors, those of another length than `dim`, of components that are null or not finite, and under cosine zero vectors are passed over.

    The pivots are the `pivots` rows with the smallest hashes: that many rows are all that the driver sees.
    """
    v = F.col("v").cast("array<double>")
    fine = (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = fine & F.exists("v", lambda x: x != 0) if metric == "cosine" else fine
    rows = vectors.select("chunk_id", F.col("file_id").cast("string").alias("file_id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))
    sample = rows.orderBy(F.xxhash64(F.lit(seed), "chunk_id")).limit(pivots).select("v").collect()
    centres = units(np.array([r.v for r in sample], np.float64).reshape(-1, dim), metric)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = gaps(units(matrix(b, dim), metric), centres)
            block = far.argmin(1) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block, pa.int32()), pa.array(far[np.arange(len(block)), block], pa.float64())], names=[*b.schema.names, "block", "far"])

    if not len(centres):
        return Blocks(rows.select("*", F.lit(0).alias("block"), F.lit(0).alias("sub")), Pivots(metric, dim, centres, *[np.zeros(0)] * 3))
    told = rows.schema.simpleString()[7:-1]
    near = settle(rows.mapInArrow(assign, f"{told.replace(':', ' ', 3)}, block int, far double"), "knn-rows")
    sizes, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in near.groupBy("block").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # one row a pivot
        sizes[r.block], radii[r.block] = r.n, r.far
    subs = np.maximum(1, -(-sizes // row_block))
    sub = F.pmod(F.xxhash64(F.lit(seed), "chunk_id"), F.get(F.array(*[F.lit(int(s)) for s in subs]), F.col("block"))).cast("int")
    return Blocks(near.select("chunk_id", "file_id", "v", "block", sub.alias("sub")), Pivots(metric, dim, centres, sizes, radii, subs))


def visits(queries: DataFrame, blocks: Pivots, k: int, bounded: bool) -> DataFrame:
    """queries (query_id, v, only, never; with `bounded` also far: the k-th best so far or null) -> the same columns, block and sub of each visit."""
    keep = ["query_id", "only", "never", "v"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            low = blocks.bounds(matrix(b, blocks.dim))
            may = blocks.first(low, k)
            if bounded:
                far = b.column(b.schema.get_field_index("far")).to_numpy(zero_copy_only=False).astype(float)
                may = ~may & (np.isnan(far)[:, None] | (low <= reach(far, blocks.metric)[:, None])) & (blocks.sizes > 0)[None, :]
            q, at = np.nonzero(may)
            q, at = np.repeat(q, blocks.subs[at]), np.repeat(at, blocks.subs[at])
            sub = np.arange(len(q)) - np.searchsorted(q * len(blocks.sizes) + at, q * len(blocks.sizes) + at)
            some = [b.column(b.schema.get_field_index(c)).take(pa.array(q)) for c in keep]
            yield pa.RecordBatch.from_arrays([*some, pa.array(at, pa.int32()), pa.array(sub, pa.int32())], names=[*keep, "block", "sub"])

    return queries.mapInArrow(route, "query_id long, only array<string>, never array<string>, v array<double>, block int, sub int")


def reach(far: np.ndarray, metric: str) -> np.ndarray:
    """A score as a distance of (unit) vectors, widened by what rounding may hide."""
    return np.sqrt(2.0 * (np.maximum(far, 0.0) + SLACK)) + SLACK if metric == "cosine" else far + SLACK


def meet(asks: DataFrame, blocks: Blocks, k: int, query_block: int) -> DataFrame:
    """query_id, chunk_id, score: the k best of every visit. At most about query_block queries meet a block at once."""
    m = max(1, -(-asks.select("query_id").distinct().count() // query_block))
    left = asks.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(m)).cast("int"))
    right = blocks.rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    dim, metric = blocks.at.dim, blocks.at.metric

    def compare(q: pa.Table, r: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if q.num_rows and r.num_rows:
            from lodestone.operators.search import _distances

            r = r.sort_by("chunk_id")
            ids, files = r["chunk_id"].to_numpy(), np.array(r["file_id"].to_pylist(), object)
            score = _distances(matrix(q, dim), matrix(r, dim), metric)
            for i, (query, only, never) in enumerate(zip(q["query_id"].to_pylist(), q["only"].to_pylist(), q["never"].to_pylist())):
                may = np.isin(files, only) if only is not None else np.ones(len(ids), bool)
                at = np.flatnonzero(may & ~np.isin(files, never) if never else may)
                s = score[i, at]
                if len(at) > k:
                    some = s <= np.partition(s, k - 1)[k - 1]
                    at, s = at[some], s[some]
                best = np.lexsort((ids[at], s))[:k]
                out[0] += [query] * len(best)
                out[1] += ids[at[best]].tolist()
                out[2] += s[best].tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "chunk_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return left.groupBy("block", "sub", "part").cogroup(right.groupBy("block", "sub", "part")).applyInArrow(lambda q, r: compare(q, r), "query_id long, chunk_id long, score double")


def best(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("score", "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, blocks: Blocks, k: int = SETTINGS.vector_candidates, query_block: int = 1024) -> DataFrame:
    """queries (query_id, v, only, never) -> query_id, chunk_id, score (distance, to six digits), rank: the k nearest, exactly; ties to the smaller id.

    only: the files that a query may find (null: all), never: those that it may not (null: none).
    """
    asked = queries.select("query_id", "only", "never", F.col("v").cast("array<double>").alias("v")).where((F.size("v") == blocks.at.dim) & F.exists("v", lambda x: x != 0))
    if not len(blocks.at.sizes):
        return asked.select("query_id", F.lit(None).cast("long").alias("chunk_id"), F.lit(None).cast("double").alias("score"), F.lit(1).alias("rank")).limit(0)
    found = settle(best(meet(visits(asked, blocks.at, k, False), blocks, k, query_block), k), "knn-first").drop("rank")
    far = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).alias("far"))  # null: fewer than k, so nothing may be skipped
    more = meet(visits(asked.join(far, "query_id", "left"), blocks.at, k, True), blocks, k, query_block)
    return best(found.unionByName(more), k)
