"""Approximate nearest neighbours by collision counting.

Every vector is projected on m random directions and each direction's values are kept in one sorted array. A query
opens a window centred on its own value in each array; a vector that lies in at least `threshold` of the m windows is
verified by its exact measure. Virtual rehashing widens all windows by a ratio until enough vectors are verified or
the windows hold everything; since collisions only grow, the first such width is searched from a guess. A window is a
run of places, so collisions are counted by the places that each vector has in the arrays. For inner products vectors get one more component that brings all to one norm, so the nearest by
distance is the one with the largest product.

Rows lie in blocks of bounded size, each with its own arrays; blocks of queries meet blocks of rows. Every row is
indexed and every query visits every block, so a block's best are complete for it and the best of all blocks follow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle


def usable(c: Column) -> Column:
    """Not null, not empty, not zero, and all components there and finite."""
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return c.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(c, lambda x: x != 0)


class CollisionIndex:
    """Sorted single-projection arrays over one block of rows."""

    def __init__(self, vectors: np.ndarray, top_norm: float, projections: int, seed: int):
        n, d = vectors.shape
        self.vectors, self.m = vectors, projections
        self.lift = np.sqrt(np.maximum(0.0, top_norm**2 - (vectors**2).sum(1)))
        self.axes = np.random.default_rng(seed).normal(size=(projections, d + 1)) / max(top_norm, 1e-300)
        values = self.axes[:, :d] @ vectors.T + self.axes[:, d:] * self.lift[None, :]
        order = np.argsort(values, axis=1, kind="stable")
        self.ordered = np.take_along_axis(values, order, 1)
        self.kind = np.uint16 if n < 1 << 16 else np.uint32
        self.place = np.empty((projections, n), self.kind)  # of each row in each array
        np.put_along_axis(self.place, order, np.arange(n, dtype=self.kind)[None, :], 1)

    def windows(self, centres: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows of all queries begin and end, in each array."""
        lo, hi = np.empty(centres.shape, np.int64), np.empty(centres.shape, np.int64)
        for i, ordered in enumerate(self.ordered):
            lo[:, i] = np.searchsorted(ordered, centres[:, i] - half, "left")
            hi[:, i] = np.searchsorted(ordered, centres[:, i] + half, "right")
        return lo, hi

    def collided(self, lo: np.ndarray, hi: np.ndarray, threshold: int) -> np.ndarray:
        """The rows that lie in at least `threshold` of one query's windows."""
        # place - lo wraps around for places before the window
        inside = self.place - lo.astype(self.kind)[:, None] < np.minimum(hi - lo, np.iinfo(self.kind).max).astype(self.kind)[:, None]
        return np.flatnonzero(inside.view(np.uint8).sum(0, dtype=np.uint8 if self.m < 256 else np.uint32) >= threshold)

    def candidates(self, queries: np.ndarray, enough: int, threshold: int, width: float, ratio: float) -> list[np.ndarray]:
        """Per query: rows that collide with it in at least `threshold` windows of the first width, of width * ratio**j, that gives `enough`."""
        n, found = len(self.vectors), [np.zeros(0, np.int64)] * len(queries)
        if enough >= n:
            return [np.arange(n)] * len(queries)
        with np.errstate(invalid="ignore", over="ignore"):
            centres = queries @ self.axes[:, :-1].T  # a query's own lift is 0: it is scaled to the top norm by the caller
        exact = np.isfinite(centres).all(1)
        for q in np.flatnonzero(~exact).tolist():  # norms beyond a double: every row is verified
            found[q] = np.arange(n)
        at = np.flatnonzero(exact)
        if not len(at):
            return found
        widest = np.maximum(self.ordered[:, -1] - centres[at], centres[at] - self.ordered[:, 0]).max(1)
        last = np.maximum(0, np.ceil(np.log(np.maximum(widest / (width / 2), 1e-300)) / np.log(ratio)).astype(np.int64) + 1)  # holds everything
        least, most = np.full(len(at), -1), last.copy()  # too narrow; wide enough
        found_at = {i: np.arange(n) for i in range(len(at))}
        step, guess = np.ones(len(at), np.int64), last // 2
        for some in (np.arange(min(8, len(at))), np.arange(min(8, len(at)), len(at))):  # the first few show where the others begin
            if len(some) and some[0]:
                guess[some] = np.clip(int(np.median(most[: some[0]])), 0, last[some] - 1)
            while len(some := some[most[some] - least[some] > 1]):
                guess[some] = np.clip(guess[some], least[some] + 1, most[some] - 1)
                lo, hi = self.windows(centres[at[some]], width / 2 * ratio ** guess[some].astype(float))
                for i, a, b in zip(some.tolist(), lo, hi):
                    hit = self.collided(a, b, threshold)
                    if len(hit) >= enough:
                        most[i], found_at[i] = guess[i], hit
                        known = least[i] >= 0
                        ahead = guess[i] - step[i]
                    else:
                        least[i] = guess[i]
                        known = most[i] < last[i]
                        ahead = guess[i] + step[i]
                    guess[i], step[i] = (least[i] + most[i]) // 2 if known else ahead, 2 * step[i]
        for i, q in enumerate(at.tolist()):
            found[q] = found_at[i]
        return found


def nearest(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", projections: int = 128, verify: int = 600, threshold: float = 0.9, width: float = 1.0, ratio: float = 1.02, row_block: int = 4096, query_block: int = 8192, seed: int = 4) -> DataFrame:
    """query_id, rank (from 1), id, score: the k largest inner products found for each query row, its own row left out.

    `queries`: a condition on df that picks the query rows. A block's windows widen until `verify` of its rows (more than
    k at least) collide in `threshold` of the projections and are verified; the score is the exact inner product in
    double precision on the original vectors. Nearest first, ties to the smaller id. Vectors that are null, empty, zero or
    hold null or non-finite components take no part, nor rows without an id, nor candidates of another length than the
    query's. Repeated rows are rows of their own, but an id is never its own neighbour. Blocks without candidates give
    nothing; fewer than k candidates are all returned. Other columns are not read.
    """
    spark = df.sparkSession
    src = df.where(df[id_col].isNotNull() & usable(df[vec_col])).select(df[id_col].cast("long").alias("id"), df[vec_col].cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    src = settle(src.withColumn("d", F.size("v")), "ann-rows")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, nq, top = src.agg(F.count("*"), F.coalesce(F.sum(F.col("q").cast("long")), F.lit(0)), F.max(norm)).first()
    rb, qb = max(1, -(-n // row_block)), max(1, -(-nq // query_block))
    place = F.xxhash64(F.lit(seed), "id", F.monotonically_increasing_id())
    rows = src.select("id", "v", "d", F.pmod(place, F.lit(rb)).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"))
    asks = src.where("q").select("id", "v", "d", F.pmod(place, F.lit(qb)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(rb - 1))).alias("rb"))
    top = float(top or 1.0)

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        ids = rows["id"].to_numpy()
        dims, qdims, qids = rows["d"].to_numpy(), queries["d"].to_numpy(), queries["id"].to_numpy()
        for d in np.unique(qdims).tolist():
            at, asked = np.flatnonzero(dims == d), np.flatnonzero(qdims == d)
            if not len(at):
                continue
            order = at[np.argsort(ids[at], kind="stable")]
            own = ids[order]
            x = np.array(rows["v"].take(pa.array(order)).combine_chunks().flatten()).reshape(-1, d)
            q = np.array(queries["v"].take(pa.array(asked)).combine_chunks().flatten()).reshape(-1, d)
            index = CollisionIndex(x, top, projections, seed)
            enough = max(k + 1, verify)
            collided = index.candidates(q * (top / np.linalg.norm(q, axis=1))[:, None], enough, max(1, int(threshold * projections)), width, ratio)
            for i, v, found in zip(asked.tolist(), q, collided):
                found = found[own[found] != qids[i]]
                score = x[found] @ v
                if len(found) > k:  # all that tie with the k-th stay until they are ordered
                    least = np.partition(score, len(score) - k)[len(score) - k]
                    some = score >= least
                    found, score = found[some], score[some]
                best = np.lexsort((own[found], -score))[:k]
                out += zip([qids[i]] * len(best), own[found[best]].tolist(), score[best].tolist())
        a, b, c = zip(*out) if out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    found = asks.groupBy("qb", "rb").cogroup(rows.groupBy("qb", "rb")).applyInArrow(lambda q, r: search(q, r), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


def op4_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(e, F.col("vec_id") % 20 == 0)
