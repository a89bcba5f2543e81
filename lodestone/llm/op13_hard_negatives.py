"""Hard negatives by a two-dimensional block matrix product (SUMMA-style).

Anchors and rows are cut both ways: into blocks of vectors and into chunks of dimensions. Chunk k of anchor block i meets
chunk k of row block j; the product is a partial tile of int64 scores. Partial tiles are shuffled to their (i, j) and added
there, and each whole tile is reduced at once to the best of every anchor, or of every anchor-positive window. So no task
holds more than one tile, whatever the number of vectors or dimensions.

Blocks hold one length of vectors and one group of labels. Positives need tiles of equal groups only; negatives then take
all tiles but those in which every row has its anchors' label.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle

_TILE = "i int, j int, k int, anchors binary, anchor_labels binary, ids binary, labels binary, tile binary"


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64, exactly: in doubles while no sum can leave their 53 bits, else in int64."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def scaled(df: DataFrame, id_col: str, vec_col: str, label: Column, scale: int) -> DataFrame:
    """id, label, d, v (floor(scale * x), long) of the rows that take part; of rows that share an id the one with the smallest (label, vector)."""
    x = F.transform(vec_col, lambda c: c.cast("double"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    src = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x"))
    src = src.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.coalesce(finite, F.lit(False)))
    fits = F.forall("x", lambda c: F.abs(c) < F.sqrt(F.lit(2.0**62) / F.size("x")) / scale)  # else a score could leave 64 bits
    src = src.where((F.size("x") > 0) & fits).select("id", "label", F.transform("x", lambda c: F.floor(scale * c).cast("long")).alias("v"))
    one = src.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"))
    return one.select("id", "r.label", "r.v", F.size("r.v").alias("d"))


def blocked(rows: DataFrame, place: str, rows_each: int, seed: int) -> DataFrame:
    """rows plus `place`: the number of their block. Each kind (d, label group) has blocks of its own, of about rows_each rows."""
    sizes = rows.groupBy("d", "g").agg(F.count("*").alias("n")).select("d", "g", F.ceil(F.col("n") / F.lit(rows_each)).cast("int").alias("blocks"))
    kinds = sorted((r.d, r.g, r.blocks) for r in sizes.collect())  # one row a kind: lengths x label groups
    first, table = 0, []
    for d, g, blocks in kinds:
        table.append((d, g, blocks, first))
        first += blocks
    known = rows.sparkSession.createDataFrame(table, "d int, g int, blocks int, first int")
    own = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("blocks")) + F.col("first")).cast("int")
    return rows.join(F.broadcast(known), ["d", "g"]).withColumn(place, own).drop("blocks", "first")


def packed(rows: DataFrame, place: str, chunk: int) -> DataFrame:
    """One row a block and chunk of dimensions: place, d, g, k, ids, labels, m (all int64, as bytes); and pure: its only label, or null."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        d = t["d"][0].as_py()
        v = np.array(t["v"].combine_chunks().flatten(), np.int64).reshape(-1, d)
        ids, labels = t["id"].to_numpy().astype(np.int64), t["label"].to_numpy().astype(np.int64)
        only = int(labels[0]) if (labels == labels[0]).all() else None
        out = [(t[place][0].as_py(), d, t["g"][0].as_py(), k, ids.tobytes(), labels.tobytes(), np.ascontiguousarray(v[:, a : a + chunk]).tobytes(), only) for k, a in enumerate(range(0, d, chunk))]
        return pa.table([pa.array(c, f) for c, f in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()))], names=names)

    names = [place, "d", "g", "k", "ids", "labels", "m", "pure"]
    return rows.groupBy(place).applyInArrow(pack, f"{place} int, d int, g int, k int, ids binary, labels binary, m binary, pure long")


def tiles(anchors: DataFrame, rows: DataFrame, met: DataFrame) -> DataFrame:
    """Partial tiles of the block pairs `met` (i, j): chunk k of anchors i times chunk k of rows j. A row and a column of blocks go out along the grid."""
    left = anchors.join(met, "i").select("i", "j", "k", F.col("ids").alias("anchors"), F.col("labels").alias("anchor_labels"), F.col("m").alias("a"))
    right = rows.join(met, "j").select("i", "j", "k", "ids", "labels", F.col("m").alias("b"))

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], f) for f in kinds], names=names)
        x, y = a.to_pylist()[0], b.to_pylist()[0]
        first = x["k"] == 0  # ids and labels travel with one of a pair's tiles
        n, m = len(x["anchors"]) // 8, len(y["ids"]) // 8
        tile = product(np.frombuffer(x["a"], np.int64).reshape(n, -1), np.frombuffer(y["b"], np.int64).reshape(m, -1))
        return pa.table([pa.array([v], f) for v, f in zip((x["i"], x["j"], x["k"], *[z if first else None for z in (x["anchors"], x["anchor_labels"], y["ids"], y["labels"])], tile.tobytes()), kinds)], names=names)

    names = ["i", "j", "k", "anchors", "anchor_labels", "ids", "labels", "tile"]
    kinds = [pa.int32()] * 3 + [pa.binary()] * 5
    return left.groupBy("i", "j", "k").cogroup(right.groupBy("i", "j", "k")).applyInArrow(lambda a, b: multiply(a, b), _TILE)


def summed(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The partial tiles of one (i, j), added: anchors, their labels, ids, labels, scores."""
    names = ("anchors", "anchor_labels", "ids", "labels")
    known = {c: x for c in names for x in [next(x.as_py() for x in t[c] if x.is_valid)]}
    a, al, ids, labels = (np.frombuffer(known[c], np.int64) for c in names)
    total = np.zeros((len(a), len(ids)), np.int64)
    for x in t["tile"]:
        total += np.frombuffer(x.as_buffer(), np.int64).reshape(total.shape)
    return a, al, ids, labels, total


def best(score: np.ndarray, ids: np.ndarray, may: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores that may be taken, best first, ties to the smaller id."""
    at = np.flatnonzero(may)
    if len(at) > k:
        s = score[at]
        at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def first_ranked(found: DataFrame, keys: list[str], score: str, other: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), other)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | str = "label", scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, anchor_block: int = 512, row_block: int = 4096, chunk: int = 32, groups: int = 16, seed: int = 13) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    `anchors`: a condition on `id_col` that picks the anchors. Positives: the first other rows of the anchor's label.
    Negatives of a positive: the first rows of other labels with low * positive <= 100 * score <= high * positive.
    Scores are integer inner products of floor(scale * x); higher first, ties to the smaller id; all there are, if fewer.

    Rows with a null id, label, vector or component, a component that is not finite or so large that a score could leave 64
    bits, or an empty vector take no part. Of rows that share an id one counts: that with the smallest (label, vector).
    Zero vectors take part. Only vectors of one length meet. Other columns are not read. No rows give no result.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = scaled(df, id_col, vec_col, label, scale).withColumn("g", F.pmod(F.xxhash64("label"), F.lit(groups)).cast("int"))
    rows = settle(blocked(rows, "j", row_block, seed), "negatives-rows")
    asked = rows.withColumnRenamed("id", id_col).where(anchors).withColumnRenamed(id_col, "id").drop("j")
    asked = settle(blocked(asked, "i", anchor_block, seed + 1), "negatives-anchors")
    a, b = settle(packed(asked, "i", chunk), "negatives-anchor-blocks"), settle(packed(rows, "j", chunk), "negatives-row-blocks")
    ai, bj = a.where("k = 0").select("i", "d", F.col("g").alias("ag"), F.col("pure").alias("ap")), b.where("k = 0").select("j", "d", "g", F.col("pure").alias("bp"))
    pairs = settle(ai.join(bj, "d").select("i", "j", (F.col("ag") == F.col("g")).alias("near"), F.coalesce(F.col("ap") == F.col("bp"), F.lit(False)).alias("same")), "negatives-grid")  # two numbers a tile

    def positive(t: pa.Table) -> pa.Table:
        a, al, ids, labels, total = summed(t)
        out: list[tuple] = []
        for x, lab, score in zip(a.tolist(), al.tolist(), total):
            at = best(score, ids, (labels == lab) & (ids != x), positives)
            out += zip([x] * len(at), ids[at].tolist(), score[at].tolist())
        x, y, s = zip(*out) if out else ((), (), ())
        return pa.table({"anchor_id": pa.array(x, pa.int64()), "positive_id": pa.array(y, pa.int64()), "positive_score": pa.array(s, pa.int64())})

    found = tiles(a, b, pairs.where("near").select("i", "j")).groupBy("i", "j").applyInArrow(positive, "anchor_id long, positive_id long, positive_score long")
    found = settle(first_ranked(found, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"), "negatives-positives")
    # The windows of an anchor block travel with it: `positives` of each anchor at most.
    windows = found.join(asked.select(F.col("id").alias("anchor_id"), "i"), "anchor_id").groupBy("i").agg(F.collect_list(F.struct("anchor_id", "positive_id", "positive_score")).alias("w"))
    other = pairs.where("not same").select("i", "j")

    def negative(t: pa.Table, w: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if t.num_rows and w.num_rows:
            a, al, ids, labels, total = summed(t)
            place = {x: n for n, x in enumerate(a.tolist())}
            for x in w["w"][0].as_py():
                n, p = place[x["anchor_id"]], x["positive_score"]
                score = total[n]
                # whole numbers: low * p <= 100 * score <= high * p
                at = best(score, ids, (labels != al[n]) & (score >= -(-low * p // 100)) & (score <= high * p // 100), negatives)
                out += zip([x["anchor_id"]] * len(at), [x["positive_id"]] * len(at), [p] * len(at), ids[at].tolist(), score[at].tolist())
        cols = list(zip(*out)) if out else [()] * 5
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    sums = tiles(a, b, other).groupBy("i", "j").cogroup(windows.join(other, "i").groupBy("i", "j"))
    far = sums.applyInArrow(lambda t, w: negative(t, w), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    out = first_ranked(far, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label=moved)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS place
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 10
"""
