"""Embedding near-dedup by sorted projection passes.

Equal vectors are one node first. In each pass every node gets a key: the sign bits of 64 random projections, one
after another. Nodes are ordered by label and key over the whole cluster, and each is compared with the `window`
nodes before it. Pairs within a wider angle than asked for are united across passes.

How many passes that takes depends on how crowded the vectors are, so it is measured: a partner that shares more of a
node's key than the nodes `window` places away do is certain to stand in its window, and a partner at the threshold
shares that many bits with a known probability. Nodes whose chance to have missed such a partner is still above
`miss` go into more passes; a pair is safe if one of its ends is. What stays unsafe is compared whole within its label.
Inside the united groups all pairs are then compared in double precision, block by block, so link counts are exact
however large a group is, and components follow from verified links alone.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, settle, spread
from .op4_ann import usable


@functools.lru_cache(maxsize=64)
def _planes(dim: int, one_pass: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, one_pass]).normal(size=(dim, 64)).astype(np.float32)


_BITS = (np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)).astype(np.uint64)


def sort_keys(unit: np.ndarray, one_pass: int, seed: int) -> np.ndarray:
    """The 64 concatenated sign bits of each row as a signed number in the same order."""
    bits = unit @ _planes(unit.shape[1], one_pass, seed) > 0
    return ((bits * _BITS).sum(1, dtype=np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def passes_for(rows: int, cosine: float, window: int, miss: float) -> int:
    """A first guess at the passes that leave a pair at the threshold unseen with probability `miss`: for evenly spread vectors.

    Two vectors share each sign with probability 1 - angle/pi; sharing as many as narrow the table down to one window
    puts them into it.
    """
    bits = 2 + max(0.0, math.log2(max(2, rows) / window))
    return max(4, math.ceil(math.log(miss) / math.log(1 - (1 - math.acos(cosine) / math.pi) ** bits)))


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bits two arrays of keys have in common."""
    x = (a ^ b).view(np.uint64)
    high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 - np.frexp(high)[1], np.where(low > 0, 64 - np.frexp(low)[1], 64))


def sure_bits(key: np.ndarray, window: int, starts: bool, ends: bool) -> np.ndarray:
    """Per node of one ordered run: a partner that shares so many bits stands within the window; 65 where no number is sure.

    starts, ends: the run's first and last nodes are those of its label; else their neighbours lie in another task.
    """
    n = len(key)
    left, right = np.full(n, -1 if starts else 64), np.full(n, -1 if ends else 64)
    if n > window:
        same = shared_bits(key[window:], key[:-window])
        left[window:], right[:-window] = same, same
    return 1 + np.maximum(left, right)


def unite(own: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the components of x and y, pair by pair; own: of each item the least of its component, kept so."""
    while True:
        a, b = own[x], own[y]
        if (a == b).all():
            return
        np.minimum.at(own, np.maximum(a, b), np.minimum(a, b))
        while (up := own[own]).tobytes() != own.tobytes():
            own[:] = up


def _window_pairs(ordered: DataFrame, window: int, near: float, one_bit: float) -> DataFrame:
    """(a, b, null) for pairs within the angle, of each window step those that join two components of the task; (node, null, log of the chance that its window missed a partner at the threshold)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        t = table.combine_chunks()
        p, d, label = t["p"].to_numpy(), t["d"].to_numpy(), t["label"].to_numpy()
        key, node = t["key"].to_numpy(), t["node"].to_numpy()
        change = np.flatnonzero((np.diff(p) != 0) | (np.diff(d) != 0) | (label[1:] != label[:-1])) + 1
        # Rows of one node stand for it in every pass: components are those of nodes.
        (_, item), pairs, chance = np.unique(node, return_inverse=True), [], np.zeros(len(p))
        own = np.arange(int(item.max()) + 1)
        for a, z in zip([0, *change.tolist()], [*change.tolist(), len(p)]):
            v = np.frombuffer(b"".join(t["unit"].slice(a, z - a).to_pylist()), "<f4").reshape(z - a, -1)
            for s in range(1, min(window, z - a - 1) + 1):
                i = a + np.flatnonzero(np.einsum("ij,ij->i", v[s:], v[:-s]) >= near)
                i = i[own[item[i]] != own[item[i + s]]]
                if len(i):
                    pairs.append(np.stack([node[i], node[i + s]]))
                    unite(own, item[i], item[i + s])
            bits = sure_bits(key[a:z], window, a > 0, z < len(p))
            chance[a:z] = np.where(bits > 64, 0.0, np.log1p(-np.minimum(one_bit ** bits.astype(float), 1 - 1e-12)))
        a, b = np.concatenate(pairs, axis=1) if pairs else ((), ())
        none = pa.nulls(len(node))
        yield pa.RecordBatch.from_arrays([t["node"].combine_chunks(), t["label"].combine_chunks(), t["d"].combine_chunks(), none.cast(pa.int64()), pa.array(chance)], names=names)
        if len(a):
            none = pa.nulls(len(a))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), none.cast(pa.string()), none.cast(pa.int32()), pa.array(b, pa.int64()), none.cast(pa.float64())], names=names)

    names = ["a", "label", "d", "b", "chance"]
    return ordered.mapInArrow(each, "a long, label string, d int, b long, chance double")


def _pass_rows(nodes: DataFrame, rows: int, first: int, passes: int, seed: int) -> DataFrame:
    """Every node once a pass, in order of its key."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column("d").to_numpy()
            for dim in np.unique(d).tolist():
                at = pa.array(np.flatnonzero(d == dim))
                b = batch.take(at)
                v = np.array(b.column("v").flatten()).reshape(-1, dim)
                v = v / np.abs(v).max(1, keepdims=True)
                v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype("<f4")
                raw = pa.array([x.tobytes() for x in v], pa.binary())
                for p in range(first, first + passes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), p, np.int32)), b.column("label"), b.column("d"), pa.array(sort_keys(v, p, seed)), b.column("node"), raw], names=["p", "label", "d", "key", "node", "unit"])

    order = ["p", "label", "d", "key", "node"]
    wide = nodes.select("node", "label", "d", "v").mapInArrow(keyed, "p int, label string, d int, key long, node long, unit binary")
    longest = nodes.agg(F.max("d")).first()[0] or 1
    parts = spread(nodes.sparkSession, rows * passes, max(1000, min(50_000, 4_000_000 // longest)))  # a task holds about 16 MB of vectors
    return wide.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def near_pairs(nodes: DataFrame, cosine: float, window: int, seed: int, slack: float, miss: float, alone: int, rounds: int = 4) -> DataFrame:
    """Pairs (a, b) of nodes within the angle of `cosine` times (1 + slack), found by the sorted passes, and stars over what they leave unsafe.

    After the first round a label with at most `alone` unsafe nodes is compared whole, for that costs less than passes;
    so is what stays unsafe after the last round.
    """
    near, one_bit = math.cos(math.acos(cosine) * (1 + slack)), 1 - math.acos(cosine) / math.pi
    todo, done, pairs, stars = nodes.select("node", "label", "d", "v", F.lit(0.0).alias("chance")), 0, [], []
    for r in range(rounds):
        rows = todo.count()
        if not rows:
            break
        passes = passes_for(rows, cosine, window, miss) << r
        found = settle(_window_pairs(_pass_rows(todo, rows, done, passes, seed), window, near, one_bit), "sorted-windows")
        done += passes
        pairs.append(found.where("b is not null").select("a", "b"))
        gained = found.where("b is null").groupBy(F.col("a").alias("node"), "label", "d").agg(F.sum("chance").alias("more"))
        unsafe = todo.join(gained, ["node", "label", "d"]).withColumn("chance", F.col("chance") + F.col("more")).where(F.col("chance") > math.log(miss)).drop("more")
        unsafe = settle(unsafe, "sorted-unsafe")
        sizes = unsafe.groupBy("label", "d").agg(F.count("*").alias("size"), F.min("node").alias("least"))
        whole = F.col("size") <= (alone if r < rounds - 1 else 1 << 62)
        marked = unsafe.join(sizes, ["label", "d"])
        stars.append(marked.where(whole).where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b")))
        todo = settle(marked.where(~whole).select("node", "label", "d", "v", "chance"), "sorted-todo") if r < rounds - 1 else None
        if todo is None:
            break
    return functools.reduce(DataFrame.unionByName, [*pairs, *stars]).distinct() if pairs else nodes.sparkSession.createDataFrame([], "a long, b long")


def _block_links(members: DataFrame, cosine: float) -> DataFrame:
    """members (task, grp, side, node, mult, v): per task the links between all its pairs of one group.

    side 0 and 1 are the two blocks of a pair of blocks; 2 marks a block met with itself. Returns (node, links) counts
    and (a, b) forest pairs in one table; b is null in the first kind.
    """

    def task(t: pa.Table) -> pa.Table:
        pairs, nodes, links = [], [], []
        grp = t["grp"].to_numpy()
        order = np.argsort(grp, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(grp[order])) + 1).tolist(), len(order)]
        all_side, all_node, all_mult = t["side"].to_numpy(), t["node"].to_numpy(), t["mult"].to_numpy()
        for a, z in zip(cuts, cuts[1:]):
            at = order[a:z]
            side, node, mult = all_side[at], all_node[at], all_mult[at]
            v = np.array(t["v"].take(pa.array(at)).combine_chunks().flatten(), np.float64).reshape(len(at), -1)
            v = v / np.abs(v).max(1, keepdims=True)
            v = v / np.linalg.norm(v, axis=1, keepdims=True)
            left = np.flatnonzero(side != 1)
            right = left if side[0] == 2 else np.flatnonzero(side == 1)
            both, own = np.zeros(len(at), np.int64), np.arange(len(at))  # own: the component of each row so far
            for i in range(0, len(left), 512):
                some = left[i : i + 512]
                hit = v[some] @ v[right].T >= cosine
                if right is left:
                    hit[np.arange(len(some)), np.arange(i, i + len(some))] = False
                both[some] += hit @ mult[right]
                if right is not left:
                    both[right] += mult[some] @ hit
                for x, row in zip(some.tolist(), hit):
                    linked = right[row]
                    others = own[linked]
                    # one pair for each component that x joins, however many rows of it are linked
                    for c in np.unique(others[others != own[x]]).tolist():
                        pairs.append((int(node[x]), int(node[linked[np.argmax(others == c)]])))
                        own[own == c] = own[x]
            nodes += node.tolist()
            links += both.tolist()
        a, b = zip(*pairs) if pairs else ((), ())
        return pa.table({"a": pa.array([*nodes, *a], pa.int64()), "b": pa.array([None] * len(nodes) + list(b), pa.int64()), "links": pa.array([*links, *[None] * len(a)], pa.int64())})

    return members.groupBy("task").applyInArrow(task, "a long, b long, links long")


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, window: int = 32, slack: float = 0.75, miss: float = 1e-6, block: int = 512, seed: int = 1) -> DataFrame:
    """Per row: the id, n_links, component_id (smallest id reachable over links, itself included), kept.

    Only rows with equal, non-null labels (of any type, compared as text) and equally long vectors link. A pair at the
    threshold goes unseen with probability `miss` at most, however crowded the vectors are; closer ones with less. Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing, nor do rows without an id (their component is null, and they are
    kept). n_links counts the other rows linked directly, repeated rows too. Rows that share an id count as one node of
    the component. An empty table gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(df[id_col].cast("long").alias("id"), df[label_col].cast("string").alias("label"), df[vec_col].cast("array<double>").alias("v"))
    rows = settle(rows.withColumn("ok", F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")), F.lit(False))), "sorted-rows")
    good = rows.where("ok")
    nodes = settle(good.groupBy("label", "v").agg(F.min("id").alias("node"), F.count("*").alias("mult")).withColumn("d", F.size("v")), "sorted-nodes")
    group = components(near_pairs(nodes, cosine, window, seed, slack, miss, 16 * block), "sorted-groups").select("node", F.col("component").alias("grp"))
    # A node stands once for each label and length its id has; groups hold one label and length only.
    inside = settle(nodes.join(group, "node").withColumn("grp", F.xxhash64("grp", "label", "d")), "sorted-inside")
    sizes = inside.groupBy("grp").agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    tasks = spread(spark, inside.count(), block)
    placed = inside.join(sizes, "grp").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    small = placed.where("blocks = 1").select(F.concat(F.lit("s"), F.pmod("grp", F.lit(tasks)).cast("string")).alias("task"), "grp", F.lit(2).alias("side"), "node", "mult", "v")
    met = placed.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    name = F.concat_ws("-", F.lit("b"), "grp", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    large = met.select(name.alias("task"), "grp", side.alias("side"), "node", "mult", "v")
    found = settle(_block_links(small.unionByName(large), cosine), "sorted-links")
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    label = components(found.where("b is not null").select("a", "b"), "sorted")
    told = nodes.select("label", "v", "node", "mult").join(links, "node", "left").join(label, "node", "left")
    told = told.select("label", "v", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "node").alias("c"))
    out = good.join(told, ["label", "v"], "left").select("id", "n", "c").unionByName(rows.where("not ok").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("c")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept"))


def op1_sorted_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Exact links and what they reach; for tables on which all pairs of a label can be compared.
OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(c) AS c FROM r GROUP BY node), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id"""
