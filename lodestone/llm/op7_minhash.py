"""MinHash near-dedup with SuperMinHash signatures.

Every element of a document's shingle set draws a random permutation of the signature's slots, one slot a level,
with a fresh rank at each level; a slot keeps its least level + rank. Ranks inside one element are correlated (no two
land in one slot), which lowers the variance, and a document stops at the first level that cannot lower any slot.
Bands of slots give buckets. Each bucket's members are compared with one of them, on full sets; links are united.
Then buckets that still hold several components are settled whole: a bucket's documents outside its largest component
meet all others in it, block by block, in matrix products over their sets, so no bucket is capped, no link between
components is left out and no pair becomes a row. Documents that share no bucket never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Forest, components, forget, settle, small_batches, spread

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
U = np.uint64
_M1, _M2, _GOLD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+, with A-Z in lower case."""
    if not text:
        return np.zeros(0, U)
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words make one shingle, none make none."""
    w = word_hashes(text)
    if len(w) == 0:
        return w
    n, size = max(1, len(w) - k + 1), min(k, len(w))
    h = np.full(n, U(size))
    for i in range(size):
        h = mix(h + w[i : i + n] + _GOLD)
    return np.unique(h)


class SuperMinHash:
    """Signatures of `slots` 32-bit values: level in the top 8 bits, rank in the low 24."""

    def __init__(self, slots: int = 160):
        self.m = slots

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        m, out = self.m, np.full((len(sets), self.m), 0xFFFFFFFF, np.uint32)
        at, n = [], 0
        for i, s in enumerate(sets):
            if len(s):
                at.append(i)
                n += len(s)
            if n >= 16_384 or i == len(sets) - 1:
                if at:
                    out[at] = self._some([sets[j] for j in at])
                at, n = [], 0
        return out

    def _some(self, sets: list[np.ndarray]) -> np.ndarray:
        m = self.m
        flat = np.full(len(sets) * m, 0xFFFFFFFF, np.uint32)
        e = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        perm = None
        for j in range(m):
            h = mix(e + U((j + 1) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
            rank = (h >> U(40)).astype(np.uint32) | np.uint32(j << 24)
            k = j + (((h & U(0xFFFFFFFF)) * U(m - j)) >> U(32)).astype(np.int64)
            if perm is None:
                slot = k
            else:
                rows = np.arange(len(e))
                slot = perm[rows, k].astype(np.int64)
                perm[rows, k] = perm[:, j]
            np.minimum.at(flat, doc * m + slot, rank)
            open_docs = flat.reshape(-1, m).max(axis=1) >= np.uint32((j + 1) << 24) if j + 1 < min(m, 255) else np.zeros(len(sets), bool)
            live = open_docs[doc]
            if not live.any():
                break
            if perm is None:  # only documents that are not full after level 0 need their permutations
                e, doc, k = e[live], doc[live], k[live]
                perm = np.tile(np.arange(m, dtype=np.uint16), (len(e), 1))
                perm[np.arange(len(e)), k] = 0
            elif not live.all():
                e, doc, perm = e[live], doc[live], perm[live]
        return flat.reshape(-1, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, rows).astype(U)
    h = np.arange(1, bands + 1, dtype=U)[None, :] * _GOLD
    for r in range(rows):
        h = mix(h + parts[:, :, r] + U(r + 1))
    return h.view(np.int64)


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def _sketch(df: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """id, th -> id, th, n_shingles, fp1, fp2 (hashes of the set), keys (band hashes)."""
    out = T.StructType([df.schema["id"], df.schema["th"], *[T.StructField(c, T.LongType()) for c in ("n_shingles", "fp1", "fp2")], T.StructField("keys", T.ArrayType(T.LongType()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hasher = SuperMinHash(bands * rows)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                b = batch.slice(a, 1000)
                sets = [shingle_set(t, k) for t in b.column("text").to_pylist()]
                keys = band_keys(hasher.signatures(sets), bands, rows)
                fps = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                n = [len(s) for s in sets]
                mask = np.repeat([x == 0 for x in n], 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(n) + 1) * bands, bands, dtype=np.int32)), pa.array(keys.ravel()))
                lists = pa.compute.if_else(pa.array(mask), pa.scalar(None, lists.type), lists)
                two = np.frombuffer(b"".join(fps), np.int64).reshape(-1, 2) if fps else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(n, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]), lists], names=out.names)

    return df.select("id", "th", "text").mapInArrow(each, out)


def _sets(df: DataFrame, k: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, k).astype("<u8").tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["node", "set"])

    return df.select("node", "text").mapInArrow(each, "node long, set binary")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) -> a, b, linked: 100 * intersection >= percent * union, on full sets."""
    left, right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    both = pairs.join(left, "b").join(right, "a").select("a", "b", "sa", "sb")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                s, t = unpacked(x.as_py()), unpacked(y.as_py())
                common = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * common >= percent * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

    return both.mapInArrow(each, "a long, b long, linked boolean")


def set_intersections(left: list[np.ndarray], right: list[np.ndarray], width: int = 16_384) -> np.ndarray:
    """Sizes of all intersections, by matrix products over the values that both sides hold."""
    flat_l, flat_r = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(flat_l, flat_r)

    def cells(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, col = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.searchsorted(common, flat)
        ok = col < len(common)
        ok[ok] = common[col[ok]] == flat[ok]
        order = np.argsort(col[ok], kind="stable")
        return row[ok][order], col[ok][order]

    (rl, cl), (rr, cr) = cells(left, flat_l), cells(right, flat_r)
    out = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, len(common), width):
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        for m, r, c in ((x, rl, cl), (y, rr, cr)):
            i, j = np.searchsorted(c, [a, a + width])
            m[r[i:j], c[i:j] - a] = 1.0
        out += x @ y.T
    return out.astype(np.int64)


def _settle_groups(members: DataFrame, percent: int) -> DataFrame:
    """members (task, grp, side, node, c, set) -> links (a, b) that join different components c, a forest per task.

    side 0 and 1 are the two blocks of a pair of blocks; 2 marks a block met with itself.
    """

    def task(t: pa.Table) -> pa.Table:
        grp, side, c, raw = t["grp"].to_numpy(), t["side"].to_numpy(), t["c"].to_numpy(), t["set"]
        order = np.lexsort((t["node"].to_numpy(), side, grp))
        cuts = [0, *(np.flatnonzero(np.diff(grp[order])) + 1).tolist(), len(order)]
        forest = Forest()
        for a, z in zip(cuts, cuts[1:]):
            at = order[a:z]
            left = at[side[at] != 1]
            right = left if side[at[0]] == 2 else at[side[at] == 1]
            if len(left) == 0 or len(right) == 0 or len(np.unique(c[at])) == 1:
                continue
            sl = [unpacked(raw[int(i)].as_py()) for i in left]
            sr = sl if right is left else [unpacked(raw[int(i)].as_py()) for i in right]
            nl, nr = np.array([len(s) for s in sl]), np.array([len(s) for s in sr])
            both = set_intersections(sl, sr)
            hit = (100 * both >= percent * (nl[:, None] + nr[None, :] - both)) & (c[left][:, None] != c[right][None, :])
            for i, j in zip(*np.nonzero(hit)):
                forest.join(int(c[left[i]]), int(c[right[j]]))
        p, q = zip(*forest.pairs) if forest.pairs else ((), ())
        return pa.table({"a": pa.array(p, pa.int64()), "b": pa.array(q, pa.int64())})

    return members.groupBy("task").applyInArrow(task, "a long, b long")


def _merge_buckets(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, block: int, name: str) -> DataFrame:
    """Links between components that meet in a bucket: every pair of documents in it is compared, without pair rows.

    Buckets that hold one component only are settled, and of buckets with equal members one stands for all. In each of
    the others documents outside its largest component meet all of it, block by block. One block pair is one task.
    """
    spark = members.sparkSession
    known = members.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    place = F.xxhash64("node")
    alike = known.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size"), F.bit_xor(place).alias("x"), F.sum(F.pmod(place, F.lit(1 << 31))).alias("y"))
    mixed = alike.where("lo != hi").groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key", "size")
    rows = settle(known.join(mixed, "key").select(F.col("key").alias("grp"), "size", "node", "c"), f"{name}-mixed")
    per = rows.groupBy("grp", "size", "c").agg(F.count("*").alias("here")).groupBy("grp", "size").agg(F.max(F.struct("here", "c")).alias("top"))
    per = per.select("grp", F.col("top.c").alias("main"), F.ceil((F.col("size") - F.col("top.here")) / block).cast("int").alias("nb"), F.ceil(F.col("top.here") / block).cast("int").alias("mb"))
    rows = rows.join(per, "grp").join(sets, "node")
    tasks = spread(spark, rows.count(), block)
    whole = F.col("size") <= block
    small = rows.where(whole).select(F.concat(F.lit("s"), F.pmod(F.xxhash64("grp"), F.lit(tasks)).cast("string")).alias("task"), "grp", F.lit(2).alias("side"), "node", "c", "set")
    minor = F.col("c") != F.col("main")
    at = lambda n: F.pmod(place, F.col(n).cast("long")).cast("int")
    big = rows.where(~whole).withColumn("own", F.when(minor, at("nb")).otherwise(F.col("nb") + at("mb")))
    big = big.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(minor, F.col("nb") + F.col("mb")).otherwise(F.col("nb")) - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    large = big.select(F.concat_ws("-", F.lit("b"), "grp", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "grp", side.alias("side"), "node", "c", "set")
    return settle(_settle_groups(small.unionByName(large), percent).distinct(), f"{name}-links")


def _same_ids(sig: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of an id that has several."""
    told = sig.where("id is not null and n_shingles > 0").select("id", "fp1", "fp2")
    several = told.groupBy("id").agg(F.min(F.struct("fp1", "fp2")).alias("lo"), F.max(F.struct("fp1", "fp2")).alias("hi")).where("lo != hi").select("id")
    ends = told.join(several, "id", "left_semi").join(nodes.select("fp1", "fp2", "node"), ["fp1", "fp2"]).select("id", "node").distinct()
    return ends.join(ends.groupBy("id").agg(F.min("node").alias("a")), "id").where("a != node").select("a", F.col("node").alias("b"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, block: int = 512) -> DataFrame:
    """Per row: the id, n_shingles, component_id (smallest id reachable over links, itself included), kept; see `linked_texts`."""
    return linked_texts(df, id_col, text_col, k, percent, bands, rows, block).select(id_col, "n_shingles", "component_id", "kept")


def linked_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, block: int = 512, unite_ids: bool = True) -> DataFrame:
    """Per row: the id, n_shingles, component_id, kept, text_hash (xxhash64 of the text), text_group (a number for each component; null without words or id).

    Two documents are linked when 100 * |A and B| >= percent * |A or B| over their full sets of k-word shingles.
    Texts without words (also null ones) have no shingles and link with nothing. Rows that share an id are one document
    of the components (not so with unite_ids off); each of their texts is compared. A row without an id takes no part: component_id is null and it is
    kept. Equal sets are one node, so copies are never paired with each other. An empty table gives an empty result;
    other columns are not read.
    A pair at the threshold shares no band with probability (1 - s ** rows) ** bands: 3e-6 at 0.8 with 5 rows a band,
    3e-7 at 0.85 with 6 (7e-9 with 5).
    """
    small_batches(df.sparkSession)
    docs = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"), F.xxhash64(df[text_col]).alias("th"))
    sig = settle(_sketch(docs, k, bands, rows), "minhash-sketch")
    nodes = sig.where("id is not null and n_shingles > 0").groupBy("fp1", "fp2").agg(F.min(F.struct("id", "th")).alias("first"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    nodes = settle(nodes.select("fp1", "fp2", F.monotonically_increasing_id().alias("node"), F.col("first.id").alias("id"), F.col("first.th").alias("th"), "n", "keys"), "minhash-nodes")
    flat = nodes.select("node", "n", F.explode("keys").alias("key"))
    order = F.struct(F.xxhash64("node").alias("o"), F.col("node").alias("leader"), F.col("n").alias("ln"))
    buckets = flat.groupBy("key").agg(F.count("*").alias("size"), F.min(order).alias("first")).where("size > 1").select("key", "size", "first.leader", "first.ln")
    members = settle(flat.join(buckets, "key"), "minhash-members")
    near = lambda p, q: F.least(p, q) * 100 >= F.greatest(p, q) * percent  # noqa: E731  sizes further apart can't reach it
    pair = lambda p, q: (F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    pairs = settle(members.where("node != leader").where(near(F.col("n"), F.col("ln"))).select(*pair(F.col("node"), F.col("leader"))).distinct(), "minhash-pairs")
    members = members.where("size > 2").select("key", "node")
    # Full sets of all documents that any bucket compares; one row of a node's first id and text gives its set.
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(members.select("node")).distinct()
    wanted = nodes.select("node", "id", "th").join(wanted, "node")
    sets = settle(_sets(docs.join(wanted, ["id", "th"]).select("node", "text"), k).groupBy("node").agg(F.first("set").alias("set")), "minhash-sets")
    seen = settle(_verify(pairs, sets, percent), "minhash-verified")
    links = seen.where("linked").select("a", "b")
    labels = components(links.unionByName(_same_ids(sig, nodes)) if unite_ids else links, "minhash")
    more = _merge_buckets(members, labels, sets, percent, block, "minhash")
    if not more.isEmpty():  # links between components: their labels move on
        joined = components(more, "minhash").select(F.col("node").alias("component"), F.col("component").alias("top"))
        old = labels.join(joined, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        fresh = joined.select(F.col("component").alias("node"), F.col("top").alias("component")).join(labels, "node", "left_anti")
        labels = settle(old.unionByName(fresh), "minhash-labels")
    linked = settle(nodes.select("fp1", "fp2", "id", "node").join(labels, "node"), "minhash-linked")
    least = linked.groupBy("component").agg(F.min("id").alias("c"))
    named = linked.join(least, "component").select("fp1", "fp2", "c", F.col("component").alias("g")).unionByName(nodes.join(labels, "node", "left_anti").select("fp1", "fp2", F.col("id").alias("c"), F.col("node").alias("g")))
    out = sig.select("id", "th", "n_shingles", "fp1", "fp2").join(named, ["fp1", "fp2"], "left")
    part = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    own = F.when(part, F.coalesce("c", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"), F.col("th").alias("text_hash"), F.when(part, F.col("g")).alias("text_group"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85, rows=6)


#: Exact links over an inverted list of shingles, and what they reach; for tables without large groups of copies.
OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(c) AS c FROM r GROUP BY node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN c ON node = doc_id"""
