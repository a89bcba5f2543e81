"""Helpers that the operators share: lineage cuts in the shared folder, held-out folds, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode one of our own where that is unset (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    own = spark.conf.get("lodestone.shared.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("lodestone.shared.dir", own)
    return own


def settle(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back.

    A lost executor then costs one re-read, and later plans see the real size of the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000, mb: int = 16) -> None:
    """Whole texts go to Python at most `rows` or about `mb` MB at a time; Spark's own 10,000 would hold 10 times the text on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mb}m")


_HELD: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """The object of `key`, kept between the tasks of a Python worker; a worker keeps one, the next operator's takes its place."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def forget() -> None:
    """Free what `held` keeps in this Python worker: tasks of other operators begin with it, so that memos never add up."""
    _HELD.clear()


def spread(spark: SparkSession, rows: int, rows_each: int) -> int:
    """How many groups hold `rows` at `rows_each` a group, and at least as many as the session shuffles into."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text (fold 0)."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(modulus).cast("long"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of `edges` (a, b: long, not null) as (node, component); component is the smallest node.

    Label propagation with pointer jumping: every round joins the labels over the edges, takes the least, then
    follows each label to its own label, so paths halve. The edges are contracted to labels after each round and
    inner ones dropped, so later rounds are small. All state is in DataFrames; the driver sees one count a round.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    e = settle(e, f"{name}-edges")
    labels = None
    while not e.isEmpty():
        # One hop: each node points at its smallest neighbour, if that is smaller.
        both = e.select(F.col("a").alias("node"), F.col("a").alias("to")).unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("to")))
        hop = both.groupBy("node").agg(F.min("to").alias("to"))
        hop = settle(hop, f"{name}-hop")
        while True:  # pointer jumping to the root of each pointer tree
            up = hop.select(F.col("node").alias("to"), F.col("to").alias("top"))
            nxt = settle(hop.join(up, "to", "left").select("node", F.coalesce("top", "to").alias("to"), (F.coalesce("top", "to") != F.col("to")).alias("moved")), f"{name}-jump")
            moved = not nxt.where("moved").isEmpty()
            hop = nxt.select("node", "to")
            if not moved:
                break
        if labels is None:
            labels = hop.select("node", F.col("to").alias("component"))
        else:
            old = labels.withColumnRenamed("component", "via")
            labels = old.join(hop.select(F.col("node").alias("via"), "to"), "via", "left").select("node", F.coalesce("to", "via").alias("component"))
            labels = settle(labels, f"{name}-labels")
        # Contract.
        pa, pb = hop.select(F.col("node").alias("a"), F.col("to").alias("ra")), hop.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        e = e.join(pa, "a", "left").join(pb, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")).where("x != y")
        e = settle(e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-edges")
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    return labels


class Forest:
    """Union-find over the pairs of one task; keeps the pairs that joined two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.pairs: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up.get(p, p)
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.pairs.append((a, b))
