"""Metadata of chunks by a model that is asked in batches: six chunks of a document a call, failed batches one by one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import SETTINGS as S
from lodestone.functions.text import let
from lodestone.sources.versioned import settle

#: What a reply must look like: {"document": {...}, "chunks": [{"chunk_index": 1, ...}, ...]}. Items stay JSON until they are matched.
REPLY = "struct<document: string, chunks: array<string>>"


def batches(chunks: DataFrame, size: int = S.chunk_batch) -> DataFrame:
    """chunks (document_id, chunk_index, text, ...) -> document_id, batch (from 0), items (array of at most `size` chunks, in order)."""
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index")) - 1
    rows = chunks.withColumn("batch", F.floor(place / size).cast("int"))
    item = F.struct("chunk_index", *[c for c in chunks.columns if c not in ("document_id", "chunk_index")])
    return rows.groupBy("document_id", "batch").agg(F.array_sort(F.collect_list(item)).alias("items"))


def _told(asked: DataFrame, call: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """asked (document_id, batch, items) plus found: a map of chunk_index to its item of the reply, null if the reply is of no use.

    The replies are written first, so that no model is asked twice. A reply without a list of chunks, or with none of
    those asked for, is of no use; items without a whole number, or with one that was not asked for, are passed over; of
    items with the same number the last counts.
    """
    replied = settle(asked.withColumn("reply", call(F.col("document_id"), F.col("items"))), name)
    own = F.transform("items", lambda i: i["chunk_index"].cast("int"))

    def numbered(asked_for: Column) -> Column:
        told = F.transform(F.from_json("reply", REPLY)["chunks"], lambda x: F.struct(F.get_json_object(x, "$.chunk_index").try_cast("int").alias("k"), x.alias("v")))
        return F.filter(told, lambda x: x["k"].isNotNull() & F.array_contains(asked_for, x["k"]))

    def last(good: Column) -> Column:
        """Later items of a number replace earlier ones."""
        ks = lambda at: F.transform(F.slice(good, at + 2, F.size(good)), lambda y: y["k"])
        kept = F.filter(good, lambda x, at: ~F.array_contains(ks(at), x["k"]))
        return F.when(F.size(good) > 0, F.map_from_entries(kept))

    # each value is worked out once a row: a reply is parsed once, an item's number read once
    return replied.withColumn("found", let(let(own, numbered), last)).drop("reply")


def extract(chunks: DataFrame, call: Callable[[Column, Column], Column], size: int = S.chunk_batch) -> DataFrame:
    """chunks (document_id, chunk_index, text, ...) -> the same plus meta (the reply's item for the chunk as JSON, or null) and how.

    call: what asks the model, a column of document_id and items that gives the reply as a string (a built-in expression,
    or a pandas function around a hosted model). how: `batch`; `single` if the batch failed and the chunk was asked for
    alone; `fallback` where neither gave anything, and for chunks that a good reply leaves out. A batch of one that fails is
    not asked again.
    """
    first = settle(_told(batches(chunks, size), call, "replies"), "batch-replies")
    pick = lambda df: df.select("document_id", F.explode("items").alias("item"), "found", "how").select("document_id", "item.*", F.get(F.array(F.element_at("found", F.col("item.chunk_index").cast("int"))), F.lit(0)).alias("meta"), "how")
    good = pick(first.where("found is not null").withColumn("how", F.lit("batch")))
    alone = pick(first.where((F.col("found").isNull()) & (F.size("items") == 1)).withColumn("how", F.lit("fallback")))
    failed = first.where(F.col("found").isNull() & (F.size("items") > 1)).select("document_id", F.explode("items").alias("item"))
    again = _told(failed.select("document_id", F.lit(0).alias("batch"), F.array("item").alias("items")), call, "single-replies")
    single = pick(again.withColumn("how", F.lit("single")))
    out = good.unionByName(single).unionByName(alone)
    return out.withColumn("how", F.when(F.col("meta").isNull(), "fallback").otherwise(F.col("how")))
