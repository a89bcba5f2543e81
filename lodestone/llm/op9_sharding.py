"""Two-pass external shuffle into shards (native: DataFrame functions only).

Pass one scatters the records uniformly into memory-sized buckets by a seeded hash; pass two gathers one bucket at
a time, runs a Fisher-Yates shuffle over it (Spark's ``shuffle`` function) and numbers the rows on from the rows of
the buckets before it. Dealing the numbers out in turn gives shards whose counts are at most one apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, spread

OVERHEAD = 16


def record_bytes(df: DataFrame) -> Column:
    """About the bytes of a row's values."""
    out = F.lit(OVERHEAD)
    for n, t in df.dtypes:
        if t == "void" or t in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp"):
            out += F.lit(8)
        else:
            out += F.coalesce(F.octet_length(n if t in ("string", "binary") else F.to_json(F.struct(n))), F.lit(0))
    return out.cast("long")


def external_shuffle(df: DataFrame, columns: list[str], shards: int = 40, seed: int = 20, bucket_rows: int = 50_000, bucket_bytes: int = 16 << 20) -> DataFrame:
    """`columns` of df in random order: plus shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    Law: `rows`; shard counts are at most one apart, whatever the keys. Only `columns` are carried; other columns of
    df, also such as are called shard or slot, are left out. Bucket size: about `bucket_rows` rows or `bucket_bytes` bytes, whichever is less, whatever their keys: the
    scatter hash takes the row's place as well, so repeated rows and hot keys spread like any others.
    Nulls are carried as they are; an empty table gives an empty result; repeated rows each get a place of their own.
    """
    spark = df.sparkSession
    names = [f"c{i}" for i in range(len(columns))]
    flat = df.select(*[F.col(c).alias(n) for c, n in zip(columns, names)])
    hashed = [n for n, t in flat.dtypes if t not in ("void", "map")]
    # The scatter pass, written out: both later reads see the same buckets, also after an executor is lost.
    flat = settle(flat.withColumn("key", F.xxhash64(F.lit(seed), F.monotonically_increasing_id(), *hashed[:1])), "shuffle-scatter")
    rows, size = flat.agg(F.count("*"), F.sum(record_bytes(flat))).first()
    buckets = max(spread(spark, rows, bucket_rows), spread(spark, size or 0, bucket_bytes))
    flat = flat.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
    sizes = flat.groupBy("bucket").count()
    before = sizes.select("bucket", (F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("before"))  # one row a bucket
    each = flat.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("key", *names))).alias("rows"))
    mixed = each.withColumn("rows", F.shuffle("rows", seed)).join(before, "bucket")
    out = mixed.select("before", F.posexplode("rows").alias("pos", "row"))
    place = F.col("before") + F.col("pos")
    return out.select(
        *[F.col(f"row.{n}").alias(c) for c, n in zip(columns, names)],
        F.pmod(place, F.lit(shards)).cast("int").alias("shard"),
        F.floor(place / F.lit(shards)).cast("long").alias("slot"),
    )


def write_shards(df: DataFrame, path: str, shards: int = 40, seed: int = 20, bucket_rows: int = 50_000, bucket_bytes: int = 16 << 20) -> None:
    """Write df's rows, shuffled, as one folder a shard; rows lie in slot order inside each file."""
    cols = [c for c in df.columns if c not in ("shard", "slot")]
    out = external_shuffle(df, cols, shards, seed, bucket_rows, bucket_bytes)
    out.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame, shards: int = 40, seed: int = 20) -> DataFrame:
    """Of whole documents, shuffled: doc_id, size (UTF-8 bytes, none for null, plus 16), text_crc32 (null for null), law, shard, slot, grown_shard."""
    out = external_shuffle(docs, ["doc_id", "text"], shards, seed)
    out = out.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), "shard", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
