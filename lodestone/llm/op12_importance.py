"""Target-distribution importance resampling over hashed word n-grams.

Identical texts are collapsed first, by grouping the full text: features and weight of a text are worked out once and its
counts multiplied by how often it stands in the corpus. Weights go back to all its documents by the text's digest; only
then comes the noise that each document has of its own. The draw is a top k of the noisy weights (Gumbel top k), ranked
by range partitions.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, small_batches, spread

#: Words in UTF-8: runs of ASCII digits, ASCII letters and whatever is not ASCII. bytes.lower() lowers A-Z only.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def feature_buckets(text: str | None, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """Words of a whole text, and the bucket of every run of 1 to `longest` of them."""
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
    crc = zlib.crc32
    spaced = [b" " + w for w in words]
    runs = [crc(w) for w in words]
    out = [runs]
    for k in range(1, longest):  # the checksum of a run goes on from that of the run without its last word
        runs = [crc(w, c) for c, w in zip(runs, spaced[k:])]
        out.append(runs)
    return len(words), np.concatenate([np.array(x, np.int64) for x in out]) % buckets


def collapsed(df: DataFrame, text_col: str = "text") -> DataFrame:
    """text, copies: each full text once, null as the empty text. Copies are counted within each task before they are shuffled."""
    return df.groupBy(F.coalesce(F.col(text_col), F.lit("")).alias("text")).agg(F.count("*").alias("copies"))


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> dict[int, int]:
    """Features in each bucket over all texts (text, copies). One row a bucket and task is shuffled; `buckets` rows at most come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for text, copies in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total += copies * np.bincount(feature_buckets(text, longest, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    summed = texts.select("text", "copies").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r.bucket: r.n for r in summed.collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """Of each bucket: floor(1000 * the log of how much likelier it is in the target), with one added to every count."""
    s_all, t_all = sum(source.values()), sum(target.values())
    return [math.floor(1000 * math.log(((target.get(b, 0) + 1.0) * (s_all + float(buckets))) / ((source.get(b, 0) + 1.0) * (t_all + float(buckets))))) for b in range(buckets)]


def text_weights(texts: DataFrame, gain: list[int], longest: int, buckets: int) -> DataFrame:
    """Of each text its digest, n_words, n_features and weight (the floored mean of its features' gains; 0 without any)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(gain, np.int64)
        for b in batches:
            words, size, weight = [], [], []
            for text in b.column(1).to_pylist():
                k, at = feature_buckets(text, longest, buckets)
                n = len(at)
                words.append(k)
                size.append(n)
                weight.append(int(table[at].sum()) // n if n else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in (words, size, weight)]], names=["digest", "n_words", "n_features", "weight"])

    return texts.select(_digest(F.col("text")).alias("digest"), "text").mapInArrow(weigh, "digest binary, n_words long, n_features long, weight long")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def own_noise(id_col: Column, seed: int) -> Column:
    """A document's Gumbel noise in thousandths, from the digest of seed and id (a null id counts as empty)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """rows plus rank: 1 to k in `order`, null beyond. Ranges of the order are numbered each by itself and shifted by the rows before them; no task holds all."""
    spark = rows.sparkSession
    n = spread(spark, rows.count(), 200_000)
    placed = settle(rows.repartitionByRange(n, *order).withColumn("part__", F.spark_partition_id()), "importance-ranges")
    sizes = placed.groupBy("part__").agg(F.count("*").alias("n__"))  # one row a range
    before = sizes.select("part__", (F.sum("n__").over(Window.orderBy("part__")) - F.col("n__")).alias("before__"))
    own = F.row_number().over(Window.partitionBy("part__").orderBy(*order))
    numbered = placed.withColumn("own__", own).join(before, "part__").withColumn("rank", (F.col("own__") + F.col("before__")).cast("long"))
    return numbered.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))).drop("part__", "own__", "before__")


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 25, min_words: int = 20, seed: int = 7, longest: int = 2, buckets: int = 10_000) -> DataFrame:
    """Per row of df: the id, n_features, weight, score, rank (null: not drawn).

    Of the rows with `min_words` words or more, the floor of `percent` in a hundred with the highest scores are drawn;
    ties go to the smaller id, a null id first. A null text counts as empty: no features, weight 0, never drawn. Repeated
    rows are drawn each by itself, and rows that share an id have the same noise. `target` needs only `text_col`; without
    texts there its counts are 0. Other columns are not read. An empty df gives an empty result.
    """
    spark = df.sparkSession
    small_batches(spark)
    texts = settle(collapsed(df, text_col), "importance-texts")
    gain = gains(bucket_counts(texts, longest, buckets), bucket_counts(collapsed(target, text_col), longest, buckets), buckets)
    weights = text_weights(texts, gain, longest, buckets)
    docs = df.select(F.col(id_col).alias(id_col), _digest(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"))
    scored = docs.join(weights, "digest").select(id_col, "n_words", "n_features", "weight", (F.col("weight") + own_noise(F.col(id_col), seed)).alias("score"), F.monotonically_increasing_id().alias("row__"))
    scored = settle(scored, "importance-scores")
    may = scored.where(F.col("n_words") >= min_words)
    drawn = ranked(may, percent * may.count() // 100, [F.desc("score"), F.asc(id_col), F.asc("n_features"), F.asc("row__")])
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(id_col, "n_features", "weight", "score", "rank")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The same in DuckDB's SQL. It has no crc32: the checksum is folded over the bytes of each distinct feature, by a table made from the polynomial.
OP12_SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS crc FROM range(256) r(b)),
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, TRUE AS own, row_number() OVER () AS r FROM documents
  UNION ALL
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), FALSE, row_number() OVER () FROM benchmark),
features AS (
  SELECT own, r, unnest(w) AS f FROM words
  UNION ALL
  SELECT own, r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
counted AS (SELECT f, count(*) FILTER (WHERE own) AS s, count(*) FILTER (WHERE NOT own) AS t FROM features GROUP BY f),
spelled AS (SELECT f, s, t, hex(encode(f)) AS h FROM counted),
bytes AS (SELECT f, s, t, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM spelled),
hashed AS (SELECT f, s, t, xor(list_reduce([4294967295] || b, lambda c, x: xor(c >> 8, crc[CAST(xor(c, x) & 255 AS BIGINT) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc_table),
buckets AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY bucket),
totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM buckets),
gains AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(s_all AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST(t_all AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM buckets, totals),
weights AS (
  SELECT x.r, count(*) AS n_features, CAST(floor(CAST(sum(g.gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight
  FROM features x JOIN hashed h ON x.f = h.f JOIN gains g ON h.bucket = g.bucket WHERE x.own GROUP BY x.r),
scored AS (
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM words d LEFT JOIN weights USING (r) WHERE d.own),
placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 25 * count(*) OVER () // 100 AS k FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= k THEN place END AS rank FROM placed
UNION ALL
SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_words < 20
"""
