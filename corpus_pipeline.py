"""Corpus pipeline over `documents`: language ID, near-dedup, secrets, mixing, packing.

Every stage works on all rows that the one before it kept. The first four return the columns of documents; the last
returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import settle, small_batches
from lodestone.llm.op2_packing import pack_documents, tokenizer_path
from lodestone.llm.op5_secrets import redact_secrets
from lodestone.llm.op6_mixing import mix
from lodestone.llm.op7_minhash import linked_texts
from lodestone.llm.op8_language_id import UNDECIDED, identify, train

#: Factors on the tokens of each domain. Only documents that are poor or toxic with CONFIDENT or more can go, and of these
#: all with a rate of KEEP_FROM or more are kept.
FACTORS = {"good": 1.0, "poor": 0.5, "toxic": 0.0}
KEEP_FROM = 0.75
CONFIDENT = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (or text) go; a missing language is filled in. Rows without an id, or that share one, are judged each by itself."""
    columns = docs.columns
    named = identify(docs, train(docs))
    return named.where(F.col("lang_pred") != UNDECIDED).withColumn("lang", F.coalesce("lang", "lang_pred")).select(columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id. Rows without an id all stay.

    Of rows that share an id each text counts for itself: unrelated texts all stay, equal rows once.
    """
    rows = settle(linked_texts(docs, unite_ids=False).where("text_group is not null").select("doc_id", "text_hash", "text_group"), "pipeline-groups")
    first = rows.groupBy("text_group").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    gone = rows.join(first, "text_group").where("doc_id != first.doc_id or text_hash != first.text_hash").select(F.col("doc_id").alias("gone__"), "text_hash").distinct()
    gone = settle(gone, "pipeline-copies")
    kept = docs.join(gone, (F.col("doc_id") == F.col("gone__")) & (F.xxhash64("text") == F.col("text_hash")), "left_anti").select(docs.columns)
    again = settle(rows.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id").distinct(), "pipeline-repeated")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(once)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets; every document stays, whatever its id."""
    return redact_secrets(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confidently toxic documents go; confidently poor ones are kept by their rate and a hash of id and text. All others stay.

    Each row is judged by itself: rows without an id, or that share one, stay or go by their own text; equal rows go together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rated, domains, _ = mix(docs, labels, FACTORS, relative=True)
    p = {d: F.col("p")[i] for i, d in enumerate(domains)}
    toxic, poor = p.get("toxic", F.lit(0.0)), p.get("poor", F.lit(0.0))
    draw = F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "text_hash"), F.lit(1_000_000)) / 1_000_000
    thinned = (toxic + poor >= CONFIDENT) & (F.col("rate") < KEEP_FROM) & (draw >= F.col("rate"))
    gone = rated.where((toxic >= CONFIDENT) | thinned).select(F.col("doc_id").alias("gone__"), "text_hash").distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone__")) & (F.xxhash64("text") == F.col("text_hash")), "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("source_mixing", source_mixing), ("packing", packing)]

#: A trained network, signatures and a tokenizer are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, f"pipeline-{name}")
    return docs
