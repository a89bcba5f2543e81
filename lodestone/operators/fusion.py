"""Strategy weights, weighted reciprocal-rank fusion, reranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import SETTINGS as S
from lodestone.operators.search import top_ranked

#: Channels in the order that text and metadata are taken from.
CHANNELS = ("vector", "bm25", "keyword", "metadata")


def strategy_weights(strategy: Column) -> tuple[Column, Column, Column]:
    """(vector, bm25, keyword) weights, adding up to 1, moved towards what the strategy asks for."""
    v, b, k = S.vector_weight, S.bm25_weight, S.keyword_weight
    kw, sem = strategy == "keyword", strategy == "semantic"
    vec = F.when(kw, F.greatest(F.lit(0.10), F.lit(v - 0.15))).when(sem, F.lit(v + 0.10)).otherwise(F.lit(v))
    bm = F.when(kw, F.lit(b + 0.06)).otherwise(F.lit(b))
    key = F.when(kw, F.lit(k + 0.09)).when(sem, F.greatest(F.lit(0.05), F.lit(k - 0.10))).otherwise(F.lit(k))
    total = vec + bm + key
    return vec / total, bm / total, key / total


def fuse(channels: dict[str, DataFrame], strategies: DataFrame, k: int = S.fused_candidates) -> DataFrame:
    """channels: name to (query_id, chunk_id, rank[, exact]); strategies (query_id, strategy).

    Weight / (60 + rank) summed over channels; exact (substring) hits of the keyword channel count double; chunks that
    two or three channels found are boosted.
    """
    v, b, key = strategy_weights(F.coalesce("strategy", F.lit("mixed")))
    weights = {"vector": v, "bm25": b, "keyword": key, "metadata": F.lit(S.metadata_weight)}
    parts = []
    for i, name in enumerate(CHANNELS):
        if name in channels:
            c = channels[name]
            exact = F.col("exact") if "exact" in c.columns else F.lit(False)
            parts.append(c.select("query_id", "chunk_id", "rank", exact.alias("exact"), F.lit(i).alias("channel")))
    hits = reduce(DataFrame.unionByName, parts).join(strategies.select("query_id", "strategy"), "query_id", "left")
    weight = reduce(lambda acc, i: F.when(F.col("channel") == i, weights[CHANNELS[i]]).otherwise(acc), range(len(CHANNELS)), F.lit(0.0))
    one = weight / (S.rrf_k + F.col("rank")) * F.when(F.col("exact"), S.exact_boost).otherwise(1.0)
    per = hits.groupBy("query_id", "chunk_id").agg(F.sum(one).alias("sum"), F.countDistinct("channel").alias("channels"))
    boost = F.when(F.col("channels") >= 3, S.two_channels * S.three_channels).when(F.col("channels") == 2, S.two_channels).otherwise(1.0)
    return top_ranked(per.select("query_id", "chunk_id", F.round(F.col("sum") * boost, 10).alias("score"), "channels"), k)


def fuse_two(vector: DataFrame, bm25: DataFrame, k: int = S.fused_candidates, vector_weight: float = 0.6, bm25_weight: float = 0.4) -> DataFrame:
    """Plain two-channel fusion without boosts."""
    both = vector.select("query_id", "chunk_id", (vector_weight / (S.rrf_k + F.col("rank"))).alias("s")).unionByName(bm25.select("query_id", "chunk_id", (bm25_weight / (S.rrf_k + F.col("rank"))).alias("s")))
    return top_ranked(both.groupBy("query_id", "chunk_id").agg(F.round(F.sum("s"), 10).alias("score")), k)


def rerank_none(fused: DataFrame, k: int = S.rerank_top) -> DataFrame:
    return fused.where(F.col("rank") <= k)


def rerank(fused: DataFrame, relevance: DataFrame, k: int = S.rerank_top) -> DataFrame:
    """relevance (query_id, chunk_id, relevance 0 to 10, null or no row: not scored); see `rerank_graded`."""
    return rerank_graded(fused.join(relevance, ["query_id", "chunk_id"], "left"), k)


def rerank_graded(graded: DataFrame, k: int = S.rerank_top) -> DataFrame:
    """graded: fused rows with their relevance, 0 to 10 or null.

    Scored chunks get a blend of relevance and fusion, others keep their fusion score; both are sorted together, so
    unscored ones sink. A lone candidate is returned as it is. The candidates are read once: they are counted in a window.
    """
    lone = F.count("*").over(Window.partitionBy("query_id"))
    blend = F.col("relevance") / 10.0 * S.rerank_score_weight + F.col("score") * S.rerank_fusion_scale * S.rerank_fusion_weight
    scored = graded.withColumn("blend", F.round(F.when((lone > 1) & F.col("relevance").isNotNull(), blend).otherwise(F.col("score")), 10))
    out = scored.select("query_id", "chunk_id", F.col("score").alias("fusion"), "relevance", F.col("blend").alias("score"))
    return top_ranked(out, k)


def rerank_by_place(fused: DataFrame, answers: DataFrame, k: int = S.rerank_top, pool: int = S.fused_candidates) -> DataFrame:
    """fused (query_id, chunk_id, score, rank) with a model's answers (query_id, raw: a JSON list of chunk numbers and scores) -> query_id, chunk_id, score, rank.

    A grade belongs to the candidate whose rank is its number; numbers out of range are passed over. A candidate that is
    graded twice counts twice, in the answer's order; one without a grade keeps its fusion score. Questions with one
    candidate, or without a readable answer, keep the order of fusion.
    """
    from lodestone.functions.text import grades

    few = fused.where(F.col("rank") <= pool)
    told = answers.select("query_id", grades(F.col("raw")).alias("g")).where("g is not null")
    many = few.groupBy("query_id").agg(F.count("*").alias("n")).where("n > 1")
    told = told.join(many, "query_id", "left_semi")
    each = told.select("query_id", F.posexplode("g").alias("place", "g")).select("query_id", "place", F.coalesce("g.chunk", F.lit(0)).alias("rank"), F.coalesce("g.score", F.lit(0.0)).alias("relevance"))
    graded = each.join(few, ["query_id", "rank"])  # a number out of range meets no candidate
    blend = F.col("relevance") / 10.0 * S.rerank_score_weight + F.col("score") * S.rerank_fusion_scale * S.rerank_fusion_weight
    rows = graded.select("query_id", "chunk_id", F.round(blend, 10).alias("score"), "place")
    rest = few.join(graded.select("query_id", "rank").distinct(), ["query_id", "rank"], "left_anti")
    rest = rest.join(told.select("query_id", F.lit(True).alias("told")).distinct(), "query_id", "left")
    kept = rest.select("query_id", "chunk_id", "score", (F.col("rank") + 1_000_000).alias("place"), "told")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(F.when(F.col("told"), F.col("score"))), "place")
    both = rows.withColumn("told", F.lit(True)).unionByName(kept)
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")
