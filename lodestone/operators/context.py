"""Context packing, source attribution, support gate, session history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import SETTINGS as S
from lodestone.config import STOP_GATE
from lodestone.functions.text import let, terms, truncate


def pack_context(ranked: DataFrame, budget: int = S.context_chars) -> DataFrame:
    """ranked (query_id, rank, source, content, score) -> the entries that fit, in rank order: plus entry, chars, cut.

    Entries are "[Source: s]" and the chunk, cut at the chunk limit. The first one over the budget is cut to what
    remains if that is enough, and everything after it is left out. Blank chunks are passed over.
    """
    text = F.regexp_replace("content", r"^\s+|\s+$", "")
    body = truncate(text, F.lit(S.chunk_chars), S.truncation_share)
    head = F.concat(F.lit("[Source: "), F.coalesce("source", F.lit("unknown")), F.lit("]\n"))
    rows = ranked.where(F.length(text) > 0).withColumn("head", head).withColumn("body", body).withColumn("chars", (F.length("head") + F.length("body")).cast("long"))
    w = Window.partitionBy("query_id").orderBy("rank")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("total", F.sum("chars").over(upto)).withColumn("over", (F.col("total") > budget).cast("int"))
    rows = rows.withColumn("overs", F.sum("over").over(upto)).where("overs <= 1 and (over = 0 or overs = 1)")
    remaining = F.lit(budget) - (F.col("total") - F.col("chars"))
    rows = rows.withColumn("remaining", remaining).where((F.col("over") == 0) | (F.col("remaining") > S.least_remaining))
    last = F.concat("head", truncate(F.col("body"), (F.col("remaining") - S.marker_room).cast("int"), S.truncation_share))
    entry = F.when(F.col("over") == 0, F.concat("head", "body")).otherwise(last)
    return rows.select("query_id", "rank", "chunk_id", F.coalesce("source", F.lit("unknown")).alias("source"), "score", entry.alias("entry"), F.length(entry).cast("long").alias("chars"), (F.col("over") == 1).alias("cut"))


def source_share(packed: DataFrame) -> DataFrame:
    """Sources with at least 40 % of the best source's score, five at most (ties by name)."""
    per = packed.groupBy("query_id", "source").agg(F.round(F.sum("score"), 6).alias("score"))
    best = F.max("score").over(Window.partitionBy("query_id"))
    kept = per.withColumn("best", best).where(F.col("score") >= F.col("best") * S.source_share)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "source"))
    return kept.withColumn("place", place).where(F.col("place") <= S.max_sources).select("query_id", "place", "source", "score")


def support_gate(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, top_score, hits, supported): score at least 0.18 and one question term inside the first three texts."""
    head = ranked.where("rank <= 3").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda s: F.coalesce(s["content"], F.lit(""))), " ").alias("text"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"))
    asked = questions.select("query_id", terms(F.col("q"), STOP_GATE).alias("terms"))
    hits = let(F.lower("text"), lambda low: F.size(F.filter("terms", lambda t: F.contains(low, t))))
    both = asked.join(head, "query_id", "left").withColumn("hits", F.coalesce(F.when(F.col("text").isNotNull(), hits), F.lit(0)).cast("long"))
    ok = F.col("top_score").isNotNull() & (F.col("top_score") >= S.support_score) & ((F.size("terms") == 0) | (F.col("hits") >= 1))
    return both.select("query_id", F.coalesce("top_score", F.lit(0.0)).alias("top_score"), "hits", ok.alias("supported"))


def session_history(messages: DataFrame, last: int = S.session_messages, budget: int = S.session_chars, each: int = S.message_chars) -> DataFrame:
    """The last messages of each session, cut, oldest first, until the character budget is used up."""
    newest = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn")))
    recent = messages.withColumn("back", newest).where(F.col("back") <= last)
    line = F.concat(F.initcap("role"), F.lit(": "), F.substring(F.coalesce("content", F.lit("")), 1, each))
    upto = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = recent.withColumn("line", line).withColumn("total", F.sum(F.length("line")).over(upto))
    rows = rows.withColumn("stopped", F.max((F.col("total") > budget).cast("int")).over(upto)).where("stopped = 0")
    return rows.select("session_id", "turn", "role", "line", F.col("total").cast("long").alias("total"))


def retrieval_confidence(hits: Column) -> Column:
    return F.least(F.lit(0.3) + hits * 0.1, F.lit(1.0))


def hint_block(ranked: DataFrame, first: int = 5) -> DataFrame:
    """ranked (query_id, rank, vendor, product, domain) -> query_id, hints: what the first chunks say, each kind sorted; null without any."""
    kinds = ("vendor", "product", "domain")
    sets = [F.array_sort(F.collect_set(F.when(F.length(k) > 0, F.col(k)))).alias(k) for k in kinds]  # five chunks a question
    per = ranked.where(F.col("rank") <= first).groupBy("query_id").agg(*sets)
    lines = [F.when(F.size(k) > 0, F.concat(F.lit(f"{k.capitalize()}s: "), F.array_join(k, ", "))) for k in kinds]
    text = F.concat_ws("\n  ", *lines)
    return per.select("query_id", F.when(F.length(text) > 0, F.concat(F.lit("DOCUMENT CONTEXT HINTS:\n  "), text)).alias("hints"))


def confidence_level(confidence: Column) -> Column:
    return F.when(confidence >= 0.7, "HIGH").when(confidence >= 0.4, "MODERATE").otherwise("LOW")


def prompt(*sections: Column) -> Column:
    """The sections that are there, one blank line between them: instruction, history, hints, confidence, rules, documents, question."""
    return F.concat_ws("\n\n", *[F.nullif(s, F.lit("")) for s in sections])
