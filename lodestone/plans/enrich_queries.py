"""Metadata extraction in batches, removal over all tables, uploads by their suffix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import enrich, store
from lodestone.plans.registry import query
from lodestone.sources.tables import table
from lodestone.sources.versioned import TableSet, shared_folder


def _stand_in(document: F.Column, items: F.Column) -> F.Column:
    """A model's replies: whole batches of every fifth order are refused, single lines where order and line add up to a multiple of three; every fourth line is left out of good replies."""
    told = F.filter(items, lambda i: (i["chunk_index"] % 4 != 0) | (F.size(items) == 1))
    body = F.transform(told, lambda i: F.to_json(F.struct(i["chunk_index"].alias("chunk_index"), i["text"].alias("type"))))
    extra = F.lit('{"chunk_index": 77, "type": "of another document"}, {"chunk_index": "x"}')
    whole = F.concat(F.lit('{"document": {"title": "t"}, "chunks": ['), F.array_join(F.concat(body, F.array(extra)), ", "), F.lit("]}"))
    refused = F.when(F.size(items) > 1, document % 5 == 0).otherwise((document + items[0]["chunk_index"]) % 3 == 0)
    return F.when(refused, "I cannot do that").otherwise(whole)


@query("""WITH d AS (SELECT l_orderkey AS document_id, l_linenumber AS chunk_index, min(l_returnflag) AS text FROM lineitem GROUP BY ALL),
c AS (SELECT *, (row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) - 1) // 6 AS batch FROM d),
b AS (SELECT *, count(*) OVER (PARTITION BY document_id, batch) AS n, count(*) FILTER (WHERE chunk_index % 4 <> 0) OVER (PARTITION BY document_id, batch) AS listed FROM c),
h AS (SELECT *, CASE WHEN n > 1 AND document_id % 5 <> 0 AND listed > 0 THEN CASE WHEN chunk_index % 4 <> 0 THEN 'batch' ELSE 'fallback' END
  WHEN (document_id + chunk_index) % 3 = 0 THEN 'fallback' WHEN n > 1 THEN 'single' ELSE 'batch' END AS how FROM b)
SELECT document_id, chunk_index, how, CASE WHEN how <> 'fallback' THEN text ELSE 'none' END AS type FROM h""")
def metadata_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order = document, line = chunk: six a call; failed batches line by line, what fails again falls back."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_index")).agg(F.min("l_returnflag").alias("text"))
    out = enrich.extract(lines, _stand_in)
    return out.select("document_id", "chunk_index", "how", F.coalesce(F.get_json_object("meta", "$.type"), F.lit("none")).alias("type"))


@query("""WITH gone AS (SELECT doc_id FROM documents WHERE doc_id % 10 = 3 OR doc_id % 10 = 7),
t AS (SELECT 'chunks' AS name, doc_id FROM documents UNION ALL SELECT 'documents', doc_id FROM documents UNION ALL SELECT 'embeddings', vec_id FROM embeddings UNION ALL SELECT 'jobs', user_id FROM events
  UNION ALL SELECT 'metadata', doc_id FROM labels UNION ALL SELECT 'versions', o_custkey FROM orders)
SELECT name, CAST(count(*) AS BIGINT) AS before, CAST(count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM gone)) AS BIGINT) AS removed FROM t GROUP BY name""")
def cascade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of documents from all six tables in one commit, with the rows of each that went; orders = versions, labels = metadata, events = jobs."""
    t = lambda name, key: table(spark, sf_dir, name).select(F.col(key).alias("document_id"))
    rows = {"chunks": t("documents", "doc_id"), "documents": t("documents", "doc_id"), "embeddings": t("embeddings", "vec_id"), "jobs": t("events", "user_id"), "metadata": t("labels", "doc_id"), "versions": t("orders", "o_custkey")}
    tables = TableSet(spark, shared_folder(spark, "cascade"))
    with tables.transaction() as tx:
        for name, df in rows.items():
            tx.append(name, df)
    store.remove_documents(tables, rows["documents"].where("document_id % 10 in (3, 7)"), list(rows))
    was, now = tables.snapshot(1), tables.snapshot()
    counts = [was.read(n).agg(F.count("*").alias("before")).crossJoin(now.read(n).agg(F.count("*").alias("after"))).select(F.lit(n).alias("name"), "before", (F.col("before") - F.col("after")).alias("removed")) for n in rows]  # one row each
    return reduce(DataFrame.unionByName, counts)


@query("""SELECT o_custkey AS owner_id, o_orderstatus AS fingerprint, CAST(count(*) AS BIGINT) AS copies, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest_id, max(o_orderdate) AS uploaded_at
FROM orders GROUP BY ALL""")
def duplicate_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders = versions, old ones too: of each owner and fingerprint the one that came in last by time, ties to the larger id."""
    v = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner_id"), F.col("o_orderstatus").alias("fingerprint"), F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").alias("uploaded_at"))
    return store.newest_duplicates(v)


@query("""WITH k AS (SELECT doc_id % 7 <> 2 AS has_document, doc_id % 11 <> 5 AS has_version FROM documents)
SELECT CAST(count(*) AS BIGINT) AS before, CAST(count(*) FILTER (WHERE has_document AND has_version) AS BIGINT) AS after, CAST(count(*) FILTER (WHERE NOT (has_document AND has_version)) AS BIGINT) AS purged FROM k""")
def purge_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks a purge of orphans takes: before, after, and the difference."""
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("doc_id").alias("version_id"))
    left = store.purge_orphans(ids, ids.where("document_id % 7 <> 2"), ids.where("version_id % 11 <> 5"))
    n = lambda df, c: df.agg(F.count("*").alias(c))
    return n(ids, "before").crossJoin(n(left, "after")).withColumn("purged", F.col("before") - F.col("after"))  # one row each
