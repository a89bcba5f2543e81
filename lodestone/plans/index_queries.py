"""Queries over positional postings, the stored index and commits of several tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.operators import index, knn, store
from lodestone.plans.registry import query
from lodestone.plans.search_queries import DOC_TOKENS, PHRASES, RANK, SCORES, _phrases
from lodestone.sources.tables import chunks, questions, table, wide
from lodestone.sources.versioned import TableSet, shared_folder

#: Positions are those of the context sentence and the text as one; only the newest of equal texts of a language may be found.
FTS_PHRASE = f"""WITH {PHRASES},
body AS (SELECT doc_id, regexp_extract_all(lower('from ' || source || ' in ' || lang || ' ' || coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS ts, doc_id = max(doc_id) OVER (PARTITION BY lang, sha256(text)) AS current FROM documents),
pos AS (SELECT doc_id, current, unnest(ts) AS token, generate_subscripts(ts, 1) AS pos FROM body),
asked AS (SELECT query_id, term FROM ph UNION SELECT item_id, 'SRC' || (item_id % 20) || '-in-en' FROM benchmark UNION SELECT item_id, 'no such phrase' FROM benchmark),
parts AS (SELECT DISTINCT query_id, regexp_extract_all(lower(term), '[\\p{{L}}\\p{{N}}_]+') AS phrase FROM asked),
pw AS (SELECT phrase, unnest(phrase) AS token, generate_subscripts(phrase, 1) AS o FROM (SELECT DISTINCT phrase FROM parts WHERE len(phrase) > 0)),
met AS (SELECT DISTINCT phrase, doc_id FROM (SELECT phrase, doc_id, pos - o AS start FROM pw JOIN pos USING (token) WHERE current GROUP BY phrase, doc_id, pos - o HAVING count(*) = len(phrase))),
hit AS (SELECT DISTINCT query_id, doc_id FROM parts JOIN met USING (phrase)),
lex AS (SELECT DISTINCT query_id, unnest(phrase) AS token FROM parts), cnt AS (SELECT query_id, count(*) AS terms FROM lex GROUP BY query_id),
occ AS (SELECT doc_id, token, count(*) AS tf FROM pos WHERE token IN (SELECT token FROM lex) GROUP BY doc_id, token),
sc AS (SELECT query_id, doc_id AS chunk_id, round(sum(0.1 * list_sum(list_transform(range(1, tf + 1), lambda j: 1.0::DOUBLE / (j * j))) / 1.64493) / any_value(terms), 6) AS score
  FROM occ JOIN lex USING (token) JOIN cnt USING (query_id) SEMI JOIN hit ON hit.query_id = lex.query_id AND hit.doc_id = occ.doc_id GROUP BY query_id, doc_id)
SELECT query_id, chunk_id, score, {RANK} FROM sc WHERE score >= 0.01 QUALIFY rank <= 15"""


@query(FTS_PHRASE)
def fts_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of four words of each question and of its source, over context and text, in current versions."""
    d = wide(table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("chunk_id"), "lang", "source", "text")
    context = F.concat_ws(" ", F.lit("from"), "source", F.lit("in"), "lang", F.coalesce("text", F.lit("")))
    current = d.groupBy("lang", F.sha2("text", 256)).agg(F.max("chunk_id").alias("chunk_id")).select("chunk_id")
    qs = questions(spark, sf_dir)
    source = qs.select("query_id", F.concat(F.lit("SRC"), (F.col("query_id") % 20).cast("string"), F.lit("-in-en")).alias("term"))
    asked = _phrases(spark, sf_dir).unionByName(source).unionByName(qs.select("query_id", F.lit("no such phrase").alias("term")))
    wanted = asked.select(F.explode(tokens(F.col("term"))).alias("token")).distinct()
    return index.full_text(asked, index.asked_postings(wanted, d, context), allowed=current)


@query(f"""WITH corpus AS (SELECT doc_id, lang, CASE source WHEN 'src2' THEN text || ' again' ELSE text END AS text FROM documents WHERE source <> 'src1'),
{DOC_TOKENS.replace("FROM documents", "FROM corpus")}, bs AS ({SCORES}) SELECT * FROM (SELECT query_id, chunk_id, score, {RANK} FROM bs WHERE score > 0) WHERE rank <= 20""")
def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file = source. A stored index is built from src0 and src1 and compacted, the others are added, src2 is added again with another text, src1 is removed."""
    c = chunks(spark, sf_dir).select("chunk_id", F.col("source").alias("file_id"), "content")
    stored = index.PostingIndex(TableSet(spark, shared_folder(spark, "index")), buckets=8, spread=1)
    stored.add(c.where("file_id in ('src0', 'src1')"))
    stored.compact()
    stored.add(c.where("file_id not in ('src0', 'src1')"))
    stored.add(c.where("file_id = 'src2'").withColumn("content", F.concat("content", F.lit(" again"))))
    stored.remove(spark.createDataFrame([("src1",)], "file_id string"))
    return stored.bm25(questions(spark, sf_dir))


STORE_COMMIT = """
WITH d AS (SELECT doc_id, doc_id % 2 AS batch, lang, source, sha256(text) AS fp, CAST(length(text) AS BIGINT) AS chars FROM documents),
u AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY lang, fp ORDER BY batch, doc_id) = 1),
f AS (SELECT *, max(doc_id) OVER (PARTITION BY lang, source, batch) AS own, max(CASE WHEN batch = 1 THEN doc_id END) OVER (PARTITION BY lang, source) AS later FROM u),
s AS (SELECT *, CASE WHEN doc_id <> own THEN own WHEN batch = 0 THEN later END AS superseded_by FROM f)
SELECT doc_id AS document_id, lang AS owner_id, source AS family, CASE WHEN superseded_by IS NULL THEN 'active' ELSE 'superseded' END AS status, coalesce(superseded_by, -1) AS superseded_by, superseded_by IS NULL AS is_active, chars, CAST(2 AS BIGINT) AS at_version FROM s"""


@query(STORE_COMMIT)
def store_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even ids come in with one commit and odd ids with the next; a third commit breaks off after its first table and leaves no trace."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("owner_id"), F.col("source").alias("family"), F.sha2("text", 256).alias("fingerprint"), F.col("text").alias("content"))
    tables = TableSet(spark, shared_folder(spark, "store"))
    store.insert_documents(tables, d.where("document_id % 2 = 0"))
    store.insert_documents(tables, d.where("document_id % 2 = 1"))
    try:
        with tables.transaction() as tx:
            tx.append("chunks", tx.base.read("chunks"))
            raise InterruptedError
    except InterruptedError:
        pass
    now = tables.snapshot()
    text = now.read("chunks").groupBy("document_id").agg(F.sum(F.length("content").cast("long")).alias("chars"))
    versions = now.read("versions").select("document_id", "is_active")
    rows = now.read("documents").join(versions, "document_id").join(text, "document_id", "left")
    return rows.select("document_id", "owner_id", "family", "status", F.coalesce("superseded_by", F.lit(-1).cast("long")).alias("superseded_by"), "is_active", "chars", F.lit(now.version).cast("long").alias("at_version"))


VECTOR_ACTIVE = """
WITH cur AS (SELECT doc_id, source FROM documents QUALIFY doc_id = max(doc_id) OVER (PARTITION BY lang, sha256(text))),
v AS (SELECT vec_id, source, CAST(embedding AS DOUBLE[]) AS e FROM embeddings JOIN cur ON doc_id = vec_id),
q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qe, CASE vec_id % 3 WHEN 0 THEN ['src1', 'src3', 'src5', 'src7'] END AS allowed, CASE vec_id % 3 WHEN 1 THEN ['src0', 'src2'] END AS banned FROM embeddings WHERE vec_id % 25 = 0),
s AS (SELECT query_id, vec_id AS chunk_id, round(1 - list_cosine_similarity(qe, e), 6) + 0.0 AS score FROM q JOIN v ON (allowed IS NULL OR list_contains(allowed, source)) AND (banned IS NULL OR NOT list_contains(banned, source)))
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 25"""


@query(VECTOR_ACTIVE)
def vector_active_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector i stands for document i. Only the newest of equal texts of a language is active; a third of the questions allow four sources only, a third exclude two."""
    e = table(spark, sf_dir, "embeddings")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("fingerprint"))
    newest = d.groupBy("lang", "fingerprint").agg(F.max("doc_id").alias("document_id"))
    documents = newest.select("document_id", F.lit("active").alias("status"), F.col("document_id").alias("current_version_id"))
    own = d.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("doc_id").alias("version_id"), F.col("source").alias("file_id"))
    versions = d.select(F.col("doc_id").alias("version_id"), F.lit(True).alias("is_active"))
    rows = store.searchable(e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")), own, documents, versions)
    asks = e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"), F.when(F.col("vec_id") % 3 == 0, F.array(*[F.lit(f"src{i}") for i in (1, 3, 5, 7)])).alias("only"), F.when(F.col("vec_id") % 3 == 1, F.array(F.lit("src0"), F.lit("src2"))).alias("never"))
    return knn.nearest(asks, knn.build(rows.select("chunk_id", "file_id", "v"), 64, pivots=32))
