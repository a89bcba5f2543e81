"""Versioned-store, session and job queries; which table stands for what is in the docstrings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import name_similarity
from lodestone.operators import store
from lodestone.plans.registry import query
from lodestone.sources.tables import messages, table
from lodestone.sources.versioned import settle


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A family is (language, source); document ids are its versions in order."""
    d = table(spark, sf_dir, "documents")
    v = d.select(F.col("doc_id").alias("document_id"), F.col("lang").alias("owner_id"), "source", F.sha2("text", 256).alias("fingerprint"))
    return store.supersede(v, ["owner_id", "source"], "document_id")


@query("SELECT doc_id AS document_id, lang AS owner_id, source, sha256(text) AS fingerprint, doc_id = max(doc_id) OVER (PARTITION BY lang, source) AS is_active FROM documents")
def supersede_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir)


@query("SELECT doc_id AS chunk_id, lang AS owner_id, source, CAST(length(text) AS BIGINT) AS chars FROM documents QUALIFY doc_id = max(doc_id) OVER (PARTITION BY lang, source)")
def active_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _versions(spark, sf_dir)
    documents = v.groupBy("owner_id", "source").agg(F.max("document_id").alias("current_version_id")).select(F.col("current_version_id").alias("document_id"), "current_version_id", F.lit("active").alias("status"))
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("doc_id").alias("version_id"), F.col("lang").alias("owner_id"), "source", F.length("text").cast("long").alias("chars"))
    return store.active_chunks(chunks, documents, v.select(F.col("document_id").alias("version_id"), "is_active")).select("chunk_id", "owner_id", "source", "chars")


@query("SELECT lang AS owner_id, sha256(text) AS fingerprint, CAST(count(*) AS BIGINT) AS copies, max(doc_id) AS newest_id FROM documents GROUP BY ALL HAVING count(*) > 1")
def dup_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.duplicates_by_hash(_versions(spark, sf_dir))


@query("SELECT doc_id, sha256(text) AS fingerprint FROM documents")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), "event_id", F.col("event_type").alias("status"), F.col("ts").alias("created_at"))


@query("""SELECT c.c_custkey AS file_id, c.c_name AS name, j.o_orderkey AS job_id, j.o_orderstatus AS status, j.o_orderdate AS created_at FROM customer c LEFT JOIN LATERAL
(SELECT * FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) j ON true""")
def latest_job_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer = document, orders = job: every document with its latest job, if any."""
    jobs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"))
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), F.col("c_name").alias("name"))
    return files.join(store.latest(jobs, ["file_id"], ["created_at", "job_id"]), "file_id", "left").select("file_id", "name", "job_id", "status", "created_at")


ORACLE_LIST_FILES = """WITH j AS (SELECT user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT CAST(d.doc_id AS VARCHAR) AS id, d.source AS name, round(d.n_chars / 1024.0, 2) AS kb, CASE WHEN j.event_type IS NULL OR j.event_type = 'purchase' THEN 'indexed' ELSE j.event_type END AS status, strftime(j.ts, '%Y-%m-%dT%H:%M:%S') AS updated
FROM documents d LEFT JOIN j ON j.user_id = d.doc_id"""


@query(ORACLE_LIST_FILES)
def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the latest state of the job of their id; done (purchase) or none shows as indexed."""
    jobs = store.latest(_jobs(spark, sf_dir), ["file_id"], ["created_at", "event_id"])
    d = table(spark, sf_dir, "documents").join(jobs, F.col("doc_id") == F.col("file_id"), "left")
    status = F.when(F.col("status").isNull() | (F.col("status") == "purchase"), "indexed").otherwise(F.col("status"))
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("name"), F.round(F.col("n_chars") / 1024.0, 2).alias("kb"), status.alias("status"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("updated"))


@query("SELECT user_id AS file_id, event_type AS status, ts AS created_at, CAST(k AS INTEGER) AS processed FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events = job log; counters are text in JSON and cast on read."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), F.col("ts").alias("created_at"), "event_id", F.col("event_type").alias("status"), F.get_json_object("props", "$.k").try_cast("int").alias("processed"))
    return store.latest(e, ["file_id"], ["created_at", "event_id"]).select("file_id", "status", "created_at", "processed")


@query("SELECT conv_id AS session_id, CAST(count(*) AS BIGINT) AS messages, CAST(count(*) FILTER (WHERE role = 'user') AS BIGINT) AS questions, max(turn) AS last_turn, arg_min(CASE WHEN length(text) > 60 THEN left(text, 60) || '...' ELSE text END, turn) FILTER (WHERE role = 'user') AS title FROM conversations GROUP BY conv_id")
def list_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with their counts; the title is the first question, cut at 60 characters."""
    title = F.when(F.length("content") > 60, F.concat(F.substring("content", 1, 60), F.lit("..."))).otherwise(F.col("content"))
    m = messages(spark, sf_dir).withColumn("title", title)
    asked = F.col("role") == "user"
    return m.groupBy("session_id").agg(F.count("*").alias("messages"), F.sum(asked.cast("long")).alias("questions"), F.max("turn").alias("last_turn"), F.min_by("title", F.when(asked, F.col("turn"))).alias("title"))


@query("SELECT l.doc_id, CAST(count(c.turn) AS BIGINT) AS messages FROM (SELECT DISTINCT doc_id FROM labels) l LEFT JOIN conversations c ON c.conv_id = l.doc_id GROUP BY l.doc_id")
def session_message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels = sessions; those without messages count 0. Messages are counted before the join."""
    counts = messages(spark, sf_dir).groupBy(F.col("session_id").alias("doc_id")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "labels").select("doc_id").distinct().join(counts, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("messages"))


@query("SELECT conv_id AS session_id, turn, role, text AS content, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS position FROM conversations")
def session_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("turn")) - 1
    return messages(spark, sf_dir).withColumn("position", place)


@query("SELECT conv_id AS session_id, turn, role, text AS content FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def recent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn")))
    return messages(spark, sf_dir).withColumn("back", back).where("back <= 4").drop("back")


@query("""SELECT conv_id AS session_id, turn, role, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 = 1 THEN CASE q WHEN 1 THEN 'like' WHEN 0 THEN 'dislike' ELSE 'none' END ELSE 'none' END AS feedback
FROM conversations c LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) l ON l.doc_id = c.conv_id""")
def nth_message_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback (labels: quality) goes to the second message of the session of that id."""
    m = messages(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("turn")) - 1)
    f = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("session_id")).agg(F.max("quality").alias("q"))
    word = F.when(F.col("q") == 1, "like").when(F.col("q") == 0, "dislike").otherwise("none")
    m = m.join(f, "session_id", "left").withColumn("feedback", F.lit("none"))
    return store.update_where(m, F.col("n") == 1, ("feedback",), feedback=word).select("session_id", "turn", "role", "feedback")


@query("SELECT l_orderkey AS chunk_order, CAST(l_linenumber AS INTEGER) AS chunk_line FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P') OR NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 40)")
def orphan_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem = chunk, orders (not P) = document, part (size up to 40) = version."""
    c = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("chunk_id"), F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("version_id"))
    d = table(spark, sf_dir, "orders").where("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("document_id"))
    v = table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("version_id"))
    return store.orphans(c, d, v).select(F.col("chunk_id.l_orderkey").alias("chunk_order"), F.col("chunk_id.l_linenumber").alias("chunk_line"))


@query("SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def in_subquery_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("vec_id"))
    return table(spark, sf_dir, "embeddings").select("vec_id").join(ids, "vec_id", "left_semi")


@query("SELECT e.vec_id AS chunk_id, e.label, d.source, d.lang AS owner_id, m.quality FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id JOIN labels m ON m.doc_id = d.doc_id")
def embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings to documents to labels on their keys."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source", F.col("lang").alias("owner_id"))
    m = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), "quality")
    return e.join(d, "chunk_id").join(m, "chunk_id")


@query("SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.title, o.title) AS title FROM (SELECT doc_id, 'old ' || lang AS title FROM documents WHERE doc_id % 3 <> 0) o FULL JOIN (SELECT doc_id, 'new ' || quality AS title FROM labels) n ON n.doc_id = o.doc_id")
def upsert_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels are upserted over titles that two thirds of the documents have already."""
    old = table(spark, sf_dir, "documents").where("doc_id % 3 != 0").select("doc_id", F.concat(F.lit("old "), "lang").alias("title"))
    new = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("new "), F.col("quality").cast("string")).alias("title"))
    return store.upsert(old, new, "doc_id")


@query("SELECT doc_id, 'old' AS origin FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'new' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def insert_do_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.lit("old").alias("origin"))
    return store.insert_new(old, table(spark, sf_dir, "labels").select("doc_id", F.lit("new").alias("origin")), "doc_id")


@query("""SELECT 'documents' AS tbl, CAST(count(*) AS BIGINT) AS kept FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'labels', CAST(count(*) AS BIGINT) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'conversations', CAST(count(*) AS BIGINT) FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents are deleted from three tables; what is left of each is counted."""
    gone = table(spark, sf_dir, "labels").where("toxic = 1")
    left = store.delete_documents(gone, "doc_id", documents=table(spark, sf_dir, "documents").select("doc_id"), labels=table(spark, sf_dir, "labels").select("doc_id"), conversations=table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")))
    counts = [t.agg(F.count("*").alias("kept")).select(F.lit(n).alias("tbl"), "kept") for n, t in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT d.lang AS owner_id, CAST(count(*) AS BIGINT) AS documents, CAST(count(DISTINCT d.source) AS BIGINT) AS sources, CAST(count(l.doc_id) AS BIGINT) AS labelled, CAST(count(e.vec_id) AS BIGINT) AS embedded FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY d.lang")
def debug_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("owner_id"), "source")
    d = d.join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "left").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("e")), "doc_id", "left")
    return d.groupBy("owner_id").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"), F.count("l").alias("labelled"), F.count("e").alias("embedded"))


@query("SELECT c_custkey, c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey, CASE WHEN c_acctbal < 0 THEN 'error' ELSE 'done' END AS status, CASE WHEN c_acctbal < 0 THEN 0.0::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer")
def update_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update of allowed columns where a condition holds."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.lit("done").alias("status"), "c_acctbal")
    return store.update_where(c, F.col("c_acctbal") < 0, ("status", "c_acctbal"), status=F.lit("error"), c_acctbal=F.lit(0.0))


#: Matching blocks by recursion: of every open pair of pieces the longest common run, then what lies left and right of it.
NAME_PAIRS = """
r AS (SELECT p_brand AS owner_id, p_partkey AS chunk_id, p_name AS other FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) <= 24),
pr AS (SELECT p_partkey AS query_id, chunk_id, lower(trim(p_name, ' ')) AS a, lower(trim(other, ' ')) AS b FROM part JOIN r ON owner_id = p_brand),
di AS (SELECT DISTINCT a, b FROM pr WHERE length(a) > 0 AND length(b) > 0 AND 2.0 * least(length(a), length(b)) / (length(a) + length(b)) >= 0.6),
sg AS (SELECT a, b, a AS x, b AS y, 0 AS n FROM di UNION ALL
  SELECT a, b, unnest([x[:m.i - 1], x[m.i + m.n:]]) AS x, unnest([y[:m.j - 1], y[m.j + m.n:]]) AS y, unnest([m.n, 0]) AS n FROM
    (SELECT a, b, x, y, list_reduce([{'n': CAST(0 AS BIGINT), 'i': CAST(1 AS BIGINT), 'j': CAST(1 AS BIGINT)}] || flatten(list_transform(range(1, length(x) + 1), lambda i: list_transform(range(1, length(y) + 1), lambda j:
        {'n': len(list_filter(range(1, least(length(x) - i, length(y) - j) + 2), lambda k: substr(x, i, k) = substr(y, j, k))), 'i': i, 'j': j}))),
        lambda p, q: CASE WHEN q.n > p.n OR (q.n = p.n AND (q.i < p.i OR (q.i = p.i AND q.j < p.j))) THEN q ELSE p END) AS m
     FROM sg WHERE x <> '' AND y <> '') WHERE m.n > 0),
ma AS (SELECT a, b, sum(n) AS n FROM sg GROUP BY a, b),
cs AS (SELECT query_id, chunk_id, round(2.0 * n / (length(a) + length(b)), 4) AS score FROM pr JOIN ma USING (a, b))"""


@query(f"WITH RECURSIVE {NAME_PAIRS} SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM cs WHERE score >= 0.6 QUALIFY rank <= 8")
def version_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part = documents, brand = owner: names against the 24 newest of the same owner. Equal pairs of names are matched once."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_brand").alias("owner_id"), F.col("p_name").alias("name"))
    newest = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("query_id")))  # 24 a task are kept before the shuffle
    recent = p.withColumn("n", newest).where("n <= 24").select("owner_id", F.col("query_id").alias("chunk_id"), F.col("name").alias("other"))
    pairs = p.select("owner_id", "name").distinct().join(recent, "owner_id").select("name", "other").distinct().withColumn("score", name_similarity(F.col("name"), F.col("other"), 0.6))
    alike = settle(pairs.where("score >= 0.59"), "alike")  # rounding comes later
    return store.version_candidates(p, recent, alike)


_VERSIONED = "d AS (SELECT o_orderkey AS document_id, CASE WHEN o_orderstatus = 'P' THEN 'superseded' ELSE 'active' END AS status, cur FROM orders LEFT JOIN (SELECT l_orderkey, max(l_partkey) AS cur FROM lineitem WHERE l_linenumber > 1 GROUP BY 1) ON l_orderkey = o_orderkey)"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders = documents; the current version is the largest part of the lines after the first, where there are any."""
    cur = table(spark, sf_dir, "lineitem").where("l_linenumber > 1").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.max("l_partkey").alias("current_version_id"))
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") == "P", "superseded").otherwise("active").alias("status"))
    return d.join(cur, "document_id", "left")


@query(f"""WITH {_VERSIONED} SELECT vec_id, label, l_linenumber AS line, l_partkey AS version_id FROM embeddings JOIN lineitem ON l_orderkey = vec_id JOIN d ON d.document_id = l_orderkey JOIN part ON p_partkey = l_partkey
WHERE d.status = 'active' AND p_size <= 40 AND d.cur = l_partkey""")
def searchable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem = chunks (all lines of an order share its vector), part = versions."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id"), "label")
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("version_id"), F.col("l_linenumber").alias("line"))
    v = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("version_id"), (F.col("p_size") <= 40).alias("is_active"))
    return store.searchable(e, c, _documents(spark, sf_dir), v).select("vec_id", "label", "line", "version_id")


@query(f"WITH {_VERSIONED} SELECT document_id, status, coalesce(p_partkey, 0) AS version_id, coalesce(CAST(p_size AS VARCHAR), '0') AS file_size_mb FROM d LEFT JOIN part ON p_partkey = cur AND p_size <= 40")
def current_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("version_id"), F.col("p_size").cast("string").alias("file_size_mb"))
    return store.current_versions(_documents(spark, sf_dir), v).select("document_id", "status", F.coalesce("version_id", F.lit(0)).alias("version_id"), "file_size_mb")
