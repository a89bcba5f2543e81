"""Retrieval as a whole, with file lists, file types, phrases, a reranker's grades and the counts of every step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import knn, retrieve, rules
from lodestone.plans import rule_queries
from lodestone.plans.registry import query
from lodestone.plans.search_queries import RANK
from lodestone.sources.tables import chunks, questions, table

TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
MAY = "asker = lang AND (files IS NULL OR list_contains(files, source))"
SQL = rf"""WITH
oq AS (SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN 'ERROR 500 at 10.0.0.1 and 10.0.0.2 ' || text WHEN 1 THEN 'how to troubleshoot on kubernetes and aws ' || text
    WHEN 2 THEN 'who wrote "' || array_to_string(regexp_split_to_array(text, '\s+')[2:4], ' ') || '"' ELSE text END AS q,
  CASE item_id % 3 WHEN 1 THEN 'de' ELSE 'en' END AS asker, CASE item_id % 5 WHEN 0 THEN ['src0', 'src4', 'src8', 'src12', 'src16'] END AS files, CASE WHEN item_id % 6 <> 0 THEN 'kb' END AS kind FROM benchmark),
oc AS (SELECT doc_id, lang, source, CASE doc_id % 3 WHEN 0 THEN text || ' seen at 10.0.0.1' ELSE text END AS text, CASE doc_id % 5 WHEN 0 THEN 'aws' WHEN 1 THEN 'kubernetes' ELSE '' END AS vendor, CASE doc_id % 4 WHEN 0 THEN 'log' ELSE 'kb' END AS type FROM documents),
body AS (SELECT doc_id, {TOKENS.format("text")} AS ts FROM oc),
pos AS (SELECT doc_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS pos FROM body),
dl AS (SELECT doc_id, len(ts) AS dl FROM body WHERE len(ts) > 0),
tf AS (SELECT doc_id, token, count(*) AS tf FROM pos GROUP BY doc_id, token),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
cs AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
qt AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS.format("q")}) AS token FROM oq) GROUP BY ALL),
bs AS (SELECT query_id, tf.doc_id AS chunk_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1)))), 6) AS score FROM tf JOIN qt USING (token) JOIN df USING (token) JOIN dl ON dl.doc_id = tf.doc_id CROSS JOIN cs GROUP BY query_id, tf.doc_id),
bm0 AS (SELECT query_id, chunk_id, {RANK} FROM bs JOIN oc ON oc.doc_id = chunk_id JOIN oq USING (query_id) WHERE kind IS NULL OR kind = type QUALIFY rank <= 20),
bm AS (SELECT query_id, chunk_id, bm0.rank FROM bm0 JOIN oc ON oc.doc_id = chunk_id JOIN oq USING (query_id) WHERE {MAY}),
i1 AS (SELECT query_id, regexp_replace(q, '^[[:space:]]+|[[:space:]]+$', '', 'g') AS t FROM oq),
i2 AS (SELECT query_id, {rule_queries.MATCHES} AS m, {rule_queries._hits("t", rules.SEMANTIC_PATTERNS)} AS sh, len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: length(w) > 0)) AS words, {TOKENS.format("t")} AS ts, t FROM i1),
i3 AS (SELECT *, words <= 3 AND len(m) = 0 AND sh = 0 AS short FROM i2),
i4 AS (SELECT *, CASE WHEN short THEN 0.4::DOUBLE ELSE round(least(1.0::DOUBLE, len(m) * 0.25::DOUBLE), 6) END AS kw, CASE WHEN short THEN 0.4::DOUBLE ELSE round(least(1.0::DOUBLE, sh * 0.3::DOUBLE), 6) END AS sem,
  list_filter(list_transform(m, lambda x: regexp_replace(regexp_replace(x, '^[[:space:]]+|[[:space:]]+$', '', 'g'), '^"+|"+$', '', 'g')), lambda x: length(x) >= 2) AS exact,
  list_filter(ts, lambda w: length(w) > 2 AND NOT list_contains(['the','a','an','is','are','to','for','of','in','on','how','what','when','where','why','do','does','can','i','me','my','you','your','please','tell','about','and','or','not','this','that','with','from','it','be','was','were','been','have','has'], w)) AS content FROM i3),
intent AS (SELECT query_id, kw, sem, CASE WHEN kw >= 0.6 AND kw > sem THEN 'keyword' WHEN sem >= 0.6 AND sem > kw THEN 'semantic' ELSE 'mixed' END AS strategy, (CASE WHEN len(exact) > 0 THEN exact ELSE content END)[1:20] AS terms,
  list_distinct(regexp_extract_all(lower(t), '\b(?:aws|kubernetes)\b')) AS vendors FROM i4),
ask AS (SELECT query_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS place FROM intent),
parts AS (SELECT DISTINCT query_id, {TOKENS.format("term")} AS phrase FROM ask),
pw AS (SELECT phrase, unnest(phrase) AS token, generate_subscripts(phrase, 1) AS o FROM (SELECT DISTINCT phrase FROM parts WHERE len(phrase) > 0)),
met AS (SELECT DISTINCT phrase, doc_id FROM (SELECT phrase, doc_id, pos - o AS start FROM pw JOIN pos USING (token) GROUP BY phrase, doc_id, pos - o HAVING count(*) = len(phrase))),
hit AS (SELECT DISTINCT query_id, met.doc_id FROM parts JOIN met USING (phrase) JOIN oc ON oc.doc_id = met.doc_id JOIN oq USING (query_id) WHERE {MAY}),
lex AS (SELECT DISTINCT query_id, unnest(phrase) AS token FROM parts), cnt AS (SELECT query_id, count(*) AS terms FROM lex GROUP BY query_id),
fs AS (SELECT query_id, tf.doc_id AS chunk_id, round(sum(0.1 * list_sum(list_transform(range(1, tf + 1), lambda j: 1.0::DOUBLE / (j * j))) / 1.64493) / any_value(terms), 6) AS score
  FROM tf JOIN lex USING (token) JOIN cnt USING (query_id) SEMI JOIN hit ON hit.query_id = lex.query_id AND hit.doc_id = tf.doc_id GROUP BY query_id, tf.doc_id),
fts AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fs WHERE score >= 0.01 QUALIFY rank <= 15),
st AS (SELECT query_id, lower(term) AS term, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n FROM ask WHERE regexp_matches(term, '[.:/\\-]') OR regexp_matches(term, '^0[xX]') QUALIFY n <= 8),
sl AS (SELECT query_id, doc_id AS chunk_id, count(*) AS score FROM (SELECT DISTINCT query_id, term FROM st) JOIN oc ON contains(lower(text), term) JOIN oq USING (query_id) WHERE {MAY} GROUP BY query_id, doc_id),
sk AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM sl WHERE NOT EXISTS (SELECT 1 FROM fts WHERE fts.query_id = sl.query_id AND fts.chunk_id = sl.chunk_id)),
kwd AS (SELECT query_id, chunk_id, rank, false AS exact FROM fts UNION ALL SELECT sk.query_id, chunk_id, r + coalesce(h, 0), true FROM sk LEFT JOIN (SELECT query_id, max(rank) AS h FROM fts GROUP BY query_id) USING (query_id) WHERE r + coalesce(h, 0) <= 15),
md AS (SELECT query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM (SELECT DISTINCT query_id, doc_id FROM (SELECT query_id, unnest(vendors) AS h FROM intent) JOIN oc ON contains(vendor, h) JOIN oq USING (query_id) WHERE {MAY}) QUALIFY rank <= 10),
ds AS (SELECT oq.query_id, e.vec_id AS chunk_id, round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM oq JOIN embeddings q ON q.vec_id = oq.query_id CROSS JOIN embeddings e JOIN oc ON oc.doc_id = e.vec_id WHERE files IS NULL OR list_contains(files, source)),
vc0 AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS rank FROM ds QUALIFY rank <= 25),
vc AS (SELECT query_id, chunk_id, vc0.rank FROM vc0 JOIN oc ON oc.doc_id = chunk_id JOIN oq USING (query_id) WHERE {MAY}),
every AS (SELECT query_id, chunk_id, rank, false AS exact, 0 AS c FROM vc UNION ALL SELECT query_id, chunk_id, rank, false, 1 FROM bm UNION ALL SELECT query_id, chunk_id, rank, exact, 2 FROM kwd UNION ALL SELECT query_id, chunk_id, rank, false, 3 FROM md),
own AS (SELECT query_id, chunk_id, exact, c, row_number() OVER (PARTITION BY query_id, c ORDER BY rank) AS rank FROM every),
wt AS (SELECT query_id, CASE strategy WHEN 'keyword' THEN 0.45::DOUBLE - 0.15::DOUBLE WHEN 'semantic' THEN 0.55::DOUBLE ELSE 0.45::DOUBLE END AS v, CASE strategy WHEN 'keyword' THEN 0.36::DOUBLE ELSE 0.30::DOUBLE END AS b, CASE strategy WHEN 'keyword' THEN 0.34::DOUBLE WHEN 'semantic' THEN 0.25::DOUBLE - 0.10::DOUBLE ELSE 0.25::DOUBLE END AS k FROM intent),
sc AS (SELECT query_id, chunk_id, c, CASE c WHEN 0 THEN v / (v + b + k) WHEN 1 THEN b / (v + b + k) WHEN 2 THEN k / (v + b + k) ELSE 0.05::DOUBLE END / (60 + rank) * CASE WHEN exact THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM own JOIN wt USING (query_id)),
fu AS (SELECT query_id, chunk_id, round(sum(s) * CASE WHEN count(DISTINCT c) >= 3 THEN 1.15::DOUBLE * 1.10::DOUBLE WHEN count(DISTINCT c) = 2 THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END, 10) AS score FROM sc GROUP BY query_id, chunk_id),
fused AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fu QUALIFY rank <= 15),
an AS (SELECT item_id AS query_id, unnest([0, 1, 2, 3]) AS place, unnest([3, item_id % 20, 1, 3]) AS rank, unnest([9.0::DOUBLE, CAST(item_id % 11 AS DOUBLE), 4.5::DOUBLE, 2.0::DOUBLE]) AS relevance FROM benchmark WHERE item_id % 7 <> 0),
gr AS (SELECT f.query_id, f.chunk_id, round(relevance / 10.0 * 0.70::DOUBLE + f.score * 30.0 * 0.30::DOUBLE, 10) AS score, place, rank FROM an JOIN fused f USING (query_id, rank) WHERE (SELECT count(*) FROM fused n WHERE n.query_id = f.query_id) > 1),
al AS (SELECT query_id, chunk_id, score, place, true AS told FROM gr UNION ALL SELECT query_id, chunk_id, score, 1000000 + rank, query_id % 7 <> 0 FROM fused f WHERE NOT EXISTS (SELECT 1 FROM gr WHERE gr.query_id = f.query_id AND gr.rank = f.rank)),
rr AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN told THEN score END DESC NULLS LAST, place) AS INTEGER) AS rank FROM al QUALIFY rank <= 6),
n AS (SELECT query_id, (SELECT count(*) FROM vc WHERE vc.query_id = i.query_id) AS vector, (SELECT count(*) FROM bm WHERE bm.query_id = i.query_id) AS bm25, (SELECT count(*) FROM kwd WHERE kwd.query_id = i.query_id) AS keyword, (SELECT count(*) FROM md WHERE md.query_id = i.query_id) AS metadata,
  (SELECT count(*) FROM fused WHERE fused.query_id = i.query_id) AS fused, (SELECT count(*) FROM rr WHERE rr.query_id = i.query_id) AS reranked FROM intent i)
SELECT query_id, rank, chunk_id, score, strategy, kw, sem, vector, bm25, keyword, metadata, fused, reranked FROM rr JOIN intent USING (query_id) JOIN n USING (query_id)"""


@query(SQL)
def retrieve_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with addresses, vendors or a quoted phrase, each by an owner, some with a list of files, most of one type; a model's grades by place, some of them unreadable. source = file."""
    k, c = F.col("query_id"), F.col("chunk_id")
    quoted = F.concat(F.lit('who wrote "'), F.array_join(F.slice(F.split("q", r"\s+"), 2, 3), " "), F.lit('"'))
    asked = F.when(k % 4 == 0, F.concat(F.lit("ERROR 500 at 10.0.0.1 and 10.0.0.2 "), "q")).when(k % 4 == 1, F.concat(F.lit("how to troubleshoot on kubernetes and aws "), "q")).when(k % 4 == 2, quoted).otherwise(F.col("q"))
    files = F.when(k % 5 == 0, F.array(*[F.lit(f"src{i}") for i in (0, 4, 8, 12, 16)]))
    qs = questions(spark, sf_dir).select("query_id", asked.alias("q"), F.when(k % 3 == 1, "de").otherwise("en").alias("asker"), files.alias("files"), F.when(k % 6 != 0, "kb").alias("file_type"))
    vendor = F.when(c % 5 == 0, "aws").when(c % 5 == 1, "kubernetes").otherwise("")
    ch = chunks(spark, sf_dir).select("chunk_id", "owner_id", F.col("source").alias("file_id"), F.when(c % 4 == 0, "log").otherwise("kb").alias("file_type"), F.when(c % 3 == 0, F.concat("content", F.lit(" seen at 10.0.0.1"))).otherwise(F.col("content")).alias("content"), F.to_json(F.struct(vendor.alias("vendor"))).alias("meta"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))
    blocks = knn.build(e.join(ch.select("chunk_id", "file_id"), "chunk_id"), 64, pivots=32)
    asks = qs.select("query_id", F.col("files").alias("only"), F.lit(None).cast("array<string>").alias("never")).join(e.withColumnRenamed("chunk_id", "query_id"), "query_id")
    body = F.format_string('[{"chunk": 3, "score": 9}, {"chunk": %s, "score": %s}, {"chunk": 1, "score": 4.5}, {"chunk": 3, "score": 2}]', (k % 20).cast("string"), (k % 11).cast("string"))
    answers = qs.select("query_id", F.when(k % 7 == 0, "sorry").otherwise(body).alias("raw"))
    ranked, counts = retrieve.retrieve_graded(qs, ch, knn.nearest(asks, blocks), answers)
    return ranked.drop("strategy").join(counts, "query_id").select("query_id", "rank", "chunk_id", "score", "strategy", "kw", "sem", "vector", "bm25", "keyword", "metadata", "fused", "reranked")
