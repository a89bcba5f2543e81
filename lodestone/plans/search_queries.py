"""Search, fusion, rerank and context queries over documents, embeddings and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import SETTINGS as S
from lodestone.config import STOP_GATE, STOP_INTENT
from lodestone.functions.text import terms, tokens, truncate
from lodestone.operators import context, fusion, rules, search
from lodestone.plans.registry import query
from lodestone.sources.tables import chunks, messages, questions, table
from lodestone.sources.versioned import settle

TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


def sql_list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


DOC_TOKENS = f"""
dt AS (SELECT doc_id, lang, unnest({TOKENS.format("text")}) AS token FROM documents),
dl AS (SELECT doc_id, count(*) AS dl FROM dt GROUP BY doc_id),
tf AS (SELECT doc_id, any_value(lang) AS lang, token, count(*) AS tf FROM dt GROUP BY doc_id, token),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
cs AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
qt AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS.format("text")}) AS token FROM benchmark) GROUP BY ALL)
"""
SCORES = """
SELECT query_id, tf.doc_id AS chunk_id, any_value(tf.lang) AS lang, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1)))), 6) AS score
FROM tf JOIN qt USING (token) JOIN df USING (token) JOIN dl ON dl.doc_id = tf.doc_id CROSS JOIN cs GROUP BY query_id, tf.doc_id
"""
RANK = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank"
BM25 = f"{DOC_TOKENS}, bs AS ({SCORES}), bm25 AS (SELECT * FROM (SELECT query_id, chunk_id, lang, score, {RANK} FROM bs WHERE score > 0) WHERE rank <= 20)"
COSINE = """
vq AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv, label AS qlabel FROM embeddings WHERE vec_id % 50 = 0),
vs AS (SELECT query_id, e.vec_id AS chunk_id, label, qlabel, round(1 - list_cosine_similarity(qv, CAST(embedding AS DOUBLE[])), 6) AS score,
  round(list_distance(qv, CAST(embedding AS DOUBLE[])), 6) AS l2 FROM vq CROSS JOIN embeddings e)
"""


@query(f"WITH {DOC_TOKENS} SELECT token, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM tf GROUP BY token")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.term_stats(chunks(spark, sf_dir))


@query(f"WITH {DOC_TOKENS} SELECT n, round(avgdl, 6) AS avgdl FROM cs")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.corpus_stats(chunks(spark, sf_dir)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {BM25} SELECT query_id, chunk_id, score, rank FROM bm25")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(questions(spark, sf_dir), chunks(spark, sf_dir))


@query(f"WITH {DOC_TOKENS}, bs AS ({SCORES}) SELECT * FROM (SELECT query_id, chunk_id, score, {RANK} FROM bs WHERE score > 0 AND lang = 'en') WHERE rank <= 20")
def bm25_file_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only one type is scored; the statistics stay global."""
    return search.bm25(questions(spark, sf_dir), chunks(spark, sf_dir), scored=F.col("owner_id") == "en")


@query(f"WITH {BM25} SELECT query_id, chunk_id, score, rank FROM bm25 WHERE lang = 'de'")
def bm25_owner_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner filter comes after the global top 20, so an owner may get fewer."""
    hits = search.bm25(questions(spark, sf_dir), chunks(spark, sf_dir))
    own = chunks(spark, sf_dir).where("owner_id = 'de'").select("chunk_id")
    return hits.join(own, "chunk_id", "left_semi").select("query_id", "chunk_id", "score", "rank")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"), F.col("label").alias("tag")), e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"), F.col("label").alias("tag"))


V_RANK = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS INTEGER) AS rank"


@query(f"WITH {COSINE} SELECT * FROM (SELECT query_id, chunk_id, score, {V_RANK} FROM vs) WHERE rank <= 25")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_search(*_vectors(spark, sf_dir))


@query(f"WITH {COSINE} SELECT * FROM (SELECT query_id, chunk_id, l2 AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY l2, chunk_id) AS INTEGER) AS rank FROM vs) WHERE rank <= 5")
def vector_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_search(*_vectors(spark, sf_dir), k=5, metric="l2")


@query(f"WITH {COSINE} SELECT * FROM (SELECT query_id, chunk_id, score, {V_RANK} FROM vs WHERE label = qlabel) WHERE rank <= 25")
def vector_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only vectors of the query's label are allowed."""
    return search.vector_search(*_vectors(spark, sf_dir), same=True)


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, term: the runs of four words of each question, every fourth word on."""
    words = F.filter(F.split(F.lower("q"), r"\s+"), lambda w: F.length(w) > 0)
    starts = F.filter(F.sequence(F.lit(1), F.size("w"), F.lit(4)), lambda i: i + 3 <= F.size("w"))
    return questions(spark, sf_dir).withColumn("w", words).select("query_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, 4), " "))).alias("term"))


PHRASES = r"""
qw AS (SELECT item_id AS query_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: length(w) > 0) AS w FROM benchmark),
ph AS (SELECT DISTINCT query_id, array_to_string(w[i:i+3], ' ') AS term FROM (SELECT query_id, w, unnest(range(1, len(w) - 2, 4)) AS i FROM qw))
"""


@query(f"WITH {PHRASES}, s AS (SELECT query_id, doc_id AS chunk_id, CAST(count(*) AS BIGINT) AS score FROM ph JOIN documents ON contains(lower(text), term) GROUP BY ALL) SELECT * FROM (SELECT query_id, chunk_id, score, {RANK} FROM s) WHERE rank <= 15")
def ilike_match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.substring_search(_phrases(spark, sf_dir), chunks(spark, sf_dir))


@query(f"""WITH h AS (SELECT DISTINCT item_id AS query_id, 'src' || (item_id % 20) AS hint FROM benchmark),
s AS (SELECT query_id, doc_id AS chunk_id, 1.0::DOUBLE AS score FROM h JOIN documents ON contains(lower(source), hint) OR contains(lower(lang), hint))
SELECT * FROM (SELECT query_id, chunk_id, score, {RANK} FROM s) WHERE rank <= 10""")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vendor = source, domain = language, as JSON."""
    meta = F.to_json(F.struct(F.col("source").alias("vendor"), F.col("owner_id").alias("domain")))
    hints = questions(spark, sf_dir).select("query_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")).alias("hint"))
    return search.metadata_search(hints, chunks(spark, sf_dir).withColumn("meta", meta))


@query(f"""WITH {PHRASES}, c AS (SELECT query_id, term, trim(regexp_replace(term, '[^a-zA-Z0-9._/-]', ' ', 'g')) AS t FROM ph),
p AS (SELECT query_id, term, CASE WHEN contains(t, ' ') THEN '(' || array_to_string(list_filter(string_split(t, ' '), lambda w: w <> ''), ' <-> ') || ')' ELSE t END AS part FROM c WHERE t <> '')
SELECT query_id, string_agg(part, ' | ' ORDER BY term) AS tsquery FROM p GROUP BY query_id""")
def tsquery_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms joined by "or", the words of a phrase by "followed by"."""
    t = F.trim(F.regexp_replace("term", r"[^a-zA-Z0-9._/-]", " "))
    words = F.filter(F.split("t", " "), lambda w: w != "")
    part = F.when(F.contains("t", F.lit(" ")), F.concat(F.lit("("), F.array_join(words, " <-> "), F.lit(")"))).otherwise(F.col("t"))
    parts = _phrases(spark, sf_dir).distinct().withColumn("t", t).where("t != ''").withColumn("part", part)
    ordered = F.array_sort(F.collect_list(F.struct("term", "part")))
    return parts.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda s: s["part"]), " | ").alias("tsquery"))


CONTENT = f"ct AS (SELECT DISTINCT query_id, token FROM qt WHERE length(token) > 2 AND NOT list_contains({sql_list(STOP_INTENT)}, token))"
FTS = f"""{CONTENT}, cn AS (SELECT query_id, count(*) AS terms FROM ct GROUP BY query_id),
fs AS (SELECT query_id, doc_id AS chunk_id, round(sum(0.1 * list_sum(list_transform(range(1, tf + 1), lambda j: 1.0::DOUBLE / (j * j))) / 1.64493) / any_value(terms), 6) AS score FROM tf JOIN ct USING (token) JOIN cn USING (query_id) GROUP BY query_id, doc_id),
fts AS (SELECT * FROM (SELECT query_id, chunk_id, score, {RANK} FROM fs WHERE score >= 0.01) WHERE rank <= 15)"""


def _content_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("query_id", F.explode(terms(F.col("q"), STOP_INTENT)).alias("term"))


@query(f"WITH {DOC_TOKENS}, {FTS} SELECT query_id, chunk_id, score, rank FROM fts")
def fts_or_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.full_text(_content_terms(spark, sf_dir), chunks(spark, sf_dir))


@query()
def fts_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By English stems (no SQL: DuckDB's stemmer is an extension that is not there; held against a loop in tests)."""
    asked = questions(spark, sf_dir).select("query_id", F.explode(F.array_distinct(tokens(F.col("q")))).alias("term"))
    return search.full_text(asked, chunks(spark, sf_dir), stems=True)


def _strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions take the three strategies in turn, so that each weight set is at work."""
    turn = F.col("query_id") % 3
    return questions(spark, sf_dir).select("query_id", F.when(turn == 0, "mixed").when(turn == 1, "keyword").otherwise("semantic").alias("strategy"))


@query("""WITH s AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'mixed' WHEN 1 THEN 'keyword' ELSE 'semantic' END AS strategy FROM benchmark),
w(strategy, v, b, k) AS (VALUES ('keyword', greatest(0.10::DOUBLE, 0.45::DOUBLE - 0.15::DOUBLE), 0.36::DOUBLE, 0.34::DOUBLE), ('semantic', 0.55::DOUBLE, 0.30::DOUBLE, greatest(0.05::DOUBLE, 0.25::DOUBLE - 0.10::DOUBLE)), ('mixed', 0.45::DOUBLE, 0.30::DOUBLE, 0.25::DOUBLE))
SELECT query_id, strategy, round(v / (v + b + k), 6) AS vector, round(b / (v + b + k), 6) AS bm25, round(k / (v + b + k), 6) AS keyword FROM s JOIN w USING (strategy)""")
def strategy_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of every question, by its strategy."""
    v, b, k = fusion.strategy_weights(F.col("strategy"))
    return _strategies(spark, sf_dir).select("query_id", "strategy", F.round(v, 6).alias("vector"), F.round(b, 6).alias("bm25"), F.round(k, 6).alias("keyword"))


def _doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector hits: question i asks with vector i, and vectors stand for the documents of their id."""
    e = table(spark, sf_dir, "embeddings")
    q = questions(spark, sf_dir).select("query_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"), F.col("label").alias("tag")), "query_id")
    return search.vector_search(q, e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"), F.col("label").alias("tag")))


DOC_VECTORS = f"""
ds AS (SELECT b.item_id AS query_id, e.vec_id AS chunk_id, round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN embeddings e),
vec AS (SELECT * FROM (SELECT query_id, chunk_id, score, {V_RANK} FROM ds) WHERE rank <= 25)"""


@query(f"""WITH {BM25}, {DOC_VECTORS}, u AS (SELECT query_id, chunk_id, 0.6::DOUBLE / (60 + rank) AS s FROM vec UNION ALL SELECT query_id, chunk_id, 0.4::DOUBLE / (60 + rank) FROM bm25),
f AS (SELECT query_id, chunk_id, round(sum(s), 10) AS score FROM u GROUP BY ALL) SELECT * FROM (SELECT query_id, chunk_id, score, {RANK} FROM f) WHERE rank <= 15""")
def rrf_two_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse_two(_doc_vectors(spark, sf_dir), search.bm25(questions(spark, sf_dir), chunks(spark, sf_dir)))


KEYWORDS = f"""
il AS (SELECT query_id, doc_id AS chunk_id, CAST(count(*) AS BIGINT) AS score FROM ph JOIN documents ON contains(lower(text), term) GROUP BY ALL),
likes AS (SELECT * FROM (SELECT query_id, chunk_id, score, {RANK} FROM il) WHERE rank <= 15),
kw AS (SELECT query_id, chunk_id, rank, false AS exact FROM fts UNION ALL SELECT query_id, chunk_id, rank, true FROM likes i WHERE NOT EXISTS (SELECT 1 FROM fts WHERE fts.query_id = i.query_id AND fts.chunk_id = i.chunk_id)),
hint AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS h FROM benchmark),
md AS (SELECT * FROM (SELECT query_id, doc_id AS chunk_id, 1.0::DOUBLE AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS INTEGER) AS rank FROM hint JOIN documents ON contains(lower(source), h) OR contains(lower(lang), h)) WHERE rank <= 10)"""
FUSED = f"""
sw AS (SELECT query_id, v / (v + b + k) AS v, b / (v + b + k) AS b, k / (v + b + k) AS k FROM (SELECT item_id AS query_id,
  CASE item_id % 3 WHEN 1 THEN 0.45::DOUBLE - 0.15::DOUBLE WHEN 2 THEN 0.55::DOUBLE ELSE 0.45::DOUBLE END AS v, CASE item_id % 3 WHEN 1 THEN 0.36::DOUBLE ELSE 0.30::DOUBLE END AS b,
  CASE item_id % 3 WHEN 1 THEN 0.34::DOUBLE WHEN 2 THEN 0.25::DOUBLE - 0.10::DOUBLE ELSE 0.25::DOUBLE END AS k FROM benchmark)),
al AS (SELECT query_id, chunk_id, v / (60 + rank) AS s, 0 AS c FROM vec JOIN sw USING (query_id) UNION ALL SELECT query_id, chunk_id, b / (60 + rank), 1 FROM bm25 JOIN sw USING (query_id)
  UNION ALL SELECT query_id, chunk_id, k / (60 + rank) * CASE WHEN exact THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END, 2 FROM kw JOIN sw USING (query_id) UNION ALL SELECT query_id, chunk_id, 0.05::DOUBLE / (60 + rank), 3 FROM md),
fu AS (SELECT query_id, chunk_id, count(DISTINCT c) AS channels, round(sum(s) * CASE WHEN count(DISTINCT c) >= 3 THEN 1.15::DOUBLE * 1.10::DOUBLE WHEN count(DISTINCT c) = 2 THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END, 10) AS score FROM al GROUP BY query_id, chunk_id),
fused AS (SELECT * FROM (SELECT query_id, chunk_id, score, channels, {RANK} FROM fu) WHERE rank <= 15)"""
EVERY = f"{BM25}, {PHRASES}, {FTS}, {DOC_VECTORS}, {KEYWORDS}, {FUSED}"


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    qs, ch = questions(spark, sf_dir), chunks(spark, sf_dir)
    fts = settle(search.full_text(_content_terms(spark, sf_dir), ch).select("query_id", "chunk_id", "rank"), "fts")  # read twice
    like = search.substring_search(_phrases(spark, sf_dir), ch).select("query_id", "chunk_id", "rank")
    extra = like.join(fts.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    keyword = fts.withColumn("exact", F.lit(False)).unionByName(extra.withColumn("exact", F.lit(True)))
    channels = {"vector": _doc_vectors(spark, sf_dir), "bm25": search.bm25(qs, ch), "keyword": keyword, "metadata": metadata_filter(spark, sf_dir)}
    return fusion.fuse(channels, _strategies(spark, sf_dir))


@query(f"WITH {EVERY} SELECT query_id, chunk_id, score, channels, rank FROM fused")
def rrf_four_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir)


def _graded(fused: DataFrame, qs: DataFrame, ch: DataFrame) -> DataFrame:
    """A stand-in for a model's 0 to 10 grades: the share of the question's terms in the text; every fifth pair is left ungraded."""
    pairs = fused.join(qs.select("query_id", terms(F.col("q"), STOP_GATE).alias("t")), "query_id", "left").join(ch.select("chunk_id", F.lower("content").alias("low")), "chunk_id", "left")
    share = F.size(F.filter("t", lambda w: F.contains("low", w))) / F.greatest(F.size("t"), F.lit(1))
    graded = F.when(F.col("low").isNotNull() & ((F.col("query_id") + F.col("chunk_id")) % 5 != 0), F.floor(share * 10).cast("double"))
    return pairs.select("query_id", "chunk_id", "score", graded.alias("relevance"))


RELEVANCE = f"""
gt AS (SELECT item_id AS query_id, list_filter(list_distinct({TOKENS.format("text")}), lambda w: length(w) > 2 AND NOT list_contains({sql_list(STOP_GATE)}, w)) AS t FROM benchmark),
rel AS (SELECT f.query_id, f.chunk_id, CASE WHEN (f.query_id + f.chunk_id) % 5 <> 0 THEN CAST(floor(CAST(len(list_filter(t, lambda w: contains(lower(d.text), w))) AS DOUBLE) / greatest(len(t), 1) * 10) AS DOUBLE) END AS relevance
  FROM fused f JOIN gt USING (query_id) JOIN documents d ON d.doc_id = f.chunk_id),
rr0 AS (SELECT f.query_id, f.chunk_id, f.score AS fusion, relevance, round(CASE WHEN count(*) OVER (PARTITION BY f.query_id) > 1 AND relevance IS NOT NULL THEN relevance / 10.0 * 0.70::DOUBLE + f.score * 30.0 * 0.30::DOUBLE ELSE f.score END, 10) AS score FROM fused f LEFT JOIN rel USING (query_id, chunk_id)),
reranked AS (SELECT * FROM (SELECT query_id, chunk_id, fusion, relevance, score, {RANK} FROM rr0) WHERE rank <= 6)"""


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rerank_graded(_graded(_fused(spark, sf_dir), questions(spark, sf_dir), chunks(spark, sf_dir)))


@query(f"WITH {EVERY}, {RELEVANCE} SELECT query_id, chunk_id, fusion, relevance, score, rank FROM reranked")
def rerank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir)


BY_PLACE = """
an AS (SELECT item_id AS query_id, unnest([0, 1, 2, 3, 4]) AS place, unnest([2, item_id % 20, 0, 1, 2]) AS rank, unnest([9.0::DOUBLE, CAST(item_id % 11 AS DOUBLE), 10.0::DOUBLE, 4.5::DOUBLE, 3.0::DOUBLE]) AS relevance FROM benchmark WHERE item_id % 7 <> 0),
gr AS (SELECT f.query_id, f.chunk_id, round(relevance / 10.0 * 0.70::DOUBLE + f.score * 30.0 * 0.30::DOUBLE, 10) AS score, place, rank, true AS told FROM an JOIN fused f USING (query_id, rank) WHERE (SELECT count(*) FROM fused n WHERE n.query_id = f.query_id) > 1),
al2 AS (SELECT query_id, chunk_id, score, place, told FROM gr UNION ALL SELECT query_id, chunk_id, score, 1000000 + rank, query_id % 7 <> 0 FROM fused f WHERE NOT EXISTS (SELECT 1 FROM gr WHERE gr.query_id = f.query_id AND gr.rank = f.rank))"""


@query(f"WITH {EVERY}, {BY_PLACE} SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN told THEN score END DESC NULLS LAST, place) AS INTEGER) AS rank FROM al2 QUALIFY rank <= 6")
def rerank_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's grades by number: one out of range, one twice, some below; every seventh answer cannot be read."""
    k = F.col("query_id")
    body = F.format_string('Grades: [{"chunk": 2, "score": 9}, {"chunk": %s, "score": %s}, {"score": 10}, {"chunk": 1, "score": 4.5}, {"chunk": 2, "score": 3}]', (k % 20).cast("string"), (k % 11).cast("string"))
    answers = questions(spark, sf_dir).select("query_id", F.when(k % 7 == 0, "no list").otherwise(body).alias("raw"))
    return fusion.rerank_by_place(settle(_fused(spark, sf_dir), "fused"), answers)


@query(f"WITH {EVERY} SELECT query_id, chunk_id, score, rank FROM fused WHERE rank <= 6")
def rerank_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rerank_none(_fused(spark, sf_dir)).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {EVERY}, {RELEVANCE} SELECT query_id, rank, chunk_id, d.source AS source, score FROM reranked r LEFT JOIN documents d ON d.doc_id = r.chunk_id")
def retrieve_e2e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to ranked chunks: four channels, fusion, rerank; texts and sources are joined after the top k."""
    return _reranked(spark, sf_dir).join(chunks(spark, sf_dir).select("chunk_id", "source"), "chunk_id", "left").select("query_id", "rank", "chunk_id", "source", "score")


def _with_text(ranked: DataFrame, ch: DataFrame) -> DataFrame:
    return ranked.select("query_id", "chunk_id", "rank", "score").join(ch.select("chunk_id", "source", "content"), "chunk_id")


CUT = "CASE WHEN length({t}) <= {n} THEN {t} WHEN contains(left({t}, {n}), chr(10)) AND length(left({t}, {n})) - strpos(reverse(left({t}, {n})), chr(10)) > {n} * 0.7 THEN left({t}, length(left({t}, {n})) - strpos(reverse(left({t}, {n})), chr(10))) || chr(10) || '[... truncated ...]' ELSE left({t}, {n}) || chr(10) || '[... truncated ...]' END"
PACK = f"""
pk AS (SELECT query_id, rank, chunk_id, coalesce(source, 'unknown') AS source, score, '[Source: ' || coalesce(source, 'unknown') || ']' || chr(10) AS head, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body0 FROM bm25 JOIN documents d ON d.doc_id = bm25.chunk_id WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0),
pb AS (SELECT *, {CUT.format(t="body0", n="6000")} AS body FROM pk),
pc AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY query_id ORDER BY rank) AS total, length(head) + length(body) AS c FROM pb),
pd AS (SELECT *, sum(CASE WHEN total > 12000 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS overs, 12000 - (total - c) AS remaining FROM pc),
packed AS (SELECT query_id, rank, chunk_id, source, score, overs > 0 AS cut, CASE WHEN overs = 0 THEN head || body ELSE head || ({CUT.format(t="body", n="CAST(remaining - 60 AS BIGINT)")}) END AS entry FROM pd WHERE overs = 0 OR (overs = 1 AND remaining > 300))"""


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch = chunks(spark, sf_dir)
    return context.pack_context(_with_text(search.bm25(questions(spark, sf_dir), ch), ch), budget=12_000)


@query(f"WITH {BM25}, {PACK} SELECT query_id, rank, chunk_id, source, score, entry, CAST(length(entry) AS BIGINT) AS chars, cut FROM packed")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


@query(f"""WITH {BM25}, {PACK}, p AS (SELECT query_id, source, round(sum(score), 6) AS score FROM packed GROUP BY ALL), m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM p)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source) AS INTEGER) AS place, source, score FROM m WHERE score >= best * 0.40::DOUBLE) WHERE place <= 5""")
def source_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.source_share(_packed(spark, sf_dir))


@query(f"""WITH {EVERY}, {RELEVANCE}, h AS (SELECT r.query_id, lower(string_agg(coalesce(d.text, ''), ' ' ORDER BY rank)) AS t3, max(CASE WHEN rank = 1 THEN score END) AS top_score FROM reranked r JOIN documents d ON d.doc_id = r.chunk_id WHERE rank <= 3 GROUP BY r.query_id),
g AS (SELECT gt.query_id, t, coalesce(top_score, 0.0::DOUBLE) AS top_score, top_score IS NOT NULL AND top_score >= 0.18 AS high, CASE WHEN t3 IS NULL THEN 0 ELSE len(list_filter(t, lambda w: contains(t3, w))) END AS hits FROM gt LEFT JOIN h USING (query_id))
SELECT query_id, top_score, CAST(hits AS BIGINT) AS hits, high AND (len(t) = 0 OR hits >= 1) AS supported FROM g""")
def support_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.support_gate(questions(spark, sf_dir), _with_text(_reranked(spark, sf_dir), chunks(spark, sf_dir)))


@query(f"SELECT doc_id, {CUT.format(t='text', n='1000')} AS text FROM documents")
def truncate_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", truncate(F.col("text"), F.lit(1000)).alias("text"))


@query("""WITH r AS (SELECT conv_id, turn, role, upper(left(role, 1)) || lower(substr(role, 2)) || ': ' || left(coalesce(text, ''), 500) AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
t AS (SELECT *, sum(length(line)) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM r WHERE back <= 4)
SELECT conv_id AS session_id, turn, role, line, CAST(total AS BIGINT) AS total FROM t WHERE total <= 2000""")
def session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.session_history(messages(spark, sf_dir))


@query(f"WITH {BM25} SELECT query_id, CAST(count(*) AS BIGINT) AS hits, round(least(0.3::DOUBLE + count(*) * 0.1::DOUBLE, 1.0::DOUBLE), 6) AS confidence FROM bm25 GROUP BY query_id")
def retrieval_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.bm25(questions(spark, sf_dir), chunks(spark, sf_dir)).groupBy("query_id").agg(F.count("*").alias("hits"))
    return hits.select("query_id", "hits", F.round(context.retrieval_confidence(F.col("hits")), 6).alias("confidence"))
