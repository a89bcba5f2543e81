"""Queries of the service's smaller operators. Their SQL takes patterns, word lists and labels from the same fixed values as the operators; goldens in tests hold those."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as fn
from lodestone.operators import context, parse, retrieve, rules, search, store
from lodestone.plans import parse_queries, rule_queries, search_queries, store_queries
from lodestone.plans.registry import query
from lodestone.sources.tables import chunks, messages, page_lines, questions, table


def _by_id(k, *values):
    """values[i] where k = i; the last one otherwise."""
    out = F.when(k == 0, values[0])
    for i, v in enumerate(values[1:-1], 1):
        out = out.when(k == i, v)
    return out.otherwise(values[-1])


@query("WITH r AS (SELECT item_id AS query_id, CASE item_id % 5 WHEN 0 THEN ' ' || chr(9) || chr(10) WHEN 1 THEN chr(10) || ' ' || text || ' ' || chr(9) WHEN 2 THEN repeat(text || ' ', 8) WHEN 3 THEN '' ELSE text END AS q FROM benchmark) SELECT query_id, regexp_replace(q, '^[[:space:]]+|[[:space:]]+$', '', 'g') AS q FROM r WHERE length(q) BETWEEN 1 AND 1000 AND length(regexp_replace(q, '^[[:space:]]+|[[:space:]]+$', '', 'g')) > 0")
def valid_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions made blank, padded, long or empty by their id."""
    q = _by_id(F.col("query_id") % 5, F.lit(" \t\n"), F.concat(F.lit("\n "), "q", F.lit(" \t")), F.repeat(F.concat("q", F.lit(" ")), F.lit(8)), F.lit(""), F.col("q"))
    return store.valid_questions(questions(spark, sf_dir).withColumn("q", q))


@query("SELECT doc_id, kind, coalesce(t, '') AS text FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'like' WHEN 1 THEN 'dislike' ELSE 'none' END AS kind, CASE WHEN doc_id % 4 <> 0 THEN repeat('x', CAST(doc_id * 7 % 2000 AS INTEGER)) END AS t FROM labels) WHERE kind IN ('like', 'dislike') AND length(coalesce(t, '')) <= 1200")
def valid_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    df = table(spark, sf_dir, "labels").select("doc_id", _by_id(k % 3, F.lit("like"), F.lit("dislike"), F.lit("none")).alias("kind"), F.when(k % 4 != 0, F.repeat(F.lit("x"), (k * 7 % 2000).cast("int"))).alias("text"))
    return store.valid_feedback(df)


@query("SELECT o_orderkey AS job_id, o_totalprice AS price FROM orders WHERE CASE o_orderkey % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'F' ELSE 'anonymous' END = coalesce(nullif(o_orderstatus, 'P'), 'anonymous')")
def tenant_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders = jobs, status = owner (P: none); a job that belongs to another is not seen."""
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.nullif("o_orderstatus", F.lit("P")).alias("owner_id"), F.col("o_totalprice").alias("price"))
    asked = jobs.select("job_id", _by_id(F.col("job_id") % 3, F.lit("O"), F.lit("F"), F.lit("anonymous")).alias("asker"))
    return store.owned(jobs, asked, "job_id").select("job_id", "price")


@query(f"WITH {search_queries.BM25} SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank FROM bm25 WHERE lang = 'de'")
def rank_after_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks count the hits that are left after the owner filter."""
    return search.top_ranked(search_queries.bm25_owner_after(spark, sf_dir).drop("rank"), None).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH f AS ({store_queries.ORACLE_LIST_FILES}) SELECT id, name, status, updated, CAST(row_number() OVER (ORDER BY updated DESC NULLS LAST, CAST(id AS BIGINT)) AS INTEGER) AS place FROM f ORDER BY place LIMIT 100")
def list_files_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of the listing: the 100 files changed last."""
    first = store_queries.list_files(spark, sf_dir).withColumn("n", F.col("id").cast("long")).orderBy(F.col("updated").desc_nulls_last(), "n").limit(100)
    return _placed(first, F.col("updated").desc_nulls_last(), F.col("n")).select("id", "name", "status", "updated", "place")


def _placed(page: DataFrame, *order) -> DataFrame:
    """place from 1 over the rows of one page."""
    return page.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


@query("SELECT session_id, last_turn, CAST(row_number() OVER (ORDER BY last_turn DESC, session_id) AS INTEGER) AS place FROM (SELECT conv_id AS session_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id) ORDER BY place LIMIT 50")
def list_sessions_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of the listing: the 50 sessions touched last."""
    first = messages(spark, sf_dir).groupBy("session_id").agg(F.max("turn").alias("last_turn")).orderBy(F.desc("last_turn"), "session_id").limit(50)
    return _placed(first, F.desc("last_turn"), F.col("session_id"))


@query(f"""WITH {rule_queries.SCORE}, s AS (SELECT query_id, [{{'v': round(least(1.0::DOUBLE, {rule_queries._hits('t', rules.STEP_PATTERNS)} * 0.4::DOUBLE), 6), 'n': 'multi_step', 'i': 0}}, {{'v': round(least(1.0::DOUBLE, {rule_queries._hits('t', rules.REASONING_PATTERNS)} * 0.35::DOUBLE), 6), 'n': 'reasoning', 'i': 1}},
 {{'v': round(least(1.0::DOUBLE, chars / 20000.0::DOUBLE), 6), 'n': 'context_size', 'i': 2}}, {{'v': round(greatest(0.0::DOUBLE, 1.0::DOUBLE - rc), 6), 'n': 'low_confidence', 'i': 3}}, {{'v': round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (sources - 1) * 0.3::DOUBLE)), 6), 'n': 'multi_doc', 'i': 4}}] AS l FROM x0),
u AS (SELECT query_id, unnest(l) AS e FROM s), r AS (SELECT query_id, e, row_number() OVER (PARTITION BY query_id ORDER BY e.v DESC, e.i) AS k FROM u)
SELECT query_id, coalesce(string_agg(e.n || '=' || printf('%.2f', e.v), ', ' ORDER BY k) FILTER (WHERE k <= 3 AND e.v > 0), '') AS top FROM r GROUP BY query_id""")
def complexity_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an id: the ids of turns reach those of pages when there are 10,000 sessions, and rows of one id are told together."""
    return rules.top_signals_by(rule_queries._complexity(spark, sf_dir), "query_id", rules.signals(F.col("q"), F.col("rc"), F.col("sources"), F.col("chars")))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_trunc('second', ts) = ts THEN '' ELSE strftime(ts, '.%f') END AS at FROM events")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", fn.isoformat(F.col("ts")).alias("at"))


@query("SELECT page_id, replace(url_encode(url || ' é*~+'), '%2F', '/') AS quoted FROM pages")
def quoted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", fn.quote_url(F.concat("url", F.lit(" é*~+"))).alias("quoted"))


@query("""WITH r AS (SELECT doc_id, doc_id % 6 AS k, quality + 3 AS s FROM labels) SELECT doc_id, CASE WHEN k < 4 THEN 2 ELSE 0 END AS n, CASE WHEN k < 4 THEN CAST(s AS DOUBLE) ELSE -1.0::DOUBLE END AS first_score FROM r""")
def model_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answers: bare, fenced, with words around; without a list, or with its brackets the wrong way round."""
    body = F.format_string('[{"chunk":1,"score":%s},{"chunk":2,"score":8.5}]', (F.col("quality") + 3).cast("string"))
    raw = _by_id(F.col("doc_id") % 6, body, F.concat(F.lit("```json\n"), body, F.lit("\n```")), F.concat(F.lit("Sure:\n```\n"), body, F.lit("\n``` done")), F.concat(F.lit("Scores: "), body, F.lit(" as asked")), F.lit("no list"), F.lit("] wrong ["))
    g = fn.grades(raw)
    return table(spark, sf_dir, "labels").select("doc_id", F.when(g.isNotNull(), F.size(g)).otherwise(0).alias("n"), F.coalesce(F.get(g, F.lit(0))["score"], F.lit(-1.0)).alias("first_score"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN 'none' WHEN 4 THEN '{"open": {"n": ' || doc_id ELSE '{"n": ' || doc_id || ', "s": "} \\" {", "o": {}}' END AS found FROM labels""")
def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.format_string('{"n": %s, "s": "} \\" {", "o": {}}', F.col("doc_id").cast("string"))
    raw = _by_id(F.col("doc_id") % 5, body, F.concat(F.lit("```json\n"), body, F.lit("\n```")), F.concat(F.lit("Here: "), body, F.lit(" and {more}")), F.lit(" none "), F.format_string('x {"open": {"n": %s', F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "labels").select("doc_id", fn.json_object(raw).alias("found"))


@query("""WITH r AS (SELECT doc_id, doc_id % 6 AS k, CASE WHEN quality = 0 THEN 'max_tokens' ELSE 'end_turn' END AS stop FROM labels)
SELECT doc_id, CASE k WHEN 0 THEN '{"n": ' || doc_id || '}' WHEN 1 THEN CASE WHEN stop <> 'max_tokens' THEN '{"open": {"n": ' || doc_id || '}}' END WHEN 2 THEN NULL
  WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE '{"a": "x} y"}' END AS mended FROM r""")
def json_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that are whole, cut off inside an object, cut off after a string with a brace (braces are counted plainly, so it stays invalid), cut off inside a string, without an object, and with words after it; quality 0 = cut off at the most tokens."""
    n = F.col("doc_id").cast("string")
    raw = _by_id(F.col("doc_id") % 6, F.format_string('Here: {"n": %s} end', n), F.format_string('{"open": {"n": %s', n), F.lit('{"a": "b", "l": {"x": "}"'), F.lit('{"a": "x} y'), F.lit(" none "), F.lit('```json\n{"a": "x} y"} {"b": 1}\n```'))
    stop = F.when(F.col("quality") == 0, "max_tokens").otherwise("end_turn")
    return table(spark, sf_dir, "labels").select("doc_id", fn.json_repaired(raw, stop).alias("mended"))


@query("SELECT p_partkey AS id, p_brand || '/X|' || p_type || '/X|' || p_brand || '/Y' AS entities FROM part")
def distinct_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies that differ in case, blanks or the label's case go; an entity without text goes."""
    e = lambda t, lab: F.struct(t.alias("text"), F.lit(lab).alias("label"))
    b = F.col("p_brand")
    items = F.array(e(b, "x"), e(F.upper(b), "X"), e(F.concat(F.lit("  "), b, F.lit(" ")), "x"), e(F.col("p_type"), "x"), e(F.lit("  "), "x"), e(b, "y"), e(F.lower("p_type"), "X"))
    joined = F.array_join(F.transform(fn.distinct_entities(items), lambda x: F.concat(x["text"], F.lit("/"), x["label"])), "|")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), joined.alias("entities"))


SUB = "(?i)^(?:Alert Signatures|Severity|Incident Summary|Probable Causes|Corrective Actions|Diagnostic Steps|Resolution Steps|Validation Steps|Validation / Post.Check|Post-Check|Escalation Criteria|Commands / Tools|Commands|Expected Results|Root Cause|Workaround|Affected Systems|Impact Assessment|Pre-Conditions|Post-Conditions|Notes|Warning)\\s*:?\\s*$"
STYLED = f"""{parse_queries.PAGE_LINES}, s0 AS (SELECT doc_id, line_no, CASE line_no % 7 WHEN 3 THEN 'Heading 2' WHEN 5 THEN NULL ELSE 'Normal' END AS style, CASE line_no % 5 WHEN 0 THEN 'Severity:' WHEN 1 THEN '• ' || line ELSE line END AS line FROM page_lines),
s1 AS (SELECT *, {parse_queries.STRIP.format("line")} AS t FROM s0)"""


@query(f"""WITH {STYLED} SELECT doc_id, line_no, CASE WHEN style = 'Heading 2' OR {parse_queries._CONTENT} THEN 'heading' WHEN regexp_matches(t, '{SUB}') THEN 'sub_heading' WHEN regexp_matches(t, '^[-*•]') THEN 'bullet' WHEN regexp_matches(t, {parse_queries._lit(parse.CODE)}) THEN 'code' ELSE 'paragraph' END AS type
FROM s1 WHERE t <> '' AND (style = 'Heading 2' OR {parse_queries._CONTENT} OR NOT regexp_matches(t, '^[-=*]{{5,}}$'))""")
def styled_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page lines as the paragraphs of a styled document."""
    n = F.col("line_no")
    style = F.when(n % 7 == 3, "Heading 2").when(n % 7 != 5, "Normal")
    line = _by_id(n % 5, F.lit("Severity:"), F.concat(F.lit("• "), "line"), F.col("line"))
    return page_lines(spark, sf_dir).select("doc_id", "line_no", parse.styled_type(style, line).alias("type")).where("type is not null")


PROPOSED = f"""{parse_queries.PARSED}, found AS (SELECT doc_id, '  ' || text AS heading FROM blocks WHERE type = 'paragraph' AND block_no % 3 = 1 UNION ALL SELECT doc_id, 'not in the text' FROM blocks WHERE block_no = 0 UNION ALL SELECT doc_id, left(text, 3) FROM blocks WHERE block_no = 1),
whole AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY block_no) AS text FROM blocks GROUP BY doc_id),
known AS (SELECT DISTINCT f.doc_id, trim(heading, ' ') AS heading FROM found f JOIN whole w USING (doc_id) WHERE length(trim(heading, ' ')) > 3 AND contains(lower(w.text), lower(trim(heading, ' '))))"""


def _known(b: DataFrame) -> DataFrame:
    proposed = b.where("type = 'paragraph' and block_no % 3 = 1").select("doc_id", F.concat(F.lit("  "), "text").alias("heading"))
    proposed = proposed.unionByName(b.where("block_no = 0").select("doc_id", F.lit("not in the text").alias("heading"))).unionByName(b.where("block_no = 1").select("doc_id", F.substring("text", 1, 3).alias("heading")))
    texts = b.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda s: s["text"]), "\n").alias("text"))
    return parse.known_headings(proposed, texts)


@query(f"WITH {PROPOSED} SELECT doc_id, heading FROM known")
def known_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals: every third paragraph, something that is not there, and three letters."""
    return _known(parse.blocks(page_lines(spark, sf_dir)))


@query(f"""WITH {PROPOSED}, r0 AS (SELECT b.*, b.type = 'paragraph' AND EXISTS (SELECT 1 FROM known k WHERE k.doc_id = b.doc_id AND lower(trim(k.heading, ' ')) = lower(trim(b.text, ' '))) AS new FROM blocks b),
r1 AS (SELECT doc_id, block_no, CASE WHEN new THEN 'heading' ELSE type END AS type, CASE WHEN new THEN trim(text, ' ') ELSE text END AS text, heading, CASE WHEN new THEN trim(text, ' ') WHEN type = 'heading' THEN coalesce(heading, text) END AS own FROM r0)
SELECT doc_id, block_no, type, text, CASE WHEN own IS NOT NULL THEN own ELSE coalesce(heading, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS heading FROM r1""")
def retagged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = parse.blocks(page_lines(spark, sf_dir))
    return parse.retag(b, _known(b))


META = f"""{parse_queries.PARSED}, {parse_queries.CHUNKS},
ms AS (SELECT doc_id, chunk_no, 'doc ' || doc_id || CASE WHEN doc_id % 3 = 0 THEN ' runbook.md' ELSE '.pdf' END AS name, heading, section, chunk_type,
  CASE WHEN chunk_no % 2 = 0 THEN '  Acme   Corp ' END AS iv, CASE WHEN chunk_no % 3 = 0 THEN 'custom_chunk' END AS ic, CASE WHEN chunk_no % 2 = 1 THEN '2024-0' || (1 + doc_id % 9) END AS idate,
  CASE WHEN doc_id % 2 = 0 THEN 'Globex' END AS dv, CASE WHEN doc_id % 4 = 0 THEN 'SOP' END AS dt, CASE WHEN doc_id % 5 = 0 THEN '2020' END AS dd FROM section_chunks),
meta AS (SELECT doc_id, chunk_no, heading, coalesce(ic, chunk_type) AS chunk_type, coalesce(dt, CASE WHEN contains(lower(name || ' ' || coalesce(heading, '')), 'runbook') THEN 'Runbook' WHEN contains(lower(name || ' ' || coalesce(heading, '')), 'sop') OR contains(lower(name || ' ' || coalesce(heading, '')), 'standard operating procedure') THEN 'SOP'
  WHEN contains(lower(name || ' ' || coalesce(heading, '')), 'kb') OR contains(lower(name || ' ' || coalesce(heading, '')), 'knowledge base') THEN 'KB' WHEN contains(lower(name || ' ' || coalesce(heading, '')), 'vendor') THEN 'Vendor doc' ELSE 'Unknown' END) AS document_type,
  coalesce(CASE WHEN iv IS NOT NULL THEN 'Acme Corp' END, dv) AS vendor, coalesce(idate || '-01', dd || '-01-01') AS date, section AS operational_context, name AS title FROM ms)"""


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model says is made from the ids, with gaps on every level."""
    k, n = F.col("doc_id"), F.col("chunk_no")
    c = parse_queries.section_chunks(spark, sf_dir)
    c = c.withColumn("name", F.concat(F.lit("doc "), k.cast("string"), F.when(k % 3 == 0, " runbook.md").otherwise(".pdf")))
    none = F.lit(None).cast("string")
    item = F.struct(F.when(n % 2 == 0, "  Acme   Corp ").alias("vendor"), F.when(n % 3 == 0, "custom_chunk").alias("chunk_type"), F.when(n % 2 == 1, F.concat(F.lit("2024-0"), (k % 9 + 1).cast("string"))).alias("date"), *[none.alias(f) for f in ("section", "document_type", "product", "domain", "version", "operational_context")])
    doc = F.struct(F.when(k % 2 == 0, "Globex").alias("vendor"), F.when(k % 4 == 0, "SOP").alias("document_type"), F.when(k % 5 == 0, "2020").alias("document_date"), *[none.alias(f) for f in ("product", "domain", "version", "title")])
    return parse.chunk_metadata(c, c.select("doc_id", "chunk_no", item.alias("item"), doc.alias("doc")))


@query(f"WITH {META} SELECT doc_id, chunk_no, heading, chunk_type, document_type, vendor, date, operational_context, title FROM meta")
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metadata(spark, sf_dir).select("doc_id", "chunk_no", "heading", "chunk_type", "document_type", "vendor", "date", "operational_context", "title")


@query(f"WITH {META} SELECT doc_id, arg_min(vendor, chunk_no) FILTER (WHERE vendor IS NOT NULL) AS vendor, arg_min(date, chunk_no) FILTER (WHERE date IS NOT NULL) AS date FROM meta GROUP BY doc_id")
def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.document_metadata(_metadata(spark, sf_dir)).select("doc_id", "vendor", "date")


@query(f"""WITH {search_queries.BM25}, t AS (SELECT query_id, chunk_id % 4 AS v, chunk_id % 3 AS p FROM bm25 WHERE rank <= 5),
g AS (SELECT query_id, list_sort(list_distinct(list(CASE WHEN v > 0 THEN 'v' || v END) FILTER (WHERE v > 0))) AS vs, list_sort(list_distinct(list('p' || p) FILTER (WHERE p > 0))) AS ps FROM t GROUP BY query_id)
SELECT query_id, CASE WHEN coalesce(len(vs), 0) + coalesce(len(ps), 0) > 0 THEN 'DOCUMENT CONTEXT HINTS:' || chr(10) || '  ' || concat_ws(chr(10) || '  ', CASE WHEN len(vs) > 0 THEN 'Vendors: ' || array_to_string(vs, ', ') END, CASE WHEN len(ps) > 0 THEN 'Products: ' || array_to_string(ps, ', ') END) END AS hints FROM g""")
def hint_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors and products of the first five chunks, made from their ids."""
    c = F.col("chunk_id")
    named = search_queries.bm25_topk(spark, sf_dir).select("query_id", "rank", F.when(c % 4 > 0, F.concat(F.lit("v"), (c % 4).cast("string"))).alias("vendor"), F.when(c % 3 > 0, F.concat(F.lit("p"), (c % 3).cast("string"))).alias("product"), F.lit("").alias("domain"))
    return context.hint_block(named)


@query("""WITH c AS (SELECT item_id AS query_id, text, (item_id % 11) / 10.0::DOUBLE AS rc FROM benchmark)
SELECT query_id, concat_ws(chr(10) || chr(10), 'Answer from the documents.', CASE WHEN query_id % 2 = 0 THEN 'RECENT CONVERSATION' END, 'RETRIEVAL CONFIDENCE: ' || CASE WHEN rc >= 0.7 THEN 'HIGH' WHEN rc >= 0.4 THEN 'MODERATE' ELSE 'LOW' END, 'USER QUESTION: ' || text) AS prompt FROM c""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a prompt, of which the history is missing or blank for odd questions."""
    k = F.col("query_id")
    parts = (F.lit("Answer from the documents."), F.when(k % 2 == 0, "RECENT CONVERSATION").otherwise(""), F.concat(F.lit("RETRIEVAL CONFIDENCE: "), context.confidence_level((k % 11) / 10.0)), F.concat(F.lit("USER QUESTION: "), "q"))
    return questions(spark, sf_dir).select("query_id", context.prompt(*parts).alias("prompt"))


@query(f"WITH {rule_queries.SCORE} SELECT query_id, CASE WHEN query_id % 2 = 0 THEN 'haiku' WHEN tier = 'complex' THEN 'sonnet' ELSE 'haiku' END AS model, CASE WHEN query_id % 3 = 0 THEN 'disabled' WHEN tier <> 'complex' THEN 'tier' ELSE 'later' END AS gate FROM cx")
def routing_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing and agents are switched off for some questions."""
    df = rule_queries._complexity(spark, sf_dir)
    gate = rules.agent_gate(F.col("q"), F.col("score"), F.col("tier"), F.col("sources"), F.col("query_id") % 3 != 0)
    return df.select("query_id", rules.model_for(F.col("tier"), F.col("query_id") % 2 != 0).alias("model"), F.when(gate.isin("disabled", "tier"), gate).otherwise("later").alias("gate"))


@query("SELECT conv_id AS run_id, turn AS seq, coalesce(sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 8000 AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 4 AS ran FROM conversations")
def agent_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as steps: at most four run."""
    steps = messages(spark, sf_dir).select(F.col("session_id").alias("run_id"), F.col("turn").alias("seq"), F.floor(F.length("content") / 4).cast("long").alias("tokens"))
    return rules.token_budget(steps, most=rules.S.agent_steps).select("run_id", "seq", "ran")


def _sessions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions are there already but for every fourth; turns from 2 on are new."""
    k = F.col("session_id")
    m = messages(spark, sf_dir).withColumn("owner_id", _by_id(k % 3, F.lit("a"), F.lit("b"), F.lit("c"))).withColumn("at", k * 100 + F.col("turn"))
    old = m.where((F.col("turn") < 2) & (k % 4 != 0))
    sessions = old.groupBy("session_id", "owner_id").agg(F.lit("old").alias("title"), F.max("at").alias("updated_at"))
    return sessions, old, m.where((F.col("turn") >= 2) | (k % 4 == 0))


SESSIONS = """m AS (SELECT *, CASE conv_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS owner_id, conv_id * 100 + turn AS at FROM conversations),
o AS (SELECT * FROM m WHERE turn < 2 AND conv_id % 4 <> 0), n AS (SELECT * FROM m WHERE turn >= 2 OR conv_id % 4 = 0)"""


@query(f"""WITH {SESSIONS} SELECT m.conv_id AS session_id, any_value(m.owner_id) AS owner_id, CASE WHEN count(*) FILTER (WHERE m.turn < 2 AND m.conv_id % 4 <> 0) > 0 THEN 'old'
ELSE arg_min(CASE WHEN length(m.text) > 60 THEN left(m.text, 60) || '...' ELSE m.text END, m.turn) END AS title, max(m.at) AS updated_at FROM m GROUP BY m.conv_id""")
def append_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions, old, new = _sessions(spark, sf_dir)
    return store.append_messages(sessions, old, new)[0]


@query(f"WITH {SESSIONS} SELECT conv_id AS session_id, turn FROM m WHERE NOT (owner_id = 'b' OR (owner_id = 'a' AND conv_id % 5 = 0))")
def delete_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sessions of b, and every fifth one that a asks for; what is not a's own stays."""
    sessions, old, new = _sessions(spark, sf_dir)
    every = old.unionByName(new)
    own = every.select("session_id", "owner_id").distinct()
    gone = own.where("session_id % 5 = 0").select("session_id", F.lit("a").alias("owner_id")).unionByName(spark.createDataFrame([(None, "b")], "session_id long, owner_id string"))
    return store.delete_sessions(gone, own, messages=every)["messages"].select("session_id", "turn")


@query("SELECT l_orderkey AS document_id, l_partkey AS version_id, CAST(count(*) AS BIGINT) AS chunks FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 40) GROUP BY ALL")
def purge_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the chunks of `orphan_anti` after the purge."""
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("version_id"))
    d = table(spark, sf_dir, "orders").where("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("document_id"))
    v = table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("version_id"))
    return store.purge_orphans(c, d, v).groupBy("document_id", "version_id").agg(F.count("*").alias("chunks"))


@query("SELECT lang AS owner_id, source FROM documents UNION SELECT lang, 'src' || (doc_id % 7) FROM documents")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return store.union_distinct(d.select(F.col("lang").alias("owner_id"), "source"), d.select(F.col("lang").alias("owner_id"), F.concat(F.lit("src"), (F.col("doc_id") % 7).cast("string")).alias("source")))


@query(r"""WITH k AS (SELECT doc_id, source, CASE WHEN source = 'src2' THEN text || ' again' ELSE text END AS text FROM documents WHERE source <> 'src1'), t AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ts FROM k), u AS (SELECT doc_id, source, len(ts) AS dl, unnest(ts) AS token FROM t)
SELECT token, CAST(count(DISTINCT doc_id) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS tf, CAST(max(dl) AS INTEGER) AS longest FROM u GROUP BY token""")
def index_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file = source: src2 is added again with another text, src1 is removed; the index is told by its words."""
    c = chunks(spark, sf_dir).select("chunk_id", F.col("source").alias("file_id"), "content")
    index = store.index_add(store.postings(c), c.where("file_id = 'src2'").withColumn("content", F.concat("content", F.lit(" again"))))
    index = store.index_remove(index, spark.createDataFrame([("src1",)], "file_id string"))
    return index.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.max("dl").alias("longest"))


@query("SELECT p_partkey AS query_id, 'new_document' AS decision, CASE WHEN p_partkey % 3 = 0 THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS confidence, CAST(p_size AS DOUBLE) AS version_rank, CAST(CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS candidates FROM part")
def version_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third name has two candidates."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("name"), F.concat(F.lit("v"), F.col("p_size").cast("string")).alias("label"))
    found = p.where("query_id % 3 = 0").select("query_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("candidate"))
    return store.version_decision(p, found).select("query_id", "decision", "confidence", "version_rank", "candidates")


#: Vendors, patterns and stop words of the classifier, written out for SQL.
ORCHESTRATED = r"""
oq AS (SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN 'ERROR 500 at 10.0.0.1 and 10.0.0.2 ' || text WHEN 1 THEN 'how to troubleshoot on kubernetes and aws ' || text ELSE text END AS q, CASE item_id % 3 WHEN 0 THEN 'en' END AS asker FROM benchmark),
oc AS (SELECT doc_id, lang, CASE doc_id % 3 WHEN 0 THEN text || ' seen at 10.0.0.1' ELSE text END AS text, CASE doc_id % 5 WHEN 0 THEN 'aws' WHEN 1 THEN 'kubernetes' ELSE '' END AS vendor FROM documents),
dt AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM oc),
dl AS (SELECT doc_id, count(*) AS dl FROM dt GROUP BY doc_id),
tf AS (SELECT doc_id, token, count(*) AS tf FROM dt GROUP BY doc_id, token),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
cs AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
qt AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(q), '[\p{L}\p{N}_]+')) AS token FROM oq) GROUP BY ALL),
bs AS (SELECT query_id, tf.doc_id AS chunk_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1)))), 6) AS score FROM tf JOIN qt USING (token) JOIN df USING (token) JOIN dl ON dl.doc_id = tf.doc_id CROSS JOIN cs GROUP BY query_id, tf.doc_id),
bm AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bs QUALIFY rank <= 20),
"""


@query("WITH " + ORCHESTRATED.replace("\\\\", "\\") + f"""
i1 AS (SELECT query_id, regexp_replace(q, '^[[:space:]]+|[[:space:]]+$', '', 'g') AS t FROM oq),
i2 AS (SELECT query_id, {rule_queries.MATCHES} AS m, {rule_queries._hits("t", rules.SEMANTIC_PATTERNS)} AS sh, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: length(w) > 0)) AS words, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+') AS ts, t FROM i1),
i3 AS (SELECT *, words <= 3 AND len(m) = 0 AND sh = 0 AS short FROM i2),
i4 AS (SELECT *, CASE WHEN short THEN 0.4::DOUBLE ELSE round(least(1.0::DOUBLE, len(m) * 0.25::DOUBLE), 6) END AS kw, CASE WHEN short THEN 0.4::DOUBLE ELSE round(least(1.0::DOUBLE, sh * 0.3::DOUBLE), 6) END AS sem,
  list_filter(list_transform(m, lambda x: regexp_replace(regexp_replace(x, '^[[:space:]]+|[[:space:]]+$', '', 'g'), '^"+|"+$', '', 'g')), lambda x: length(x) >= 2) AS exact,
  list_filter(ts, lambda w: length(w) > 2 AND NOT list_contains(['the','a','an','is','are','to','for','of','in','on','how','what','when','where','why','do','does','can','i','me','my','you','your','please','tell','about','and','or','not','this','that','with','from','it','be','was','were','been','have','has'], w)) AS content FROM i3),
intent AS (SELECT query_id, CASE WHEN kw >= 0.6 AND kw > sem THEN 'keyword' WHEN sem >= 0.6 AND sem > kw THEN 'semantic' ELSE 'mixed' END AS strategy, (CASE WHEN len(exact) > 0 THEN exact ELSE content END)[1:20] AS terms,
  list_distinct(regexp_extract_all(lower(t), '\\b(?:aws|kubernetes)\\b')) AS vendors FROM i4),
ask AS (SELECT query_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS place FROM intent),
ft AS (SELECT DISTINCT query_id, lower(term) AS token FROM ask), fc AS (SELECT query_id, count(*) AS c FROM ft GROUP BY query_id),
fs AS (SELECT query_id, doc_id AS chunk_id, round(sum(0.1 * list_sum(list_transform(range(1, tf + 1), lambda j: 1.0::DOUBLE / (j * j))) / 1.64493) / any_value(c), 6) AS score FROM tf JOIN ft USING (token) JOIN fc USING (query_id) GROUP BY query_id, doc_id),
fts AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fs WHERE score >= 0.01 QUALIFY rank <= 15),
st AS (SELECT query_id, lower(term) AS term, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n FROM ask WHERE regexp_matches(term, '[.:/\\\\-]') OR regexp_matches(term, '^0[xX]') QUALIFY n <= 8),
sl AS (SELECT query_id, doc_id AS chunk_id, count(*) AS score FROM (SELECT DISTINCT query_id, term FROM st) JOIN oc ON contains(lower(text), term) GROUP BY ALL),
sk AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM sl WHERE NOT EXISTS (SELECT 1 FROM fts WHERE fts.query_id = sl.query_id AND fts.chunk_id = sl.chunk_id)),
kwd AS (SELECT query_id, chunk_id, rank, false AS exact FROM fts UNION ALL SELECT sk.query_id, chunk_id, r + coalesce(h, 0), true FROM sk LEFT JOIN (SELECT query_id, max(rank) AS h FROM fts GROUP BY query_id) USING (query_id) WHERE r + coalesce(h, 0) <= 15),
md AS (SELECT query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM (SELECT DISTINCT query_id, doc_id FROM (SELECT query_id, unnest(vendors) AS h FROM intent) JOIN oc ON contains(vendor, h)) QUALIFY rank <= 10),
{search_queries.DOC_VECTORS},
every AS (SELECT query_id, chunk_id, rank, false AS exact, 0 AS c FROM vec UNION ALL SELECT query_id, chunk_id, rank, false, 1 FROM bm UNION ALL SELECT query_id, chunk_id, rank, exact, 2 FROM kwd UNION ALL SELECT query_id, chunk_id, rank, false, 3 FROM md),
own AS (SELECT e.query_id, chunk_id, exact, c, row_number() OVER (PARTITION BY e.query_id, c ORDER BY rank) AS rank FROM every e JOIN oq USING (query_id) JOIN oc ON oc.doc_id = e.chunk_id WHERE asker IS NULL OR asker = lang),
wt AS (SELECT query_id, strategy, CASE strategy WHEN 'keyword' THEN 0.45::DOUBLE - 0.15::DOUBLE WHEN 'semantic' THEN 0.55::DOUBLE ELSE 0.45::DOUBLE END AS v, CASE strategy WHEN 'keyword' THEN 0.36::DOUBLE ELSE 0.30::DOUBLE END AS b, CASE strategy WHEN 'keyword' THEN 0.34::DOUBLE WHEN 'semantic' THEN 0.25::DOUBLE - 0.10::DOUBLE ELSE 0.25::DOUBLE END AS k FROM intent),
sc AS (SELECT query_id, strategy, chunk_id, c, CASE c WHEN 0 THEN v / (v + b + k) WHEN 1 THEN b / (v + b + k) WHEN 2 THEN k / (v + b + k) ELSE 0.05::DOUBLE END / (60 + rank) * CASE WHEN exact THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM own JOIN wt USING (query_id)),
fu AS (SELECT query_id, strategy, chunk_id, count(DISTINCT c) AS channels, round(sum(s) * CASE WHEN count(DISTINCT c) >= 3 THEN 1.15::DOUBLE * 1.10::DOUBLE WHEN count(DISTINCT c) = 2 THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END, 10) AS score FROM sc GROUP BY query_id, strategy, chunk_id)
SELECT query_id, strategy, chunk_id, score, channels, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM fu QUALIFY rank <= 15""")
def retrieve_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of all three strategies, some with vendors, some by an owner; chunks with structured words and vendors in their metadata."""
    k, c = F.col("query_id"), F.col("chunk_id")
    qs = questions(spark, sf_dir).withColumn("q", _by_id(k % 4, F.concat(F.lit("ERROR 500 at 10.0.0.1 and 10.0.0.2 "), "q"), F.concat(F.lit("how to troubleshoot on kubernetes and aws "), "q"), F.col("q"))).withColumn("asker", F.when(k % 3 == 0, "en"))
    ch = chunks(spark, sf_dir).withColumn("content", F.when(c % 3 == 0, F.concat("content", F.lit(" seen at 10.0.0.1"))).otherwise(F.col("content")))
    ch = ch.withColumn("meta", F.to_json(F.struct(_by_id(c % 5, F.lit("aws"), F.lit("kubernetes"), F.lit("")).alias("vendor"))))
    return retrieve.retrieve(qs, ch, search_queries._doc_vectors(spark, sf_dir))
