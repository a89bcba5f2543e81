"""Parsing, chunking and text-function queries; pages are the raw uploads, since they have headings, lists and paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as fn
from lodestone.operators import parse
from lodestone.plans.registry import query
from lodestone.sources.tables import PAGE_LINES, page_lines, table


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_CONTENT = " OR ".join(f"regexp_matches(t, {_lit(p)})" for p in parse.CONTENT_HEADINGS)
TYPED = f"""
typed0 AS (SELECT doc_id, line_no, line, {STRIP.format("line")} AS t FROM page_lines),
typed AS (SELECT doc_id, line_no, line, CASE WHEN t = '' THEN 'blank' WHEN regexp_matches(t, {_lit(parse.DIVIDER)}) THEN 'divider' WHEN {_CONTENT} OR regexp_matches(t, {_lit(parse.HEADING)}) THEN 'heading'
  WHEN regexp_matches(t, {_lit(parse.BULLET)}) THEN 'bullet' WHEN regexp_matches(t, {_lit(parse.CODE)}) THEN 'code'
  WHEN len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: length(w) > 0)) >= 3 AND (contains(t, '|') OR contains(t, '  ')) THEN 'table' ELSE 'paragraph' END AS type FROM typed0)"""
BLOCKS = f"""
b0 AS (SELECT *, CASE WHEN type = 'heading' OR lag(type) OVER w IS NULL OR lag(type) OVER w <> type THEN 1 ELSE 0 END AS starts FROM typed WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
b1 AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM b0),
b2 AS (SELECT doc_id, island, type, {STRIP.format("string_agg(line, chr(10) ORDER BY line_no)")} AS text FROM b1 WHERE type NOT IN ('blank', 'divider') GROUP BY doc_id, island, type),
b3 AS (SELECT doc_id, island, type, CASE WHEN type = 'heading' THEN {STRIP.format("regexp_replace(text, '^#+', '')")} ELSE text END AS text FROM b2),
blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS block_no, type, text, last_value(CASE WHEN type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY island ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM b3)"""
ALIASES = "[" + ", ".join(f"{{'a': {_lit(a)}, 's': {_lit(s)}, 't': {_lit(t)}}}" for a, s, t in parse.SECTION_ALIASES) + "]"


def _section(h: str) -> str:
    low = f"lower(trim(coalesce({h}, ''), ' '))"
    return f"CASE WHEN {low} <> '' THEN coalesce(list_filter({ALIASES}, lambda r: r.a = {low})[1], list_filter({ALIASES}, lambda r: contains({low}, r.a))[1]) END"


CHUNKS = f"""
c0 AS (SELECT *, sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_no) AS part FROM blocks),
c1 AS (SELECT doc_id, part, max(heading) AS heading, {STRIP.format("string_agg(text, chr(10) || chr(10) ORDER BY block_no)")} AS body, list(type) AS types FROM c0 WHERE type <> 'heading' GROUP BY doc_id, part),
c2 AS (SELECT *, {_section("heading")} AS rule, lower(coalesce(heading, '')) AS h FROM c1 WHERE body <> ''),
section_chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS BIGINT) AS chunk_no, heading, rule.s AS section,
  coalesce(rule.t, CASE WHEN contains(h, 'scenario') THEN CASE WHEN regexp_matches(h, 'troubleshoot|diagnostic|failure|issue|down|error|fault|loss|degrad') THEN 'diagnostic_chunk' ELSE 'general_chunk' END WHEN contains(h, 'escalation') THEN 'escalation_chunk'
    WHEN list_contains(types, 'code') THEN 'command_chunk' WHEN list_contains(types, 'table') THEN 'validation_chunk' ELSE 'general_chunk' END) AS chunk_type,
  CASE WHEN length(coalesce(heading, '')) > 0 THEN '[' || heading || ']' || chr(10) || chr(10) || body ELSE body END AS text FROM c2)"""
PARSED = f"{PAGE_LINES}, {TYPED}, {BLOCKS}"


@query(f"WITH {PAGE_LINES}, {TYPED} SELECT doc_id, line_no, type FROM typed")
def line_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_lines(spark, sf_dir).select("doc_id", "line_no", parse.line_type(F.col("line")).alias("type"))


@query(f"WITH {PARSED} SELECT doc_id, block_no, type, text, heading FROM blocks")
def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.blocks(page_lines(spark, sf_dir))


@query(f"WITH {PARSED}, {CHUNKS} SELECT doc_id, chunk_no, heading, section, chunk_type, text, CAST(greatest(1, length(text) // 4) AS INTEGER) AS token_estimate FROM section_chunks")
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.build_chunks(parse.blocks(page_lines(spark, sf_dir)), most=None)


#: Documents as lines that end at a stop or a bar, every second one a bullet.
DOC_LINES = """
dlines AS (SELECT doc_id, string_split(regexp_replace(text, '([.|])\\s', '\\1' || chr(1), 'g'), chr(1)) AS ls FROM documents),
dsplit AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM dlines),
page_lines AS (SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CASE WHEN line_no % 2 = 1 THEN '- ' || line ELSE line END AS line FROM dsplit)"""
#: The fold itself, block by block.
FOLD = """
ci AS (SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY block_no) AS i, CAST(length(text) AS BIGINT) AS n FROM c0 WHERE type <> 'heading'),
fold AS (SELECT doc_id, part, i, n + 2 AS chars, 0 AS g FROM ci WHERE i = 1 UNION ALL
  SELECT c.doc_id, c.part, c.i, CASE WHEN f.chars + c.n > 6000 AND f.chars >= 200 THEN 0 ELSE f.chars END + c.n + 2, g + CASE WHEN f.chars + c.n > 6000 AND f.chars >= 200 THEN 1 ELSE 0 END FROM fold f JOIN ci c ON c.doc_id = f.doc_id AND c.part = f.part AND c.i = f.i + 1)"""
FOLDED = CHUNKS.replace("FROM c0 WHERE type <> 'heading' GROUP BY doc_id, part)", "FROM ci JOIN fold USING (doc_id, part, i) GROUP BY doc_id, part, g)").replace("c1 AS (SELECT doc_id, part,", f"{FOLD.strip()},\nc1 AS (SELECT doc_id, part, g,").replace("ORDER BY part) - 1", "ORDER BY part, g) - 1")


@query(f"WITH RECURSIVE {DOC_LINES}, {TYPED}, {BLOCKS}, {FOLDED} SELECT doc_id, chunk_no, heading, section, chunk_type, text, CAST(greatest(1, length(text) // 4) AS INTEGER) AS token_estimate FROM section_chunks")
def char_fold_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With splits inside long sections, where a new chunk depends on all that came before it."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.posexplode(F.split("text", r"(?<=[.|])\s")).alias("line_no", "line"))
    odd = lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.when(F.col("line_no") % 2 == 1, F.concat(F.lit("- "), "line")).otherwise(F.col("line")).alias("line"))
    return parse.build_chunks(parse.blocks(odd))


@query(f"WITH {PARSED}, {CHUNKS} SELECT doc_id, chunk_no, chunk_type FROM section_chunks")
def chunk_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_chunks(spark, sf_dir).select("doc_id", "chunk_no", "chunk_type")


HEADINGS = "h AS (SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'Troubleshooting ' || p_name WHEN 1 THEN 'Scenario ' || p_name WHEN 2 THEN p_type WHEN 3 THEN 'Corrective Actions' WHEN 4 THEN 'Client ' || p_name WHEN 5 THEN 'Root Cause' WHEN 6 THEN '' WHEN 7 THEN NULL ELSE upper(p_name) || ' fix' END AS heading FROM part)"


@query(f"WITH {HEADINGS} SELECT id, rule.s AS section, rule.t AS section_type FROM (SELECT id, {_section('heading')} AS rule FROM h)")
def section_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings made from part names."""
    k = F.col("p_partkey") % 9
    said = lambda s: F.concat(F.lit(s), F.col("p_name"))
    heading = F.when(k == 0, said("Troubleshooting ")).when(k == 1, said("Scenario ")).when(k == 2, F.col("p_type")).when(k == 3, "Corrective Actions").when(k == 4, said("Client ")).when(k == 5, "Root Cause").when(k == 6, "").when(k == 7, None).otherwise(F.concat(F.upper("p_name"), F.lit(" fix")))
    return parse.match_section(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), heading.alias("heading"))).select("id", "section", "section_type")


@query(f"""WITH {PAGE_LINES}, w AS (SELECT doc_id, line_no, line, unnest(range(greatest(0, CAST(floor((line_no - 8) / 6.0) AS BIGINT) + 1), CAST(floor(line_no / 6.0) AS BIGINT) + 1)) AS window_no FROM page_lines)
SELECT doc_id, CAST(window_no AS BIGINT) AS window_no, min(line_no) AS first_line, CAST(count(*) AS BIGINT) AS lines, string_agg(coalesce(line, ''), chr(10) ORDER BY line_no) AS text FROM w GROUP BY doc_id, window_no""")
def line_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are short: windows of 8 lines with 2 in common."""
    return parse.line_windows(page_lines(spark, sf_dir), 8, 2)


@query(f"WITH {PARSED}, {CHUNKS} SELECT doc_id, arg_max(heading, chunk_no) FILTER (WHERE heading IS NOT NULL) AS title, arg_max(chunk_type, chunk_no) AS document_type, arg_min(section, chunk_no) FILTER (WHERE section IS NOT NULL) AS first_section, CAST(count(DISTINCT CASE WHEN length(heading) > 0 THEN heading END) AS BIGINT) AS section_count, CAST(count(*) AS BIGINT) AS chunk_count FROM section_chunks GROUP BY doc_id")
def doc_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.rollup(section_chunks(spark, sf_dir))


NAMES = "n AS (SELECT p_partkey AS id, '/in/' || p_name || CASE p_partkey % 4 WHEN 0 THEN ' v' || p_size || '.' || (p_partkey % 7) || ' FINAL.pdf' WHEN 1 THEN '_copy (' || p_brand || ').docx' WHEN 2 THEN ' Version ' || p_size || ' runbook' ELSE ' draft.sop.md' END AS name FROM part)"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, cat = F.col("p_partkey") % 4, lambda *c: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    size = F.col("p_size").cast("string")
    tail = F.when(k == 0, cat(" v", size, ".", (F.col("p_partkey") % 7).cast("string"), " FINAL.pdf")).when(k == 1, cat("_copy (", F.col("p_brand"), ").docx")).when(k == 2, cat(" Version ", size, " runbook")).otherwise(F.lit(" draft.sop.md"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), cat("/in/", F.col("p_name"), tail).alias("name"))


@query(f"""WITH {NAMES}, a AS (SELECT id, regexp_replace(lower(trim(name, ' ')), '^(.*/)?([^/]+?)(\\.[^./]*)?$', '\\2') AS s FROM n),
b AS (SELECT id, regexp_replace(regexp_replace(s, '\\bv(?:ersion)?[\\s._-]*[0-9]+(?:\\.[0-9]+)?\\b', '', 'g'), '\\b(final|draft|copy|rev|revision)\\b', '', 'g') AS s FROM a)
SELECT id, regexp_replace(regexp_replace(s, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS normalized FROM b""")
def normalize_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("id", fn.normalize_filename(F.col("name")).alias("normalized"))


@query(f"WITH {NAMES} SELECT id, coalesce(TRY_CAST(nullif(regexp_extract(name, '([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE), 0.0::DOUBLE) AS version_rank FROM n")
def version_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("id", fn.version_rank(F.col("name")).alias("version_rank"))


@query(f"WITH {NAMES}, t AS (SELECT id, lower(name) || ' ' AS t FROM n) SELECT id, CASE WHEN contains(t, 'runbook') THEN 'Runbook' WHEN contains(t, 'sop') OR contains(t, 'standard operating procedure') THEN 'SOP' WHEN contains(t, 'kb') OR contains(t, 'knowledge base') THEN 'KB' WHEN contains(t, 'vendor') THEN 'Vendor doc' ELSE 'Unknown' END AS document_type FROM t")
def doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("id", fn.document_type(F.col("name"), F.lit(None).cast("string")).alias("document_type"))


@query("""WITH v AS (SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M') WHEN 4 THEN strftime(o_orderdate, '%Y') || '-02-30' WHEN 5 THEN ' ' || o_orderpriority ELSE NULL END AS v FROM orders), t AS (SELECT id, trim(v, ' ') AS v FROM v)
SELECT id, CASE WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN CASE WHEN TRY_CAST(v AS DATE) IS NOT NULL THEN v END WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}$') THEN CASE WHEN TRY_CAST(v || '-01' AS DATE) IS NOT NULL THEN v || '-01' END
WHEN regexp_matches(v, '^[0-9]{4}$') THEN v || '-01-01' WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN CASE WHEN TRY_CAST(left(v, 10) AS DATE) IS NOT NULL THEN left(v, 10) END END AS day FROM t""")
def safe_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in seven ways, some of them not dates."""
    k, d = F.col("o_orderkey") % 7, lambda f: F.date_format("o_orderdate", f)
    v = F.when(k == 0, d("yyyy-MM-dd")).when(k == 1, d("yyyy-MM")).when(k == 2, d("yyyy")).when(k == 3, d("yyyy-MM-dd'T'HH:mm")).when(k == 4, F.concat(d("yyyy"), F.lit("-02-30"))).when(k == 5, F.concat(F.lit(" "), "o_orderpriority"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), fn.safe_date(v).alias("day"))


@query("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS token_estimate FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fn.token_estimate(F.col("text")).alias("token_estimate"))


@query(f"WITH {NAMES}, e AS (SELECT id, lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS suffix, id % 130 AS mb FROM n) SELECT id, suffix, CAST(mb AS BIGINT) AS mb FROM e WHERE suffix IN ('log', 'txt', 'md', 'json', 'pdf', 'docx') AND mb <= 100")
def upload_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed suffixes, at most 100 MB (sizes made from the id)."""
    from lodestone.sources.readers import valid_uploads

    files = _names(spark, sf_dir).withColumn("mb", (F.col("id") % 130).cast("long"))
    return valid_uploads(files, "name", "mb").select("id", "suffix", "mb")


@query("SELECT doc_id, nullif(left(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '), 120), '') AS summary FROM documents")
def clean_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fn.clean(F.col("text"), 120).alias("summary"))


@query("""WITH w AS (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: length(trim(x, ' ')) > 0) AS w FROM conversations), i AS (SELECT conv_id, turn, w, list_filter(range(1, len(w) + 1), lambda i: list_position(list_transform(w, lambda x: lower(x)), lower(w[i])) = i) AS f FROM w)
SELECT conv_id, turn, array_to_string(list_transform(f[1:8], lambda i: w[i]), '|') AS tags FROM i""")
def distinct_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight words of each turn that differ in more than case."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(fn.distinct_ignoring_case(F.split("text", " "), 8), "|").alias("tags"))


@query(f"""WITH {PARSED}, {CHUNKS} SELECT doc_id, chunk_no, CAST(chunk_no // 6 AS BIGINT) AS batch, '[summary] ' || coalesce(nullif(left(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '), 60), ''), '') || chr(10) || '[section] ' || coalesce(heading, '') || chr(10) || '[chunk_type] ' || chunk_type || chr(10) || text AS contextualized FROM section_chunks""")
def contextualized_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk text with its summary, section and type in front; chunks go in batches of six."""
    c = section_chunks(spark, sf_dir)
    nl = F.lit("\n")
    text = F.concat(F.lit("[summary] "), F.coalesce(fn.clean(F.col("text"), 60), F.lit("")), nl, F.lit("[section] "), F.coalesce("heading", F.lit("")), nl, F.lit("[chunk_type] "), "chunk_type", nl, "text")
    return c.select("doc_id", "chunk_no", F.floor(F.col("chunk_no") / 6).cast("long").alias("batch"), text.alias("contextualized"))


@query(f"""WITH RECURSIVE {PAGE_LINES}, l0 AS (SELECT doc_id, line_no AS i, coalesce(line, '') AS line, max(line_no) OVER (PARTITION BY doc_id) AS last FROM page_lines),
l1 AS (SELECT *, length(line) + CASE WHEN i < last THEN 1 ELSE 0 END AS n FROM l0), l2 AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM l1),
ends AS (SELECT a.doc_id, a.i AS first, k.kept, min(b.i) AS fin FROM l2 a CROSS JOIN (VALUES (0), (2)) k(kept) JOIN l2 b ON b.doc_id = a.doc_id AND b.i >= a.i + k.kept AND (b.i - a.i + 1 >= 8 OR b.upto - a.upto + a.n >= 150) GROUP BY ALL),
runs(doc_id, window_no, first, fin, last) AS (SELECT l2.doc_id, 0, 0::BIGINT, fin, last FROM l2 LEFT JOIN ends e ON e.doc_id = l2.doc_id AND e.first = 0 AND e.kept = 0 WHERE i = 0
  UNION ALL SELECT x.doc_id, x.no, x.nxt, e.fin, x.last FROM (SELECT doc_id, window_no + 1 AS no, CASE WHEN fin - first + 1 > 2 THEN fin - 1 ELSE fin + 1 END AS nxt, CASE WHEN fin - first + 1 > 2 THEN 2 ELSE 0 END AS kept, last FROM runs WHERE fin IS NOT NULL) x
  LEFT JOIN ends e ON e.doc_id = x.doc_id AND e.first = x.nxt AND e.kept = x.kept WHERE x.nxt <= x.last)
SELECT r.doc_id, CAST(window_no AS BIGINT) AS window_no, first AS first_line, CAST(count(*) AS BIGINT) AS lines, string_agg(line, chr(10) ORDER BY i) AS text FROM runs r JOIN l2 ON l2.doc_id = r.doc_id AND i BETWEEN first AND coalesce(fin, r.last) GROUP BY ALL""")
def text_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are short: windows of 8 lines or 150 characters with 2 lines in common."""
    return parse.text_windows(page_lines(spark, sf_dir), 8, 150, 2)
