"""The store's tables as views of the driver's parquet tables (see README for what stands for what)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(df: DataFrame, key: str) -> DataFrame:
    """Rows of a scan with fewer parts than the session has cores, dealt out by key, so that work on texts uses all cores.

    A small file is often one row group, which is one task however many splits there are. Scans of many files, as any large
    table is, stay as they are: no shuffle is added to them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, owner_id (language), source, content."""
    return wide(table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("owner_id"), "source", F.col("text").alias("content"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, q: every benchmark item is one question."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(table(spark, sf_dir, "conversations"), "conv_id").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id (session * 1000 + turn), q, answer, ctx, source: each assistant turn with the user turn before it and the document of its session."""
    m = messages(spark, sf_dir)
    answers = m.where("role = 'assistant'").select("session_id", "turn", F.col("content").alias("answer"))
    asked = m.where("role = 'user'").select("session_id", (F.col("turn") + 1).alias("turn"), F.col("content").alias("q"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"), F.col("text").alias("ctx"), "source")
    pairs = answers.join(asked, ["session_id", "turn"]).join(docs, "session_id", "left")
    return pairs.select((F.col("session_id") * 1000 + F.col("turn")).alias("case_id"), "q", "answer", F.coalesce("ctx", F.lit("")).alias("ctx"), "source")


#: The same view for DuckDB.
EXCHANGES = """
exchanges AS (
  SELECT a.conv_id * 1000 + a.turn AS case_id, u.text AS q, a.text AS answer, coalesce(d.text, '') AS ctx, d.source AS source
  FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn AND u.role = 'user'
  LEFT JOIN documents d ON d.doc_id = a.conv_id WHERE a.role = 'assistant')
"""

#: Page text: tags off, block ends to line breaks, h1 as a heading line; entities for markup characters decoded.
BLOCK_END = r"</(?:p|li|h1|div|ul|tr|title)>|<br ?/?>"


def page_text(html: F.Column) -> F.Column:
    t = F.regexp_replace(html, r"(?s)<(script|style|nav|head)[^>]*>.*?</(script|style|nav|head)>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"<h1[^>]*>", "\n# ")
    t = F.regexp_replace(t, r"<li[^>]*>", "\n- ")
    t = F.regexp_replace(t, BLOCK_END, "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return t


PAGE_TEXT = r"""
replace(replace(replace(replace(replace(
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?s)<(script|style|nav|head)[^>]*>.*?</(script|style|nav|head)>', '', 'g'),
  '(?s)<!--.*?-->', '', 'g'), '<h1[^>]*>', chr(10) || '# ', 'g'), '<li[^>]*>', chr(10) || '- ', 'g'),
  '</(?:p|li|h1|div|ul|tr|title)>|<br ?/?>', chr(10), 'g'), '<[^>]*>', '', 'g'),
 '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&')
"""


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no (from 0), line (right-trimmed): the text of every page."""
    p = wide(table(spark, sf_dir, "pages"), "page_id").select(F.col("page_id").alias("doc_id"), page_text(F.col("html")).alias("t"))
    lines = p.select("doc_id", F.posexplode(F.split("t", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.regexp_replace("line", r"[ \t\r]+$", "").alias("line"))


PAGE_LINES = f"""
page_texts AS (SELECT page_id AS doc_id, {PAGE_TEXT} AS t FROM pages),
page_split AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS line_no FROM page_texts),
page_lines AS (SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, regexp_replace(line, '[ \\t\\r]+$', '') AS line FROM page_split)
"""
