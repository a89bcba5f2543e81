"""Readers and sinks: plain text, HTML, optional PDF and DOCX, evaluation logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import SETTINGS

#: Suffixes that may be uploaded.
SUFFIXES = ("log", "txt", "md", "json", "pdf", "docx")
EVAL_SCHEMA = "query string, answer string, confidence double, passed boolean, issues array<string>, model string"


def valid_uploads(files: DataFrame, name: str = "name", mb: str = "mb") -> DataFrame:
    """Files with an allowed suffix and size; plus suffix."""
    out = files.withColumn("suffix", F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)))
    return out.where(F.col("suffix").isin(*SUFFIXES) & (F.col(mb) <= SETTINGS.max_file_mb))


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """name, text: whole files as UTF-8 (bytes that are not UTF-8 become replacement characters)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def lines_of(texts: DataFrame, key: str = "name") -> DataFrame:
    """(key as doc_id, line_no, line) with trailing blanks off; splits at every separator of Unicode lines."""
    parts = F.split("text", "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]")
    return texts.select(F.col(key).alias("doc_id"), F.posexplode(parts).alias("line_no", "line")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.rtrim("line").alias("line"))


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """name, page (from 1), text; needs PyMuPDF on the executors."""

    def pages(batches):
        import fitz
        import pandas as pd

        for b in batches:
            rows = [(n, i + 1, p.get_text()) for n, raw in zip(b["name"], b["content"]) for i, p in enumerate(fitz.open(stream=raw, filetype="pdf"))]
            yield pd.DataFrame(rows, columns=["name", "page", "text"])

    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("name"), "content").mapInPandas(pages, "name string, page int, text string")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """name, order, style, text; tables follow the paragraphs as "a | b" rows; needs python-docx on the executors."""

    def paragraphs(batches):
        import io

        import docx
        import pandas as pd

        for b in batches:
            rows = []
            for n, raw in zip(b["name"], b["content"]):
                d = docx.Document(io.BytesIO(raw))
                parts = [(p.style.name, p.text) for p in d.paragraphs] + [("Table", " | ".join(c.text.strip() for c in r.cells)) for t in d.tables for r in t.rows]
                rows += [(n, i, s, x) for i, (s, x) in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["name", "order", "style", "text"])

    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("name"), "content").mapInPandas(paragraphs, "name string, order int, style string, text string")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """name, suffix, place, style, text of every file under path, by its suffix: pages of PDF, paragraphs of DOCX, lines of all others.

    Only the readers whose files are there are planned, so PDF and DOCX need their libraries only where such files lie.
    """
    from functools import reduce

    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("_metadata.file_name").alias("name"))
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    known = F.when(suffix.isin("pdf", "docx"), suffix).otherwise("")
    there = {r.kind for r in names.select(known.alias("kind")).distinct().collect()}  # three kinds at most
    parts = []
    if "" in there:
        plain = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
        plain = lines_of(plain.where(known == ""))
        parts.append(plain.select(F.col("doc_id").alias("name"), F.col("line_no").alias("place"), F.lit(None).cast("string").alias("style"), F.col("line").alias("text")))
    if "pdf" in there:
        parts.append(read_pdf(spark, f"{path}/*.pdf").select("name", F.col("page").cast("long").alias("place"), F.lit(None).cast("string").alias("style"), "text"))
    if "docx" in there:
        parts.append(read_docx(spark, f"{path}/*.docx").select("name", F.col("order").cast("long").alias("place"), "style", "text"))
    if not parts:
        return spark.createDataFrame([], "name string, suffix string, place long, style string, text string")
    return reduce(DataFrame.unionByName, parts).select("name", suffix.alias("suffix"), "place", "style", "text")


def write_eval_log(df: DataFrame, path: str, answer_chars: int = 1000, run: str | None = None) -> None:
    """Append records as JSON lines, answers cut. With `run` they lie in a folder of that run, and writing the run again replaces them."""
    out = df.withColumn("answer", F.substring("answer", 1, answer_chars)).write
    out.mode("append").json(path) if run is None else out.mode("overwrite").json(f"{path}/run={run}")


def scan_eval_log(spark: SparkSession, path: str) -> DataFrame:
    """The records of a JSON-lines log of any number of runs, plus broken: the line that is no record, else null. Blank lines count as nothing; a log that is not there is empty."""
    from lodestone.sources.versioned import Files

    files = Files(spark, path)
    if not files.fs.exists(files.path(path)):
        return spark.createDataFrame([], f"{EVAL_SCHEMA}, broken string")
    lines = spark.read.option("recursiveFileLookup", True).text(path).where(F.length(F.trim("value")) > 0)
    told = F.from_json("value", f"{EVAL_SCHEMA}, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    return lines.select(told.alias("r")).select("r.*")


def read_eval_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON-lines log; blank and broken lines are dropped."""
    return scan_eval_log(spark, path).where("broken is null").drop("broken")
