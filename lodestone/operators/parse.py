"""Lines to typed blocks to section-aware chunks. Windows run inside one document, never over the table."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import SETTINGS as S
from lodestone.functions.text import token_estimate

# The patterns and their order decide a line's type. Written for Java's and RE2's syntax alike.
DIVIDER = r"^[-=*]{5,}$"
CONTENT_HEADINGS = (
    r"(?i)^Troubleshooting Runbook\s*:",
    r"(?i)^Scenario\s+[A-Z0-9]+\s*:",
    r"(?i)^[0-9]+(?:\.[0-9]+)*\s+[A-Z]",
    r"(?i)^(?:Chapter|Section|Part)\s+[0-9]+",
    r"(?i)^(?:Step|Phase|Stage)\s+[0-9]+\s*:",
    r"(?i)^(?:Overview|Introduction|Prerequisites|Procedure|Conclusion|Appendix|Escalation Matrix|Escalation Criteria|References|Glossary|Executive Summary|Background|Scope|Objectives)\s*:?\s*$",
    r"(?i)^(?:Problem|Solution|Workaround|Root Cause|Resolution|Impact)\s*:?\s*$",
)
HEADING = r"^(?:#{1,6}\s+.+|[A-Z][A-Z0-9 /:_()-]{3,})$"
BULLET = r"^(?:[-*•]|[0-9]+\.)\s+"
CODE = r"^(?:\$|>|kubectl |aws |curl |SELECT |INSERT |UPDATE |DELETE |GET |POST |apiVersion:|kind:|FROM |WHERE )"

#: Labels inside a section; they never start a chunk.
SUB_SECTIONS = r"(?i)^(?:Alert Signatures|Severity|Incident Summary|Probable Causes|Corrective Actions|Diagnostic Steps|Resolution Steps|Validation Steps|Validation / Post.Check|Post-Check|Escalation Criteria|Commands / Tools|Commands|Expected Results|Root Cause|Workaround|Affected Systems|Impact Assessment|Pre-Conditions|Post-Conditions|Notes|Warning)\s*:?\s*$"

#: Alias, section, chunk type, in lookup order; a later rule for the same alias has replaced the earlier one.
SECTION_ALIASES = (
    ("title", "title", "heading_chunk"), ("document title", "title", "heading_chunk"), ("troubleshooting runbook", "title", "heading_chunk"),
    ("document_type", "document_type", "classification_chunk"), ("document type", "document_type", "classification_chunk"), ("type", "document_type", "classification_chunk"),
    ("purpose_summary", "purpose_summary", "summary_chunk"), ("purpose", "purpose_summary", "summary_chunk"), ("summary", "purpose_summary", "summary_chunk"), ("overview", "purpose_summary", "summary_chunk"), ("incident summary", "purpose_summary", "summary_chunk"),
    ("domain", "domain", "classification_chunk"), ("service domain", "domain", "classification_chunk"),
    ("vendor_product", "vendor_product", "classification_chunk"), ("vendor", "vendor_product", "classification_chunk"), ("product", "vendor_product", "classification_chunk"), ("vendor/product", "vendor_product", "classification_chunk"),
    ("symptoms", "symptoms", "symptom_chunk"), ("symptom", "symptoms", "symptom_chunk"), ("trigger conditions", "symptoms", "symptom_chunk"), ("issue", "symptoms", "symptom_chunk"), ("problem", "symptoms", "symptom_chunk"), ("alert signatures", "symptoms", "symptom_chunk"), ("alarm signatures", "symptoms", "symptom_chunk"),
    ("diagnostic_steps", "diagnostic_steps", "diagnostic_chunk"), ("diagnostic steps", "diagnostic_steps", "diagnostic_chunk"), ("troubleshooting", "diagnostic_steps", "diagnostic_chunk"), ("diagnosis", "diagnostic_steps", "diagnostic_chunk"), ("investigation", "diagnostic_steps", "diagnostic_chunk"), ("corrective actions", "resolution_steps", "resolution_chunk"), ("diagnostic procedure", "diagnostic_steps", "diagnostic_chunk"),
    ("probable_causes", "probable_causes", "root_cause_chunk"), ("probable causes", "probable_causes", "root_cause_chunk"), ("probable cause", "probable_causes", "root_cause_chunk"), ("root cause", "root_cause_notes", "root_cause_chunk"), ("possible causes", "probable_causes", "root_cause_chunk"), ("failure causes", "probable_causes", "root_cause_chunk"), ("cause analysis", "probable_causes", "root_cause_chunk"),
    ("resolution_steps", "resolution_steps", "resolution_chunk"), ("resolution", "resolution_steps", "resolution_chunk"), ("fix", "resolution_steps", "resolution_chunk"), ("solution", "resolution_steps", "resolution_chunk"), ("remediation", "resolution_steps", "resolution_chunk"), ("repair steps", "resolution_steps", "resolution_chunk"),
    ("escalation_criteria", "escalation_criteria", "escalation_chunk"), ("escalation", "escalation_criteria", "escalation_chunk"), ("escalation criteria", "escalation_criteria", "escalation_chunk"), ("when to escalate", "escalation_criteria", "escalation_chunk"), ("escalation matrix", "escalation_criteria", "escalation_chunk"),
    ("references", "references", "reference_chunk"), ("links", "references", "reference_chunk"), ("related docs", "references", "reference_chunk"),
    ("preconditions", "preconditions", "precondition_chunk"), ("before you begin", "preconditions", "precondition_chunk"),
    ("commands", "commands", "command_chunk"), ("cli", "commands", "command_chunk"), ("command", "commands", "command_chunk"), ("commands / tools", "commands", "command_chunk"),
    ("expected_results", "expected_results", "validation_chunk"), ("expected results", "expected_results", "validation_chunk"), ("expected output", "expected_results", "validation_chunk"),
    ("known_errors", "known_errors", "error_chunk"), ("known errors", "known_errors", "error_chunk"), ("errors", "known_errors", "error_chunk"), ("error codes", "known_errors", "error_chunk"),
    ("root_cause_notes", "root_cause_notes", "root_cause_chunk"), ("root cause notes", "root_cause_notes", "root_cause_chunk"),
    ("workarounds", "workarounds", "workaround_chunk"), ("temporary fix", "workarounds", "workaround_chunk"),
    ("validation_post_checks", "validation_post_checks", "validation_chunk"), ("validation", "validation_post_checks", "validation_chunk"), ("post checks", "validation_post_checks", "validation_chunk"), ("verification", "validation_post_checks", "validation_chunk"), ("validation / post-check", "validation_post_checks", "validation_chunk"), ("post-check", "validation_post_checks", "validation_chunk"),
    ("severity", "severity", "classification_chunk"), ("priority", "severity", "classification_chunk"), ("impact level", "severity", "classification_chunk"),
    ("scenario", "scenario", "diagnostic_chunk"), ("scenario a", "scenario", "diagnostic_chunk"), ("scenario b", "scenario", "diagnostic_chunk"), ("scenario c", "scenario", "diagnostic_chunk"), ("scenario d", "scenario", "diagnostic_chunk"), ("scenario e", "scenario", "diagnostic_chunk"), ("scenario f", "scenario", "diagnostic_chunk"),
)


def line_type(line: Column) -> Column:
    """blank, divider, heading, bullet, code, table or paragraph; the first that fits, in this order."""
    t = F.trim(F.coalesce(line, F.lit("")))
    t = F.regexp_replace(t, r"^\s+|\s+$", "")
    content = reduce(lambda a, b: a | b, [t.rlike(p) for p in CONTENT_HEADINGS])
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: F.length(w) > 0))
    table = (words >= 3) & (F.contains(t, F.lit("|")) | F.contains(t, F.lit("  ")))
    return (
        F.when(t == "", "blank").when(t.rlike(DIVIDER), "divider").when(content | t.rlike(HEADING), "heading")
        .when(t.rlike(BULLET), "bullet").when(t.rlike(CODE), "code").when(table, "table").otherwise("paragraph")
    )


def blocks(lines: DataFrame) -> DataFrame:
    """lines (doc_id, line_no, line) -> doc_id, block_no, type, text, heading: runs of one type; a heading is a block of its own."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    typed = lines.withColumn("type", line_type(F.col("line")))
    starts = (F.col("type") == "heading") | F.lag("type").over(w).isNull() | (F.lag("type").over(w) != F.col("type"))
    typed = typed.withColumn("island", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("type not in ('blank', 'divider')")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    grouped = typed.groupBy("doc_id", "island", "type").agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("text"))
    text = F.regexp_replace(F.col("text"), r"^\s+|\s+$", "")
    grouped = grouped.withColumn("text", F.when(F.col("type") == "heading", F.regexp_replace(F.regexp_replace(text, "^#+", ""), r"^\s+|\s+$", "")).otherwise(text))
    v = Window.partitionBy("doc_id").orderBy("island")
    head = F.last(F.when(F.col("type") == "heading", F.col("text")), ignorenulls=True).over(v.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return grouped.select("doc_id", (F.row_number().over(v) - 1).cast("long").alias("block_no"), "type", "text", head.alias("heading"))


def match_section(headings: DataFrame, heading: str = "heading") -> DataFrame:
    """headings plus section and section_type: the exact alias, else the first alias that is part of the heading."""
    h = F.lower(F.trim(F.coalesce(F.col(heading), F.lit(""))))
    table = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(s).alias("section"), F.lit(t).alias("type")) for a, s, t in SECTION_ALIASES])
    exact = F.get(F.filter(table, lambda r: r["alias"] == h), F.lit(0))
    inside = F.get(F.filter(table, lambda r: F.contains(h, r["alias"])), F.lit(0))
    rule = F.when(h == "", None).otherwise(F.coalesce(exact, inside))
    return headings.withColumn("rule__", rule).withColumn("section", F.col("rule__.section")).withColumn("section_type", F.col("rule__.type")).drop("rule__")


def chunk_type(heading: Column, section_type: Column, types: Column) -> Column:
    """The section's type, else by the heading's words, else by what blocks there are."""
    h = F.lower(F.coalesce(heading, F.lit("")))
    has = lambda *ws: reduce(lambda a, b: a | b, [F.contains(h, F.lit(w)) for w in ws])
    trouble = has("troubleshoot", "diagnostic", "failure", "issue", "down", "error", "fault", "loss", "degrad")
    return (
        F.coalesce(section_type, F.when(has("scenario"), F.when(trouble, "diagnostic_chunk").otherwise("general_chunk")).when(has("escalation"), "escalation_chunk")
        .when(F.array_contains(types, "code"), "command_chunk").when(F.array_contains(types, "table"), "validation_chunk").otherwise("general_chunk"))
    )


def section_breaks(lengths: np.ndarray, most: int, least: int) -> np.ndarray:
    """Group number of each block of a section: a new group where a block would pass `most` characters and the group has `least`.

    Characters before a block grow along a group, so its end is the first place where both hold, found by two searches in
    the prefix sums: as many steps as there are groups, not blocks.
    """
    before = np.concatenate([[0], np.cumsum(lengths + 2)])
    ends, g, first = before[1:] - 2, np.zeros(len(lengths), np.int32), 0
    while first < len(lengths):
        past = max(np.searchsorted(ends, before[first] + most, "right"), np.searchsorted(before[:-1], before[first] + least, "left"), first)
        g[past:] += 1
        if past == first:  # only where least is 0
            past = max(np.searchsorted(ends, before[first] + most, "right"), first + 1)
            g[past:] += past < len(g)
        first = past
    return g


def window_runs(lengths: np.ndarray, size: int, most: int, overlap: int) -> list[tuple[int, int]]:
    """(first, last) of each run of lines; a run ends by the first of two bounds, one of them found in the prefix sums."""
    before, n, out, first, begun = np.concatenate([[0], np.cumsum(lengths)]), len(lengths), [], 0, 0
    while first < n:
        # `begun` lines of the run were handed over by the one before; a run ends with a line of its own
        last = min(first + size - 1, int(np.searchsorted(before[1:], before[first] + most, "left")))
        last = max(last, first + begun)
        if last >= n:
            out.append((first, n - 1))
            break
        out.append((first, last))
        keeps = last - first + 1 > overlap
        first, begun = (last - overlap + 1, overlap) if keeps else (last + 1, 0)
    return out


def _group_udf(most: int, least: int):
    @F.pandas_udf("array<int>")
    def groups(lengths: pd.Series) -> pd.Series:
        return lengths.map(lambda x: section_breaks(np.asarray(x, np.int64), most, least))

    return groups


def _run_udf(size: int, most: int, overlap: int):
    @F.pandas_udf("array<struct<first:int,last:int>>")
    def runs(lengths: pd.Series) -> pd.Series:
        return lengths.map(lambda x: [{"first": a, "last": z} for a, z in window_runs(np.asarray(x, np.int64), size, most, overlap)])

    return runs


def build_chunks(block_rows: DataFrame, most: int | None = S.chunk_max_chars, least: int = S.chunk_min_chars) -> DataFrame:
    """blocks -> doc_id, chunk_no, heading, section, chunk_type, text, token_estimate.

    Every heading starts a section; `most` (None: never) splits long sections between blocks. Sections without text
    other than their heading give no chunk. The heading stands in brackets before the text.
    """
    w = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = block_rows.withColumn("part", F.sum((F.col("type") == "heading").cast("int")).over(w)).where("type != 'heading'")
    heading = rows.groupBy("doc_id", "part").agg(F.max("heading").alias("heading"))
    if most is None:
        rows = rows.withColumn("g", F.lit(0))
    else:
        # Only the lengths of a section come together; its texts stay rows.
        order = F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("block_no")) - 1
        rows = rows.withColumn("place", order)
        sized = rows.groupBy("doc_id", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.length("text").cast("long").alias("n")))), lambda x: x["n"]).alias("ns"))
        told = sized.where(F.size("ns") > 1).select("doc_id", "part", F.posexplode(_group_udf(max(most, 6000), least)("ns")).alias("place", "g"))
        rows = rows.join(told, ["doc_id", "part", "place"], "left").withColumn("g", F.coalesce("g", F.lit(0)))
    own = F.array_sort(F.collect_list(F.struct("block_no", "type", "text")))
    per = rows.groupBy("doc_id", "part", "g").agg(own.alias("items")).join(heading, ["doc_id", "part"])
    body = F.array_join(F.transform("items", lambda x: x["text"]), "\n\n")
    per = per.select("doc_id", "part", "g", "heading", F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"), F.transform("items", lambda x: x["type"]).alias("types")).where("body != ''")
    text = F.when(F.length(F.coalesce("heading", F.lit(""))) > 0, F.concat(F.lit("["), F.col("heading"), F.lit("]\n\n"), F.col("body"))).otherwise(F.col("body"))
    per = match_section(per)
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "g")) - 1
    return per.select("doc_id", n.cast("long").alias("chunk_no"), "heading", "section", chunk_type(F.col("heading"), F.col("section_type"), F.col("types")).alias("chunk_type"), text.alias("text"), token_estimate(text).alias("token_estimate"))


def line_windows(lines: DataFrame, size: int = 80, overlap: int = 10) -> DataFrame:
    """Overlapping runs of `size` lines: window i starts at line i * (size - overlap). doc_id, window_no, first_line, lines, text."""
    step = size - overlap
    at = F.col("line_no")
    low = F.greatest(F.lit(0), F.floor((at - size) / step) + 1)
    placed = lines.withColumn("window_no", F.explode(F.sequence(low.cast("long"), F.floor(at / step).cast("long"))))
    # The run that only repeats the end of the one before it is kept, as long as it has a line.
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return placed.groupBy("doc_id", "window_no").agg(F.min("line_no").alias("first_line"), F.count("*").alias("lines"), F.array_join(F.transform(ordered, lambda s: F.coalesce(s["line"], F.lit(""))), "\n").alias("text"))


def text_windows(lines: DataFrame, size: int = 80, most: int = 6000, overlap: int = 10) -> DataFrame:
    """Runs of lines that end at `size` lines or `most` characters (line ends count), whichever comes first.

    A run of more than `overlap` lines gives its last ones to the next run; a shorter one gives none. What is left at the
    end is a run too, also where it only repeats lines. doc_id, window_no, first_line, lines, text; null lines are empty.
    Where a run ends depends on all runs before it, so the lengths of a document's lines come together, and only they.
    """
    placed = lines.select("doc_id", "line_no", F.coalesce("line", F.lit("")).alias("line"), (F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1).alias("place"))
    per = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", F.length("line").cast("long").alias("n")))).alias("ls"))
    sizes = F.transform("ls", lambda x, i: x["n"] + (i < F.size("ls") - 1).cast("long"))
    runs = per.select("doc_id", F.posexplode(_run_udf(size, most, overlap)(sizes)).alias("window_no", "w"))
    at = runs.select("doc_id", F.col("window_no").cast("long").alias("window_no"), F.explode(F.sequence("w.first", "w.last")).alias("place"))
    own = F.array_sort(F.collect_list(F.struct("place", "line_no", "line")))
    each = at.join(placed, ["doc_id", "place"]).groupBy("doc_id", "window_no").agg(own.alias("ls"))
    return each.select("doc_id", "window_no", F.get("ls", F.lit(0))["line_no"].alias("first_line"), F.size("ls").cast("long").alias("lines"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("text"))



def rollup(chunk_rows: DataFrame) -> DataFrame:
    """doc_id, title (last heading), document_type (last), first_section, section_count, chunk_count.

    First and last non-null values in chunk order as plain aggregates: no window, map-side combined.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("chunk_no")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("chunk_no")))
    named = F.when(F.length("heading") > 0, F.col("heading"))
    return chunk_rows.groupBy("doc_id").agg(last("heading").alias("title"), last("chunk_type").alias("document_type"), first("section").alias("first_section"), F.countDistinct(named).alias("section_count"), F.count("*").alias("chunk_count"))


def styled_type(style: Column, text: Column) -> Column:
    """Type of a paragraph of a styled document: by its style, then by its text; null for blank ones and dividers, which are left out."""
    t, st = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), F.lower(F.coalesce(style, F.lit("")))
    content = reduce(lambda a, b: a | b, [t.rlike(p) for p in CONTENT_HEADINGS])
    return (
        F.when(t == "", None).when(F.contains(st, F.lit("heading")) | F.contains(st, F.lit("title")) | content, "heading").when(t.rlike(DIVIDER), None)
        .when(t.rlike(SUB_SECTIONS), "sub_heading").when(t.rlike(r"^[-*•]"), "bullet").when(t.rlike(CODE), "code").otherwise("paragraph")
    )


def known_headings(found: DataFrame, texts: DataFrame) -> DataFrame:
    """found (doc_id, heading): proposals of more than three characters that stand in the document's text (doc_id, text), case ignored."""
    both = found.withColumn("heading", F.trim("heading")).where(F.length("heading") > 3).distinct().join(texts, "doc_id")
    return both.where(F.contains(F.lower("text"), F.lower("heading"))).select("doc_id", "heading")


def retag(block_rows: DataFrame, headings: DataFrame) -> DataFrame:
    """blocks whose paragraphs equal to a heading (doc_id, heading) of their document became headings; blocks after one without a heading get it."""
    marks = headings.select("doc_id", F.lower(F.trim("heading")).alias("key"), F.lit(True).alias("hit")).distinct()
    rows = block_rows.withColumn("key", F.lower(F.trim("text"))).join(marks, ["doc_id", "key"], "left")
    rows = rows.withColumn("new", F.col("hit").isNotNull() & (F.col("type") == "paragraph"))
    new = F.col("new")
    rows = rows.withColumn("type", F.when(new, "heading").otherwise(F.col("type"))).withColumn("own", F.when(F.col("type") == "heading", F.when(new, F.trim("text")).otherwise(F.coalesce("heading", "text"))))
    before = F.last("own", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("heading", F.when(F.col("own").isNotNull(), F.col("own")).otherwise(F.coalesce("heading", before))).select("doc_id", "block_no", "type", F.when(new, F.trim("text")).otherwise(F.col("text")).alias("text"), "heading")


def chunk_metadata(chunk_rows: DataFrame, told: DataFrame, name: str = "name") -> DataFrame:
    """chunks (doc_id, chunk_no, name, heading, section, chunk_type) and told (doc_id, chunk_no, item: fields of a model or null, doc: those of the document).

    Each field is the model's for the chunk, cleaned, else its for the document, else what the rules say.
    """
    from lodestone.functions.text import clean, document_type, safe_date

    df = chunk_rows.join(told, ["doc_id", "chunk_no"], "left")
    item, doc = lambda f, n: clean(F.col(f"item.{f}"), n), lambda f, n: clean(F.col(f"doc.{f}"), n)
    both = [F.coalesce(item(f, n), doc(f, n)).alias(f) for f, n in (("vendor", 80), ("product", 80), ("domain", 80), ("version", 40))]
    kind = F.coalesce(item("document_type", 40), doc("document_type", 40), document_type(F.col(name), F.col("heading"))).alias("document_type")
    return df.select("doc_id", "chunk_no", F.coalesce(item("section", 200), F.col("heading")).alias("heading"), F.coalesce(item("chunk_type", 60), F.col("chunk_type")).alias("chunk_type"), kind, *both, F.coalesce(safe_date(F.col("item.date")), safe_date(F.col("doc.document_date"))).alias("date"), F.coalesce(item("operational_context", 120), F.col("section")).alias("operational_context"), F.coalesce(doc("title", 160), F.col(name)).alias("title"))


def document_metadata(meta: DataFrame) -> DataFrame:
    """doc_id with the first non-null vendor, product, domain, version and date of its chunks, in chunk order."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("chunk_no"))).alias(c)
    return meta.groupBy("doc_id").agg(*[first(c) for c in ("vendor", "product", "domain", "version", "date")])
