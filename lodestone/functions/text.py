"""Column functions on text. Tokens are runs of Unicode letters, digits and underscores, the same in Spark and DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-case tokens in order; empty for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends, line ends and tabs too (Spark's trim takes off blanks only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once a row, also where body uses it inside another lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def terms(text: Column, stop: tuple[str, ...], longer_than: int = 2) -> Column:
    """Distinct tokens of more than `longer_than` characters that are not stop words."""
    long = F.filter(tokens(text), lambda t: F.length(t) > longer_than)
    return F.array_except(F.array_distinct(long), F.array(*[F.lit(w) for w in stop]))


def share_contained(words: Column, text: Column, none: Column) -> Column:
    """The share of words that are substrings of the lower-case text; `none` where there are no words."""
    def share(low: Column) -> Column:
        return let(words, lambda ws: F.when(F.size(ws) == 0, none).otherwise(F.size(F.filter(ws, lambda w: F.contains(low, w))) / F.size(ws)))

    return let(F.lower(F.coalesce(text, F.lit(""))), share)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def truncate(text: Column, limit: Column, share: float = 0.7) -> Column:
    """At most `limit` characters, back to the last line break if that lies beyond `share` of it, plus a marker."""
    cut = F.substring(text, F.lit(1), limit)
    last = F.length(cut) - F.instr(F.reverse(cut), "\n")  # from 0; length(cut) where there is none
    at_line = F.contains(cut, F.lit("\n")) & (last > limit * share)
    body = F.when(at_line, F.substring(cut, F.lit(1), last)).otherwise(cut)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(body, F.lit("\n[... truncated ...]")))


def normalize_filename(name: Column) -> Column:
    """The name without extension, version marks and draft words, in lower case with single dashes."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    stem = F.regexp_replace(low, r"^(.*/)?([^/]+?)(\.[^./]*)?$", "$2")
    stem = F.regexp_replace(stem, r"\bv(?:ersion)?[\s._-]*[0-9]+(?:\.[0-9]+)?\b", "")
    stem = F.regexp_replace(stem, r"\b(final|draft|copy|rev|revision)\b", "")
    return F.regexp_replace(F.regexp_replace(stem, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def version_rank(label: Column) -> Column:
    """The first number in a label, else 0."""
    return F.coalesce(F.regexp_extract(label, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))


def safe_date(value: Column) -> Column:
    """yyyy-MM-dd from a full date, a month, a year (not checked) or the start of a timestamp; null for all else."""
    v = F.trim(value)
    day = lambda c: F.when(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull(), c)
    return (
        F.when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), day(v))
        .when(v.rlike(r"^[0-9]{4}-[0-9]{2}$"), day(F.concat(v, F.lit("-01"))))
        .when(v.rlike(r"^[0-9]{4}$"), F.concat(v, F.lit("-01-01")))
        .when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), day(F.substring(v, 1, 10)))
    )


def document_type(filename: Column, title: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(filename, F.lit("")), F.coalesce(title, F.lit(""))))
    has = lambda s: F.contains(text, F.lit(s))
    return F.when(has("runbook"), "Runbook").when(has("sop") | has("standard operating procedure"), "SOP").when(has("kb") | has("knowledge base"), "KB").when(has("vendor"), "Vendor doc").otherwise("Unknown")


def clean(text: Column, limit: int) -> Column:
    """White space runs to one blank, trimmed, cut at `limit`; null where nothing is left."""
    return F.nullif(F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit), F.lit(""))


def distinct_ignoring_case(items: Column, most: int) -> Column:
    """The first of each spelling, in order, at most `most`."""
    trimmed = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    low = F.transform(trimmed, lambda x: F.lower(x))
    return F.transform(F.slice(F.array_distinct(low), 1, most), lambda x: F.element_at(trimmed, F.array_position(low, x).cast("int")))


def distinct_entities(items: Column, most: int = 5) -> Column:
    """array<struct<text, label>>: cleaned, labels in upper case, the first of each (text ignoring case, label), at most `most`."""
    cleaned = F.transform(items, lambda x: F.struct(clean(x["text"], 100).alias("text"), F.upper(clean(x["label"], 40)).alias("label")))
    whole = F.filter(cleaned, lambda x: x["text"].isNotNull() & x["label"].isNotNull())
    key = lambda x: F.struct(F.lower(x["text"]).alias("t"), x["label"].alias("l"))
    first = lambda xs: F.filter(xs, lambda x, i: F.array_position(F.transform(xs, key), key(x)) == i + 1)
    return F.slice(let(whole, first), 1, most)


def title(text: Column, most: int = 60) -> Column:
    """The first `most` characters, with three dots where there are more."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def isoformat(ts: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ss, and six digits of a fraction where there is one."""
    whole = F.date_trunc("second", ts) == ts
    return F.when(whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def quote_url(text: Column) -> Column:
    """Percent-encoded but for letters, digits, `_.-~` and slashes."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unfenced(raw: Column) -> Column:
    """The inside of the last json fence, else of the first fence, else the text itself."""
    part = lambda parts, i: F.get(parts, i)
    tagged, plain = F.split(raw, "```json"), F.split(raw, "```")
    inner = F.when(F.contains(raw, F.lit("```json")), part(F.split(F.element_at(tagged, -1), "```"), F.lit(0))).when(F.contains(raw, F.lit("```")), part(plain, F.lit(1)))
    return F.coalesce(inner, raw)


def grades(raw: Column) -> Column:
    """array<struct<chunk, score>> between the first [ and the last ] of a model's answer; null where there is none."""
    body = unfenced(F.trim(raw))
    a, z = F.instr(body, "["), F.length(body) - F.instr(F.reverse(body), "]") + 1
    found = (a > 0) & (F.instr(body, "]") > 0) & (z > a)
    return F.when(found, F.from_json(F.substring(body, a, z - a + 1), "array<struct<chunk:int,score:double>>"))


#: A whole string, one that is never closed, a brace, or what lies between them: all of a text, piece by piece.
JSON_PIECE = r'(?s)"(?:[^"\\]|\\.)*(?:"|\\?\z)|[{}]|[^"{}]+'


def json_object(raw: Column) -> Column:
    """The first balanced {...} of a text, fences taken off; what follows an unclosed brace, or the text without one. Braces in strings do not count."""
    value = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$", "")
    value = F.when(F.startswith(value, F.lit("```")), F.regexp_replace(F.regexp_replace(value, "```(json)?", ""), r"^\s+|\s+$", "")).otherwise(value)

    def cut(text: Column) -> Column:
        begin = F.substring(text, F.instr(text, "{"), F.length(text))
        state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("stop"))

        def step(s: Column, piece: Column) -> Column:
            at, depth = s["at"] + F.length(piece), s["depth"] + F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
            closed = (piece == "}") & (depth == 0) & (s["stop"] == 0)
            return F.struct(depth.alias("depth"), at.alias("at"), F.when(closed, at).otherwise(s["stop"]).alias("stop"))

        stop = F.aggregate(F.regexp_extract_all(begin, F.lit(JSON_PIECE), F.lit(0)), state, step)["stop"]
        return F.when(~F.contains(text, F.lit("{")), text).otherwise(let(stop, lambda n: F.when(n > 0, F.substring(begin, F.lit(1), n)).otherwise(begin)))

    return let(value, cut)


def json_repaired(raw: Column, stop_reason: Column) -> Column:
    """The JSON of an answer, with missing closers added; null where it stays invalid, or was cut off at its most tokens and is asked for again."""
    many = lambda text, c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    closers = lambda text, a, z: F.repeat(F.lit(z), F.greatest(F.lit(0), many(text, a) - many(text, z)))

    def mend(text: Column) -> Column:
        whole = F.concat(text, closers(text, "{", "}"), closers(text, "[", "]"))
        valid = lambda x: F.try_parse_json(x).isNotNull() & (F.length(x) > 0)
        return F.when(valid(text), text).when(F.coalesce(stop_reason, F.lit("")) == "max_tokens", F.lit(None)).when(valid(whole), whole)

    return let(json_object(raw), mend)


def _longest_block(a: Column, b: Column, seg: Column) -> Column:
    """Of arrays of characters, within seg (al, ah, bl, bh; ends excluded): n, i, j of the longest run that both have; the first in a, then in b, of equal ones."""
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    start = F.struct(F.array().cast("array<int>").alias("row"), none.alias("best"))

    def line(acc: Column, i: Column) -> Column:
        # lengths of the equal runs that end at i and at each place of b; places are told as negatives, so that the greatest is the first
        row = F.transform(F.sequence(seg["bl"], seg["bh"] - 1), lambda j: F.when(F.get(a, i) == F.get(b, j), F.coalesce(F.get(acc["row"], j - seg["bl"] - 1), F.lit(0)) + 1).otherwise(0))
        return let(row, lambda r: F.struct(r.alias("row"), F.greatest(acc["best"], F.array_max(F.transform(r, lambda n, at: F.struct(n.alias("n"), (n - i - 1).alias("i"), (n - seg["bl"] - at - 1).alias("j"))))).alias("best")))

    found = F.aggregate(F.sequence(seg["al"], seg["ah"] - 1), start, line, lambda acc: acc["best"])
    return let(found, lambda f: F.struct(f["n"].alias("n"), F.abs(f["i"]).alias("i"), F.abs(f["j"]).alias("j")))


def matching_characters(a: Column, b: Column) -> Column:
    """Characters in matching blocks of two arrays of characters: the longest common run, then the same to its left and to its right."""
    seg = lambda al, ah, bl, bh: F.struct(al.cast("int").alias("al"), ah.cast("int").alias("ah"), bl.cast("int").alias("bl"), bh.cast("int").alias("bh"))
    start = F.struct(F.array(seg(F.lit(0), F.size(a), F.lit(0), F.size(b))).alias("todo"), F.lit(0).alias("n"))

    def step(acc: Column, _: Column) -> Column:
        def found(top: Column) -> Column:
            def split(f: Column) -> Column:
                left, right = seg(top["al"], f["i"], top["bl"], f["j"]), seg(f["i"] + f["n"], top["ah"], f["j"] + f["n"], top["bh"])
                more = F.filter(F.array(left, right), lambda s: (f["n"] > 0) & (s["al"] < s["ah"]) & (s["bl"] < s["bh"]))
                return F.struct(F.concat(F.slice(acc["todo"], 1, F.size(acc["todo"]) - 1), more).alias("todo"), (acc["n"] + f["n"]).alias("n"))

            return let(_longest_block(a, b, top), split)

        return F.when(F.size(acc["todo"]) == 0, acc).otherwise(let(F.element_at(acc["todo"], -1), found))

    # every search but one at the end of each branch takes a character away
    rounds = F.sequence(F.lit(1), 2 * F.least(F.size(a), F.size(b)) + 1)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.aggregate(rounds, start, step, lambda acc: acc["n"])).otherwise(0)


def name_similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    """Twice the characters in matching blocks over all characters of two names, case and outer blanks ignored; 0 if either is empty, or if it is sure to be below `least`.

    Most pairs are told apart by bounds: the shorter name's length, then the characters that both have, each as often as
    it stands in both. Only what passes is matched.
    """
    chars = lambda c: F.filter(F.split(F.lower(F.trim(F.coalesce(c, F.lit("")))), ""), lambda x: x != "")

    def rated(two: Column) -> Column:
        x, y = two["a"], two["b"]
        share = lambda n: 2.0 * n / (F.size(x) + F.size(y))
        both = F.aggregate(F.array_distinct(x), F.lit(0), lambda n, c: n + F.least(F.size(F.filter(x, lambda k: k == c)), F.size(F.filter(y, lambda k: k == c))))
        empty = (F.size(x) == 0) | (F.size(y) == 0)
        return F.when(empty | (share(F.least(F.size(x), F.size(y))) < least), 0.0).when(share(both) < least, 0.0).otherwise(share(matching_characters(x, y)))

    return let(F.struct(chars(a).alias("a"), chars(b).alias("b")), rated)
