"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Texts are folded first: lower case, one form for look-alike letters of other scripts, accents off, digits and signs that
stand for letters read as letters, invisible characters out. `1`, `l` and `i` become one letter, on both sides alike.

The lexicon is learned from labelled rows: beginnings of words and whole words whose documents are mostly labelled toxic,
and more often than chance explains, each weighted by its log odds. Then each neighbourhood of a term counts once, so that
words of a text with many near copies do not pass for terms. Exception phrases are words, or words with their neighbour,
in which a term of the lexicon says nothing: their documents are no more often toxic than others. The automaton finds
terms and exceptions in one pass; what an exception covers does not count. The weights found are summed, divided by the
number of words, and turned into a probability by a step function that never falls, fitted to the same labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, held, settle, small_batches

#: Letters of other scripts that look like these.
LOOKALIKES = {
    "a": "аαａɑ", "b": "ЬвВβ", "c": "сϲⅽ", "d": "ԁⅾɗ", "e": "еєεҽ", "g": "ɡց", "h": "һнН", "i": "іιӏı", "j": "јϳ", "k": "кκ",
    "m": "мМ", "n": "пηո", "o": "оοσօ", "p": "рρ", "q": "ԛ", "r": "гѓ", "s": "ѕꜱ", "t": "тτ", "u": "υսц", "v": "ѵν", "w": "ԝωш", "x": "хχ", "y": "уγ", "z": "ᴢ",
}
#: Digits and signs read as letters. l becomes i, as 1 and | may stand for both.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "l": "i"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
#: Code points below this are folded by the table; later ones only by their own lower case.
TABLED = 0x3000
_SIGN = re.compile(r"(?<=\w)[@$!|]+(?=\w)|(?<!\S)[@$!|](?=\w)")


@cache
def fold_table() -> dict[int, str]:
    """What each character becomes: a letter, a blank between words, or nothing if it is invisible."""
    special = {c: k for k, cs in LOOKALIKES.items() for c in cs} | SUBSTITUTES
    table = {}
    for i in range(TABLED):
        c = chr(i)
        base = "".join(x for x in unicodedata.normalize("NFKD", special.get(c, c)) if not unicodedata.combining(x)).lower()
        base = "".join(special.get(x, x) for x in base)
        invisible = unicodedata.combining(c) or unicodedata.category(c) == "Cf"
        out = "" if invisible else base if base and all(x.isalnum() for x in base) else " "
        if out != c:
            table[i] = out
    for i in range(0xFF01, 0xFF5F):  # wide forms
        table[i] = table.get(i - 0xFEE0, chr(i - 0xFEE0))
    return table


def folded(text: str | None) -> str:
    """The words of a text as it is read here, with one blank before, between and after them; empty without words."""
    if not text:
        return ""
    low = text.lower()
    if any(s in low for s in SIGNS):
        low = _SIGN.sub(lambda m: "".join(SIGNS[c] for c in m[0]), low)
    words = low.translate(fold_table()).split()
    return f" {' '.join(words)} " if words else ""


def patterns(text: str, least: int = 3, most: int = 8) -> set[str]:
    """Of a folded text: every word between blanks, and its beginnings after a blank."""
    out = set()
    for w in set(text.split()):
        out.add(f" {w} ")
        for k in range(least, min(most, len(w)) + 1):
            out.add(f" {w[:k]}")
    return out


@dataclass
class Lexicon:
    """What was learned: weights of terms (beginnings or whole words), exceptions, and the steps of the score."""

    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    edges: list[float] = field(default_factory=list)  # densities, rising
    levels: list[float] = field(default_factory=list)  # the probability at each edge, never falling
    without: float = 0.0  # the probability of a text in which nothing is found

    def automaton(self):
        import ahocorasick

        auto = ahocorasick.Automaton()
        for term in self.exceptions - set(self.weights):
            auto.add_word(term, (len(term), 0.0, True))
        for term, weight in self.weights.items():
            auto.add_word(term, (len(term), weight, term in self.exceptions))
        if len(auto):
            auto.make_automaton()
        return auto

    def probability(self, density: float) -> float:
        """Between two edges on a straight line."""
        if density <= 0 or not self.edges:
            return self.without
        i = bisect_left(self.edges, density)
        if i == 0 or i == len(self.edges):
            return self.levels[min(i, len(self.edges) - 1)]
        a, b = self.edges[i - 1], self.edges[i]
        return self.levels[i - 1] + (density - a) / (b - a) * (self.levels[i] - self.levels[i - 1])


def hits(auto, text: str) -> dict[int, float]:
    """Where words with a term begin in a folded text, with the greatest weight of a term there; without what exceptions cover."""
    found: dict[int, float] = {}
    if not text or not len(auto):
        return found
    covered = []
    for end, (n, weight, exception) in auto.iter(text):
        at = end - n + 1
        if exception:
            covered.append((at, end))
        elif weight > found.get(at, 0.0):
            found[at] = weight
    for a, b in covered:
        for at in [x for x in found if a <= x < b]:
            del found[at]
    return found


def surroundings(text: str, at: int) -> tuple[str, str, str]:
    """Of the word that begins after the blank at `at`: the word before it, itself, the word after it (empty at the ends)."""
    end = text.index(" ", at + 1)
    before, after = text.rfind(" ", 0, at) if at else -1, text.find(" ", end + 1)
    return text[before + 1 : at] if before >= 0 else "", text[at + 1 : end], text[end + 1 : after] if after > 0 else ""


def phrases(auto, text: str) -> set[str]:
    """The words with a term, alone and with the word before or after them."""
    out = set()
    for at in hits(auto, text):
        a, w, b = surroundings(text, at)
        out |= {f" {w} "} | ({f" {a} {w} "} if a else set()) | ({f" {w} {b} "} if b else set())
    return out


def neighbourhoods(auto, text: str) -> set[str]:
    """Every term that is found, with the words before and after it: term, word, word, parted by tabs."""
    out = set()
    if text and len(auto):
        for end, (n, _, _) in auto.iter(text):
            a, _, b = surroundings(text, end - n + 1)
            out.add(f"{text[end - n + 1 : end + 1]}\t{a}\t{b}")
    return out


def density(auto, text: str) -> float:
    """Weights found a word."""
    return sum(hits(auto, text).values()) / (text.count(" ") - 1) if text else 0.0


def _counted(rows: DataFrame, found) -> DataFrame:
    """rows (text, toxic) -> pattern, toxic, clean: documents of each class that hold what `found` gives of a folded text. Summed within each batch first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by = (Counter(), Counter())
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by[toxic].update(found(folded(text)))
            keys = list(by[0].keys() | by[1].keys())
            for a in range(0, len(keys), 50_000):
                some = keys[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([by[1][k] for k in some], pa.int64()), pa.array([by[0][k] for k in some], pa.int64())], names=["pattern", "toxic", "clean"])

    each = rows.select("text", "toxic").mapInArrow(count, "pattern string, toxic long, clean long")
    return each.groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def steps(counts: list[tuple[float, int, int]], prior: float) -> tuple[list[float], list[float]]:
    """(density, toxic, clean), rising -> edges and levels of the closest step function that never falls (pooled neighbours)."""
    pools: list[list] = []
    for x, a, b in counts:
        pools.append([a, a + b, [x]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a2, n2, xs = pools.pop()
            pools[-1][0] += a2
            pools[-1][1] += n2
            pools[-1][2] += xs
    edges, levels = [], []
    for a, n, xs in pools:  # one more row at the prior keeps levels off 0 and 1
        edges += xs
        levels += [max((a + prior) / (n + 1.0), levels[-1] if levels else 0.0)] * len(xs)
    return edges, levels


def _best(counts: DataFrame, n1: int, n0: int, chance: float, most: int) -> DataFrame:
    """pattern, odds of those that are toxic rather than not, and by more than chance; `most` rows at most."""
    a, b, p = F.col("toxic"), F.col("clean"), (n1 + 0.5) / (n1 + n0 + 1.0)
    ratio = 2 * (a * F.log(a / ((a + b) * p)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - p)))).otherwise(0.0))
    rated = counts.where(a > b).select("pattern", F.log((a + 0.5) / (b + 0.5) * F.lit((n0 + 0.5) / (n1 + 0.5))).alias("odds"), ratio.alias("ratio"))
    return rated.where(F.col("ratio") > chance).orderBy(F.desc("ratio"), "pattern").limit(most)


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 60_000, terms: int = 20_000, chance: float = 28.0, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learn from the rows of df whose id is labelled, of at most `sample` labelled ids (those with the smallest hashes).

    Of labels that share an id the largest counts; labels that are null, or of no row, say nothing. A term is kept if
    more of its documents are toxic than not and its log-likelihood ratio is over `chance` (28: one in ten million by
    chance); the `terms` best are. Exceptions are learned too, and `exceptions` (as plain phrases) are added. Without labels of both kinds nothing is found in any text.
    """
    small_batches(df.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id__")).agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("toxic"))
    # At most `sample` ids and labels: bounded, so they may be sent to every executor.
    known = settle(known.orderBy(F.xxhash64(F.lit("toxic"), "id__"), "id__").limit(sample), "toxic-labels")
    rows = settle(df.select(F.col(id_col).alias("id__"), F.col(text_col).alias("text")).join(F.broadcast(known), "id__").select("text", "toxic"), "toxic-texts")
    n1, n = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    n0 = n - n1
    prior = (n1 + 0.5) / (n + 1.0) if n else 0.0
    out = Lexicon({}, {f" {' '.join(folded(p).split())} " for p in exceptions if folded(p)}, without=prior)
    if not n0 or not n1:
        return out
    plain = Lexicon({r.pattern: float(r.odds) for r in _best(_counted(rows, patterns), n1, n0, chance, terms).collect()}).automaton()
    around = _counted(rows, lambda t: neighbourhoods(plain, t)).select(F.split_part("pattern", F.lit("\t"), F.lit(1)).alias("pattern"), F.signum("toxic").alias("toxic"), F.signum("clean").alias("clean"))
    each = around.groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    out.weights = {r.pattern: float(r.odds) for r in _best(each, n1, n0, chance, terms).collect()}
    known_terms = Lexicon(out.weights).automaton()
    usual = (F.col("toxic") <= F.lit(prior) * (F.col("toxic") + F.col("clean"))) & (F.col("clean") >= 3)
    seen = _counted(rows, lambda t: phrases(known_terms, t)).where(usual)
    out.exceptions |= {r.pattern for r in seen.orderBy(F.desc("clean"), "pattern").limit(terms).collect()}
    auto = out.automaton()

    def binned(text: str) -> list[str]:  # eighths of an octave: some hundred bins, whatever the rows
        d = density(auto, text)
        return [str(round(8 * math.log2(d)))] if d > 0 else ["none"]

    bins = {r.pattern: (r.toxic, r.clean) for r in _counted(rows, binned).collect()}
    a, b = bins.pop("none", (0, 0))
    out.without = (a + prior) / (a + b + 1.0)
    out.edges, out.levels = steps([(2.0 ** (int(k) / 8), *bins[k]) for k in sorted(bins, key=int)], prior)
    return out


def toxicity(df: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """df plus score (0 to 1), predicted (1 from 0.5 on), n_words, n_hits, weight (the sum of what was found).

    Only the whole text is read. A null or empty text has no words and gets the score of texts in which nothing is found.
    Columns of these names in df are replaced; all others, nulls and repeated rows stay.
    """
    small_batches(df.sparkSession)
    added = {"score": "double", "predicted": "int", "n_words": "long", "n_hits": "long", "weight": "double"}
    src = df.select(*[c for c in df.columns if c not in added or c == text_col])
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name not in added], *[f"{k} {v}" for k, v in added.items()]])
    names, text_at = src.columns, src.columns.index(text_col)
    kept = [i for i, c in enumerate(names) if c not in added]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = held(("toxicity", tuple(lexicon.weights.items()), tuple(sorted(lexicon.exceptions))), lexicon.automaton)
        for b in batches:
            values = []
            for text in b.column(text_at).to_pylist():
                t = folded(text)
                found, words = hits(auto, t), max(0, t.count(" ") - 1)
                weight = sum(found.values())
                values.append((lexicon.probability(weight / words if words else 0.0), words, len(found), weight))
            p, words, n, w = zip(*values) if values else ((), (), (), ())
            new = [pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array(words, pa.int64()), pa.array(n, pa.int64()), pa.array(w, pa.float64())]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], *new], names=[*[names[i] for i in kept], *added])

    return src.mapInArrow(score, schema)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = fold(F.col("doc_id"), 5) == 0
    lexicon = learn(docs.where(~held_out), labels.where(~held_out))
    return toxicity(docs.select("doc_id", held_out.alias("held_out"), "text"), lexicon).drop("text").select("doc_id", "held_out", "score", "predicted", "n_words", "n_hits", "weight")
