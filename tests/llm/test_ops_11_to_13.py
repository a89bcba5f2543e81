"""Toxicity, importance resampling and hard negatives against brute force, SQL and held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import op11_toxicity as op11
from lodestone.llm import op12_importance as op12
from lodestone.llm import op13_hard_negatives as op13
from lodestone.llm import catalog

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
DOC = "doc_id long, text string, score string, rank int, n_words string, toxic string"


def docs(spark, texts, ids=None):
    """Texts as documents, with extra columns whose names clash with results."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 3, "y", "z") for i, t in zip(ids, texts)], DOC)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/{sf}/{t}.parquet')")
    got, want = catalog.QUERIES[name](spark, f"/root/testdata/{sf}"), con.sql(catalog.ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(str(tuple(r)) for r in got.select(want.columns).collect()) == sorted(map(str, want.fetchall()))


# -- 11 ---------------------------------------------------------------------------------------------------------------
def test_op11_folding():
    plain = op11.folded("you idiot")
    for odd in ("You IDIOT!", "you 1d10t", "you ïdíôt", "you іdіоt", "you i​d­iot", "you ｉｄｉｏｔ", "you |diot", "you, (idiot)", "you\tidi0t\n"):
        assert op11.folded(odd) == plain, odd
    assert op11.folded("$tup!d @ 5 $$$") == op11.folded("stupid  s")
    assert op11.folded(None) == op11.folded("") == op11.folded(" .,;　 ") == ""
    assert op11.folded("日本 слово") == " 日本 ciobo " or op11.folded("日本 слово").startswith(" 日本 ")


def brute_hits(weights, exceptions, text):
    covered, found = [], {}
    for term in {*weights, *exceptions}:
        at = text.find(term)
        while at >= 0:
            if term in exceptions:
                covered.append((at, at + len(term) - 1))
            elif weights[term] > found.get(at, 0):
                found[at] = weights[term]
            at = text.find(term, at + 1)
    return {k: v for k, v in found.items() if not any(a <= k < b for a, b in covered)}


def test_op11_automaton_finds_what_a_search_finds():
    rng = random.Random(3)
    words = ["ab", "abc", "abd", "ba", "bab", "c", "abcab"]
    weights = {" ab": 1.0, " abc ": 2.5, " ba": 0.5, " c ": 3.0}
    exceptions = {" ba c ", " abd ", " abc bab "}
    auto = op11.Lexicon(weights, exceptions).automaton()
    for _ in range(300):
        text = op11.folded(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))))
        assert op11.hits(auto, text) == brute_hits(weights, exceptions, text)


def test_op11_learns_terms_exceptions_and_length(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeioubdgmprt") for _ in range(6)) for _ in range(400)]
    texts, toxic = [], []
    for i in range(600):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zorgon", "zorgonest", "Z0RG0N", "vexx"]))
        elif i % 6 < 2:  # the same word says nothing here
            words.insert(rng.randrange(len(words)), "zorgonite" if i % 2 else "polite vexx")
        texts.append(" ".join(words))
        toxic.append(int(bad))
    labels = spark.createDataFrame([(i, t, 1) for i, t in enumerate(toxic)] + [(0, None, 1), (None, 1, 1), (9999, 1, 1)], "doc_id long, toxic int, n_words int")
    lexicon = op11.learn(docs(spark, texts), labels)
    assert " zorgon" in lexicon.weights and " zorgonite " in lexicon.exceptions and " poiite vexx " in lexicon.exceptions
    assert all(a <= b for a, b in zip(lexicon.levels, lexicon.levels[1:]))
    new = ["vexx zorgon " + " ".join(vocabulary[:20]), " ".join(vocabulary[:30]), "polite vexx " + " ".join(vocabulary[:20]), "zorgonite here", None, "", "vexx " + " ".join(vocabulary * 200), "ѵеxx zorg0nia " + " ".join(vocabulary[:20])]
    got = {r.doc_id: r for r in op11.toxicity(docs(spark, new), lexicon).collect()}
    assert [got[i].predicted for i in range(8)] == [1, 0, 0, 0, 0, 0, 0, 1]
    assert got[4].score == got[5].score == got[1].score and 0 <= got[4].score < 0.1 and got[4].n_words == 0
    assert got[0].rank == 3 and isinstance(got[0].score, float) and got[6].n_words == 80001
    assert got[6].n_hits == 1 and got[6].score < got[0].score  # normalised by length


def test_op11_copies_of_one_text_make_no_terms(spark):
    texts = ["some quite unusual sentence about marmots and gravel"] * 60 + [f"word{i} other{i * 7} thing{i * 3}" for i in range(200)]
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(260)], "doc_id long, toxic int")
    assert op11.learn(docs(spark, texts), labels).weights == {}


def test_op11_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = op11.learn(docs(spark, ["a b"]), none, exceptions=("Idiot proof",))
    assert lexicon.weights == {} and lexicon.exceptions == {" idiot proof "}
    rows = op11.toxicity(docs(spark, ["a b", "a b", None], [1, 1, None]), lexicon).collect()
    assert len(rows) == 3 and {r.predicted for r in rows} == {0}
    assert op11.toxicity(docs(spark, []), lexicon).count() == 0
    one_kind = spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    assert op11.learn(docs(spark, ["a b"]), one_kind).weights == {}


def test_op11_held_out(spark):
    got = catalog.QUERIES["op11_toxicity"](spark, LARGER)
    assert got.count() == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    labelled = got.where("held_out").join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = Counter({(r.toxic, r.predicted): r["count"] for r in labelled})
    assert n[1, 1] >= 0.9 * (n[1, 1] + n[1, 0]) and n[0, 1] <= 0.01 * (n[0, 0] + n[0, 1])
    assert got.where("score < 0 or score > 1 or score is null or predicted != int(score >= 0.5)").count() == 0


# -- 12 ---------------------------------------------------------------------------------------------------------------
def brute_resample(rows, target, percent=25, least=20, buckets=10_000):
    def features(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return w, [zlib.crc32(x.encode()) % buckets for x in [*w, *[f"{a} {b}" for a, b in zip(w, w[1:])]]]

    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(features(x)[1])
    for x in target:
        t.update(features(x)[1])
    big, wanted = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big + buckets) / ((s[b] + 1) * (wanted + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        w, f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    may = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): n + 1 for n, r in enumerate(may[: percent * len(may) // 100])}
    return Counter((*r[:4], rank.get(id(r))) for r in out)


def test_op12_equals_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeÀßñ日0") for _ in range(rng.randrange(1, 6))) for _ in range(80)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    texts += [texts[0]] * 120 + [None, "", "...", "ÄRGER Ärger ärger", "one", " ".join(vocabulary * 500), texts[0].upper()]
    ids = [i if i % 17 else None for i in range(len(texts) - 3)] + [5, 5, 5]
    target = [texts[3], texts[4], None, "a b c"]
    got = op12.resample(docs(spark, texts, ids), docs(spark, target)).collect()
    want = brute_resample(list(zip(ids, texts)), target)
    assert Counter(tuple(r) for r in got if r.doc_id is not None) == Counter({k: v for k, v in want.items() if k[0] is not None})
    assert Counter(tuple(r) for r in got) == want


def test_op12_copies_are_read_once(spark):
    texts = ["the same text again"] * 40 + ["another text"]
    assert op12.collapsed(docs(spark, texts)).count() == 2
    once = op12.bucket_counts(op12.collapsed(docs(spark, texts)), 2, 100)
    assert sum(once.values()) == 40 * 7 + 3


def test_op12_ranks_in_many_ranges(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("score"))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = op12.ranked(rows, 1000, [F.desc("score"), F.asc("doc_id")]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    want = sorted(got, key=lambda r: (-r.score, r.doc_id))
    assert [r["rank"] for r in want] == [*range(1, 1001)] + [None] * 2000


def test_op12_odd_tables(spark):
    none = docs(spark, [])
    assert op12.resample(none, none).count() == 0
    got = op12.resample(docs(spark, ["a " * 30] * 5), none).collect()
    assert sorted(str(r["rank"]) for r in got) == ["1", "None", "None", "None", "None"]
    assert {r.weight for r in got} == {got[0].weight}


# -- 13 ---------------------------------------------------------------------------------------------------------------
def brute_negatives(rows, every, positives=5, negatives=10):
    good = {}
    for i, v, lab in rows:
        if i is None or lab is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = (lab, [math.floor(256 * float(np.float32(x))) for x in v])
        good[i] = min(good.get(i, own), own)
    out = []
    for a, (lab, v) in good.items():
        if a % every:
            continue
        score = {b: sum(x * y for x, y in zip(v, w)) for b, (_, w) in good.items() if b != a and len(w) == len(v)}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if good[b][0] == lab][:positives]:
            may = [b for b in order if good[b][0] != lab and 30 * score[p] <= 100 * score[b] <= 90 * score[p]]
            out += [(a, p, n + 1, b, score[p], score[b]) for n, b in enumerate(may[:negatives])]
    return sorted(out)


VEC = "vec_id long, embedding array<float>, label int, rank string, positive_id int, i int, d int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1, 2, 3) for i, v, lab in rows], VEC)


@pytest.mark.parametrize("sizes", [(4, 9, 3), (512, 4096, 32), (1, 50, 64)])
def test_op13_equals_brute_force(spark, sizes):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=10).tolist(), int(rng.integers(0, 4)) if i % 3 else 1) for i in range(160)]
    rows += [(200 + i, rows[20][1], i % 2) for i in range(12)]  # ties
    rows += [(10, rng.normal(size=10).tolist(), 1), (10, [0.5] * 10, 0)]  # repeated ids
    rows += [(301, None, 1), (302, [], 1), (303, [None] * 10, 1), (304, [float("nan")] + [0.0] * 9, 2), (305, [float("inf")] * 10, 2), (310, [1.0] * 10, None), (None, [1.0] * 10, 1)]
    rows += [(320, [0.0] * 10, 1), (330, [1.0, 2.0], 1), (331, [2.0, 1.0], 1), (332, [1.0, 0.5], 2), (340, [3e38] + [0.0] * 9, 1)]
    got = op13.hard_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0, anchor_block=sizes[0], row_block=sizes[1], chunk=sizes[2])
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute_negatives([r for r in rows if r[0] != 340], 10)


def test_op13_products_are_exact():
    rng = np.random.default_rng(2)
    for size in (10, 2**20, 2**28):
        a, b = rng.integers(-size, size, (5, 33)), rng.integers(-size, size, (7, 33))
        assert op13.product(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]


def test_op13_odd_tables(spark):
    assert op13.hard_negatives(vectors(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    one = vectors(spark, [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)])
    assert op13.hard_negatives(one, F.col("vec_id") % 10 == 0).count() == 0  # no other label
    assert op13.hard_negatives(one, F.col("vec_id") % 10 == 5).count() == 0  # no anchor
