"""What the findings of the third round found."""

import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.functions.text import tokens
from lodestone.operators import enrich, index, retrieve, search, store
from lodestone.sources.versioned import TableSet, shared_folder


@pytest.fixture
def small(spark, tmp_path):
    """save(name, rows, schema) writes a table of a test's own; equal(query) holds a query against its SQL over them."""
    con = duckdb.connect()

    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")

    def equal(query):
        got, want = catalog.QUERIES[query](spark, str(tmp_path)), con.sql(catalog.ORACLES[query])
        columns = sorted(got.columns)
        rows = lambda xs: sorted(str([f"{x:.9f}" if isinstance(x, float) else x for x in r]) for r in xs)
        found = rows(got.select(columns).collect())
        assert found == rows(want.select(*columns).fetchall())
        return found

    return save, equal


def test_signals_of_shared_ids(small):
    save, equal = small
    save("benchmark", [(0, "why compare this")], "item_id long, text string")
    save("conversations", [(10_000, t, "user", q) for t, q in enumerate(["compare a and b", None, "why is it because", "what if"])] + [(7, 0, "user", "assess")] * 3, "conv_id long, turn long, role string, text string")
    save("pages", [(i, f"http://x/{i}", "") for i in range(3)], "page_id long, url string, html string")
    assert len(equal("complexity_signals")) == 6  # turns 0 to 2 of session 10,000 and pages 0 to 2 share their ids


def test_names_of_an_owner_are_ranked_once(spark):
    names = spark.createDataFrame([(i, "a" if i % 2 else "b", ["red ring", "red rings", "blue bolt", None][i % 4]) for i in range(40)], "query_id long, owner_id string, name string")
    recent = names.where("query_id >= 20").selectExpr("owner_id", "query_id as chunk_id", "name as other")
    alike = spark.createDataFrame([("red ring", "red ring", 1.0), ("red rings", "red rings", 1.0), ("blue bolt", "blue bolt", 1.0)], "name string, other string, score double")
    out = store.version_candidates(names, recent, alike, top=3)
    want = {(q, c, n + 1) for q in range(40) if q % 4 != 3 for n, c in enumerate([c for c in range(20, 40) if c % 4 == q % 4][:3])}
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in out.collect()} == want
    assert "Window" not in out._jdf.queryExecution().toString()  # ranks come with the names, no row of names is ranked


def test_a_reply_is_parsed_once(spark):
    replies = {1: '{"chunks": [{"chunk_index": 1, "v": "old"}, {"chunk_index": 1, "v": "new"}, {"chunk_index": 9}, {"chunk_index": "x"}, 3]}', 2: '{"chunks": []}', 3: "no", 4: None}
    rows = spark.createDataFrame([(d, i, str(d)) for d in replies for i in (1, 2)], "document_id long, chunk_index int, text string")
    call = lambda d, items: F.element_at(F.create_map(*[F.lit(x) for d, r in replies.items() for x in (d, r)]), d.cast("int"))
    told = enrich._told(enrich.batches(rows), call, "replies")
    got = {r.document_id: r.found for r in told.collect()}
    assert got == {1: {1: '{"chunk_index":1,"v":"new"}'}, 2: None, 3: None, 4: None}
    plan = told._jdf.queryExecution().analyzed().toString()
    assert plan.count("from_json") == 1 and plan.count("get_json_object") == 1


def test_words_are_counted_without_shuffles_by_token_and_chunk(spark, tmp_path):
    spark.createDataFrame([(i, f"word{i % 7} the word{i % 5}") for i in range(5000)], "chunk_id long, content string").write.parquet(str(tmp_path / "c"))
    spark.createDataFrame([(i, f"the word{i}") for i in range(5)], "query_id long, q string").write.parquet(str(tmp_path / "q"))
    c, q = spark.read.parquet(str(tmp_path / "c")), spark.read.parquet(str(tmp_path / "q"))
    asked = q.select("query_id", F.explode(F.split("q", " ")).alias("term"))
    for out in (search.bm25(q, c), search.full_text(asked, c), search.full_text(asked, c, stems=True), search.term_stats(c)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
        assert dealt and not any(d.count("#") > 1 for d in dealt), dealt  # by chunk, by question or by token alone


def test_postings_of_texts_and_phrases_are_not_shuffled(spark, tmp_path):
    texts = ["red ring red", "", None, "the red ring of 10.0.0.1", "ring red", *[f"w{i} the red" for i in range(60)]]
    spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string").write.parquet(str(tmp_path / "c"))
    spark.createDataFrame([(1, "red ring"), (1, "10.0.0.1"), (2, "the red")], "query_id long, term string").write.parquet(str(tmp_path / "q"))
    c, asked = spark.read.parquet(str(tmp_path / "c")), spark.read.parquet(str(tmp_path / "q"))
    postings = index.positional(c)
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()
    got = {(r.chunk_id, r.token): (r.dl, r.tf, r.positions) for r in postings.collect()}
    words = {i: re.findall(r"\w+", t or "") for i, t in enumerate(texts)}
    assert got == {(i, w): (len(ws), ws.count(w), [j for j, x in enumerate(ws) if x == w]) for i, ws in words.items() for w in ws}
    out = index.full_text(asked, index.asked_postings(asked.select(F.explode(tokens(F.col("term"))).alias("token")).distinct(), c), k=100)
    assert {(r.query_id, r.chunk_id) for r in out.collect()} == {(1, 0), (1, 3), (2, 3), *[(2, i) for i in range(5, 65)]}
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", out._jdf.queryExecution().executedPlan().toString())
    assert dealt and not any(d.count("#") > 1 for d in dealt), dealt  # pairs of questions and chunks are added up where the chunk is


def test_long_and_many_chunks_are_cut_in_slices(spark, monkeypatch):
    monkeypatch.setattr(index, "TOKENS_AT_ONCE", 5)
    ts = [[], list("abab"), list("abcabcabc"), None, ["z"], list("aab")]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(ts, pa.list_(pa.string()))], names=["chunk_id", "ts"])
    got = {(r["chunk_id"], r["token"]): (r["dl"], r["positions"]) for b in index._cut_all(iter([batch.slice(1), batch.slice(0, 1)])) for r in b.to_pylist()}
    assert got == {(i, w): (len(t), [j for j, x in enumerate(t) if x == w]) for i, t in enumerate(ts) for w in t or []}


def test_stored_index_adds_scores_up_by_chunk(spark):
    stored = index.PostingIndex(TableSet(spark, shared_folder(spark, "test")), buckets=4, spread=1)
    stored.add(spark.createDataFrame([(i, f"f{i % 3}", f"the word{i % 4}" if i % 5 else "") for i in range(40)], "chunk_id long, file_id string, content string"))
    assert {(r.n, round(r.avgdl, 6)) for r in stored.totals().collect()} == {(32, 2.0)}
    asked = spark.createDataFrame([(1, "the word1"), (2, "word3")], "query_id long, q string")
    out = stored.bm25(asked)
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", out._jdf.queryExecution().executedPlan().toString())
    assert any("chunk_id" in d for d in dealt) and not any("query_id" in d and "chunk_id" in d for d in dealt), dealt
    assert {(r.query_id, r.chunk_id) for r in out.where("query_id = 2").collect()} == {(2, i) for i in range(40) if i % 4 == 3 and i % 5}


def test_only_runs_of_the_lengths_asked_for_are_made(spark, monkeypatch):
    low = spark.createDataFrame([(1, "at 10.0.0.1 now"), (2, "at 10.0.0.2"), (3, "a-b")], "chunk_id long, low string")
    made, grams_of = [], search.grams_of
    monkeypatch.setattr(search, "grams_of", lambda text, n: made.append(n) or grams_of(text, n))
    found = lambda *terms: {(r.term, r.chunk_id) for r in search.gram_candidates(spark.createDataFrame([(t,) for t in terms], "term string"), low).collect()}
    assert found("0.0.1", "nowhere") == {("0.0.1", 1)} and set(made) == {3}
    assert found("a-", "-", "10.0.0.2") >= {("a-", 3), ("-", 3), ("10.0.0.2", 2)} and set(made) == {1, 2, 3}
    assert found("") == set() and found("", "b") == {("b", 3)}


def test_asked_postings_keep_columns_and_count_all_chunks(spark):
    c = spark.createDataFrame([(1, "kb", "red red blue"), (2, "log", "green"), (3, "kb", ""), (4, "kb", None)], "chunk_id long, file_type string, content string")
    postings, totals = retrieve.asked_postings(spark.createDataFrame([("red",), ("none",)], "token string"), c, ("file_type",))
    assert [(r.token, r.chunk_id, r.file_type, r.dl, r.tf, r.positions) for r in postings.collect()] == [("red", 1, "kb", 3, 2, [0, 1])]
    assert [tuple(r) for r in totals.collect()] == [(2, 2.0)]
