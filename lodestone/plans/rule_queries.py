"""Intent, complexity, routing, validation queries over benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import HALLUCINATION_PHRASES, REFUSAL_PHRASES, STOP_CONFIDENCE, STOP_INTENT, STOP_SENTENCE
from lodestone.operators import rules, validate
from lodestone.plans.registry import query
from lodestone.plans.search_queries import TOKENS, sql_list
from lodestone.sources import readers
from lodestone.sources.tables import EXCHANGES, exchanges, messages, questions, table
from lodestone.sources.versioned import shared_folder


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, q: all benchmark items (negative ids), conversation turns and page urls with their page (from 10 million on)."""
    b = questions(spark, sf_dir).select((-F.col("query_id") - 1).alias("query_id"), "q")
    m = messages(spark, sf_dir).select((F.col("session_id") * 1000 + F.col("turn")).alias("query_id"), F.col("content").alias("q"))
    u = table(spark, sf_dir, "pages").select((F.col("page_id") + 10_000_000).alias("query_id"), F.concat(F.lit("how to fix "), "url", F.lit(" on kubernetes and aws v1.2.3")).alias("q"))
    return b.unionByName(m).unionByName(u)


ASKED = "asked AS (SELECT -item_id - 1 AS query_id, text AS q FROM benchmark UNION ALL SELECT conv_id * 1000 + turn, text FROM conversations UNION ALL SELECT page_id + 10000000, 'how to fix ' || url || ' on kubernetes and aws v1.2.3' FROM pages)"
MATCHES = " || ".join(f"regexp_extract_all(t, {_lit(p)})" for p in rules.KEYWORD_PATTERNS)


def _hits(t: str, patterns: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({t}, {_lit(p)}) AS INTEGER)" for p in patterns) + ")"


INTENT = f"""{ASKED}, i0 AS (SELECT query_id, regexp_replace(coalesce(q, ''), '^[[:space:]]+|[[:space:]]+$', '', 'g') AS t FROM asked),
i1 AS (SELECT query_id, t, {MATCHES} AS m, {_hits("t", rules.SEMANTIC_PATTERNS)} AS sh, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: length(w) > 0)) AS words FROM i0),
i2 AS (SELECT *, words <= 3 AND len(m) = 0 AND sh = 0 AS short FROM i1),
i3 AS (SELECT *, CASE WHEN t = '' THEN 0.5::DOUBLE WHEN short THEN 0.4::DOUBLE ELSE round(least(1.0::DOUBLE, len(m) * 0.25::DOUBLE), 6) END AS kw, CASE WHEN t = '' THEN 0.5::DOUBLE WHEN short THEN 0.4::DOUBLE ELSE round(least(1.0::DOUBLE, sh * 0.3::DOUBLE), 6) END AS sem FROM i2),
intent AS (SELECT *, CASE WHEN t = '' THEN 'mixed' WHEN kw >= 0.6 AND kw > sem THEN 'keyword' WHEN sem >= 0.6 AND sem > kw THEN 'semantic' ELSE 'mixed' END AS strategy,
  list_filter(list_transform(m, lambda x: regexp_replace(regexp_replace(x, '^[[:space:]]+|[[:space:]]+$', '', 'g'), '^"+|"+$', '', 'g')), lambda x: length(x) >= 2) AS exact, list_filter({TOKENS.format("t")}, lambda w: length(w) > 2 AND NOT list_contains({sql_list(STOP_INTENT)}, w)) AS content FROM i3)"""


@query(f"WITH {INTENT} SELECT query_id, kw, sem, strategy FROM intent")
def query_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.query_intent(_asked(spark, sf_dir)).select("query_id", "kw", "sem", "strategy")


@query(f"WITH {INTENT} SELECT query_id, array_to_string((CASE WHEN len(exact) > 0 THEN exact ELSE content END)[1:20], '|') AS terms FROM intent")
def extracted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.query_intent(_asked(spark, sf_dir)).select("query_id", F.array_join("terms", "|").alias("terms"))


@query(f"WITH {ASKED} SELECT query_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(regexp_replace(coalesce(q, ''), '^[[:space:]]+|[[:space:]]+$', '', 'g')), {_lit(rules.VENDORS)}))), '|') AS vendors FROM asked")
def vendor_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.query_intent(_asked(spark, sf_dir)).select("query_id", F.array_join("vendors", "|").alias("vendors"))


SCORE = f"""{ASKED}, x0 AS (SELECT query_id, regexp_replace(coalesce(q, ''), '^[[:space:]]+|[[:space:]]+$', '', 'g') AS t, (abs(query_id) % 11) / 10.0::DOUBLE AS rc, abs(query_id) % 6 AS sources, abs(query_id) % 25 * 1000 AS chars FROM asked),
x1 AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, least(1.0::DOUBLE, {_hits("t", rules.STEP_PATTERNS)} * 0.4::DOUBLE) * 0.30::DOUBLE + least(1.0::DOUBLE, {_hits("t", rules.REASONING_PATTERNS)} * 0.35::DOUBLE) * 0.25::DOUBLE + least(1.0::DOUBLE, chars / 20000.0::DOUBLE) * 0.15::DOUBLE
  + greatest(0.0::DOUBLE, 1.0::DOUBLE - rc) * 0.20::DOUBLE + least(1.0::DOUBLE, greatest(0.0::DOUBLE, (sources - 1) * 0.3::DOUBLE)) * 0.10::DOUBLE - least(0.4::DOUBLE, {_hits("t", rules.SIMPLE_PATTERNS)} * 0.15::DOUBLE))) AS score FROM x0),
cx AS (SELECT *, CASE WHEN round(score, 9) < 0.30 THEN 'simple' WHEN round(score, 9) > 0.70 THEN 'complex' ELSE 'moderate' END AS tier FROM x1)"""


def _complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval confidence, source count and context size are made from the id, so that all ranges occur."""
    k = F.abs("query_id")
    df = _asked(spark, sf_dir).withColumns({"rc": (k % 11) / 10.0, "sources": k % 6, "chars": k % 25 * 1000})
    df = df.withColumn("score", F.round(rules.complexity(F.col("q"), F.col("rc"), F.col("sources"), F.col("chars")), 9))
    return df.withColumn("tier", rules.tier(F.col("score")))


@query(f"WITH {SCORE} SELECT query_id, round(score, 6) AS score, tier FROM cx")
def complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _complexity(spark, sf_dir).select("query_id", F.round("score", 6).alias("score"), "tier")


@query(f"WITH {SCORE} SELECT query_id, CASE WHEN tier = 'complex' THEN 'sonnet' ELSE 'haiku' END AS model FROM cx")
def route_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _complexity(spark, sf_dir).select("query_id", rules.model_for(F.col("tier")).alias("model"))


GATE = f"CASE WHEN tier <> 'complex' THEN 'tier' WHEN score < 0.65 THEN 'score' WHEN {_hits('t', rules.AGENT_PATTERNS)} = 0 THEN 'pattern' WHEN sources < 1 THEN 'sources' ELSE 'escalate' END"


@query(f"WITH {SCORE}, raised AS (SELECT query_id, t, sources, 'complex' AS tier, greatest(score, 0.6 + (abs(query_id) % 3) * 0.1) AS score FROM cx) SELECT query_id, {GATE} AS gate FROM raised")
def agent_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are raised, so that every gate is reached."""
    df = _complexity(spark, sf_dir).withColumn("score", F.greatest("score", 0.6 + (F.abs("query_id") % 3) * 0.1)).withColumn("tier", F.lit("complex"))
    return df.select("query_id", rules.agent_gate(F.trim("q"), F.col("score"), F.col("tier"), F.col("sources")).alias("gate"))


@query("""WITH s AS (SELECT conv_id AS run_id, turn AS seq, CAST(length(text) // 4 AS BIGINT) AS tokens FROM conversations), u AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY run_id ORDER BY seq) AS BIGINT) AS used FROM s)
SELECT run_id, seq, tokens, used, greatest(CAST(0 AS BIGINT), 500 - used) AS remaining, used - tokens < 500 AS ran FROM u""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as steps of a run, with a budget small enough to be used up."""
    steps = messages(spark, sf_dir).select(F.col("session_id").alias("run_id"), F.col("turn").alias("seq"), F.floor(F.length("content") / 4).cast("long").alias("tokens"))
    return rules.token_budget(steps, 500)


def _terms(t: str, stop: tuple[str, ...], longer: int = 2) -> str:
    return f"list_filter(list_distinct({TOKENS.format(t)}), lambda w: length(w) > {longer} AND NOT list_contains({sql_list(stop)}, w))"


def _phrase_hits(t: str, phrases: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({t}), {_lit(p.lower())}) AS INTEGER)" for p in phrases) + ")"


def _share(terms: str, none: str) -> str:
    return f"CASE WHEN len({terms}) = 0 THEN {none} ELSE CAST(len(list_filter({terms}, lambda w: contains(lc, w))) AS DOUBLE) / len({terms}) END"


def _fabricated(kind: str, p: str) -> str:
    found = lambda c: f"list_distinct(regexp_extract_all({c}, {_lit(p)}))"
    return f"list_transform(list_sort(list_filter({found('a')}, lambda x: NOT list_contains({found('ctx')}, x))), lambda x: {_lit(kind + ': ')} || x)"


VALID = f"""v0 AS (SELECT *, lower(ctx) AS lc, trim(coalesce(answer, ''), ' ') AS s, coalesce(answer, '') AS a, {_terms("coalesce(q, '')", STOP_CONFIDENCE)} AS qt, {_terms("coalesce(answer, '')", STOP_CONFIDENCE)} AS ats FROM cases),
v1 AS (SELECT *, least(0.4::DOUBLE, {_phrase_hits("s", HALLUCINATION_PHRASES)} * 0.15::DOUBLE) AS said, CASE WHEN {_phrase_hits("s", REFUSAL_PHRASES)} > 0 THEN 0.5::DOUBLE WHEN s = '' THEN 0.0::DOUBLE WHEN length(s) < 20 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS base,
  least(1.0::DOUBLE, top_score * 20) AS retrieval, {_share("qt", "1.0::DOUBLE")} AS coverage, CASE WHEN ctx = '' THEN 0.0::DOUBLE ELSE {_share("ats", "0.0::DOUBLE")} END AS term_grounding,
  list_filter(list_transform(regexp_split_to_array(a, '[.!?\\n]'), lambda x: trim(x, ' ')), lambda x: length(x) > 15) AS sentences FROM v0),
v2 AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, base - said)) AS consistency, said + CASE WHEN superseded THEN 0.20::DOUBLE ELSE 0.0::DOUBLE END AS penalty,
  list_concat(list_concat({_fabricated("URL", validate.SPECIFICS["URL"])}, {_fabricated("email", validate.SPECIFICS["email"])}), {_fabricated("phone number", validate.SPECIFICS["phone number"])}) AS fabricated,
  CASE WHEN len(sentences) = 0 THEN 1.0::DOUBLE ELSE CAST(len(list_filter(sentences, lambda x: len({_terms("x", STOP_SENTENCE, 3)}) = 0 OR CAST(len(list_filter({_terms("x", STOP_SENTENCE, 3)}, lambda w: contains(lc, w))) AS DOUBLE) / greatest(len({_terms("x", STOP_SENTENCE, 3)}), 1) >= 0.40)) AS DOUBLE) / len(sentences) END AS grounding FROM v1),
v3 AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, retrieval * 0.30::DOUBLE + coverage * 0.25::DOUBLE + term_grounding * 0.25::DOUBLE + consistency * 0.20::DOUBLE - penalty)) AS confidence FROM v2),
v4 AS (SELECT *, CASE WHEN confidence >= 0.35 AND len(fabricated) = 0 AND grounding >= 0.25 THEN 'pass' WHEN len(fabricated) > 0 THEN 'fabricated' WHEN confidence < 0.35 THEN 'low_confidence' ELSE 'low_grounding' END AS verdict FROM v3)"""
CASES = f"{EXCHANGES}, cases AS (SELECT case_id, q, answer, ctx, (case_id % 7) / 100.0::DOUBLE AS top_score, case_id % 5 = 0 AS superseded FROM exchanges)"


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top score and superseded state are made from the id, so that all ranges occur."""
    return exchanges(spark, sf_dir).withColumns({"top_score": (F.col("case_id") % 7) / 100.0, "superseded": F.col("case_id") % 5 == 0})


@query(f"WITH {CASES}, {VALID} SELECT case_id, round(retrieval, 6) AS retrieval, round(coverage, 6) AS coverage, round(term_grounding, 6) AS term_grounding, round(consistency, 6) AS consistency, round(penalty, 6) AS penalty, round(confidence, 6) AS confidence FROM v3")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = validate.with_confidence(_cases(spark, sf_dir))
    return df.select("case_id", *[F.round(c, 6).alias(c) for c in ("retrieval", "coverage", "term_grounding", "consistency", "penalty", "confidence")])


SPECIFIC_CASES = "cases AS (SELECT d.doc_id AS case_id, '' AS q, d.text AS answer, coalesce(p.html, '') || ' ' || coalesce(p.url, '') AS ctx, 0.0::DOUBLE AS top_score, false AS superseded FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id)"


@query(f"WITH {SPECIFIC_CASES}, f AS (SELECT case_id, answer AS a, ctx FROM cases), g AS (SELECT case_id, list_concat(list_concat({_fabricated('URL', validate.SPECIFICS['URL'])}, {_fabricated('email', validate.SPECIFICS['email'])}), {_fabricated('phone number', validate.SPECIFICS['phone number'])}) AS f FROM f) SELECT case_id, CAST(len(f) AS INTEGER) AS n, array_to_string(f, ', ') AS fabricated FROM g")
def fabrications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an answer, the page of its id as the context."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.col("text").alias("answer"))
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("case_id"), F.concat("html", F.lit(" "), "url").alias("ctx"))
    f = validate.fabrications(F.col("answer"), F.col("ctx"))
    return d.join(p, "case_id", "left").withColumn("f", f).select("case_id", F.size("f").alias("n"), F.array_join("f", ", ").alias("fabricated"))


@query(f"WITH {CASES}, {VALID} SELECT case_id, round(grounding, 6) AS grounding FROM v3")
def sentence_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir).select("case_id", F.round(validate.sentence_grounding(F.col("answer"), F.col("ctx")), 6).alias("grounding"))


@query(f"WITH {CASES}, {VALID} SELECT case_id, verdict, verdict = 'pass' AS passed, round(confidence * CASE verdict WHEN 'fabricated' THEN 0.5::DOUBLE WHEN 'low_grounding' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END, 6) AS final_confidence FROM v4")
def validation_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate(_cases(spark, sf_dir)).select("case_id", "verdict", "passed", F.round("final_confidence", 6).alias("final_confidence"))


#: Every exchange as a case; what is expected of it is made from its id.
SUITE = f"{EXCHANGES}, cases AS (SELECT case_id, q, answer, ctx, case_id % 3 <> 0 AS expected_pass, CASE WHEN case_id % 3 = 0 AND case_id % 4 = 0 THEN 'grounding' ELSE '' END AS expected_issue, 0.0::DOUBLE AS top_score, false AS superseded FROM exchanges)"
CORRECT = "(verdict = 'pass') = expected_pass AND (expected_issue = '' OR contains(concat_ws('; ', CASE WHEN len(fabricated) > 0 THEN 'fabricated specifics' END, CASE WHEN grounding < 0.25 THEN 'grounding below threshold' END), expected_issue))"


@query(f"WITH {SUITE}, {VALID} SELECT case_id, round(confidence, 6) AS confidence, round(grounding, 6) AS grounding, verdict = 'pass' AS passed, expected_pass, {CORRECT} AS correct FROM v4")
def eval_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suite(spark, sf_dir).select("case_id", F.round("confidence", 6).alias("confidence"), F.round("grounding", 6).alias("grounding"), "passed", "expected_pass", "correct")


def _suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("case_id")
    cases = exchanges(spark, sf_dir).withColumns({"expected_pass": k % 3 != 0, "expected_issue": F.when((k % 3 == 0) & (k % 4 == 0), "grounding").otherwise("")})
    return validate.run_suite(cases)


@query(f"WITH {SUITE}, {VALID} SELECT CAST(count(*) AS BIGINT) AS cases, CAST(sum(CAST({CORRECT} AS INTEGER)) AS BIGINT) AS correct, round(avg(CAST({CORRECT} AS INTEGER)), 6) AS accuracy, CAST(count(*) FILTER (WHERE case_id % 10 = 1) AS BIGINT) AS broken FROM v4")
def eval_log_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exchange is validated and logged, by a run that is written twice; lines of another writer, some of them broken off or blank, lie between. Accuracy is that of the records read back."""
    path = shared_folder(spark, "eval-log")
    done = _suite(spark, sf_dir)
    records = done.select(F.col("q").alias("query"), "answer", F.col("final_confidence").alias("confidence"), "passed", F.split("issues", "; ").alias("issues"), F.when(F.col("correct"), "right").otherwise("wrong").alias("model"))
    for _ in range(2):
        readers.write_eval_log(records, path, run="one")
    rest = exchanges(spark, sf_dir).where("case_id % 10 = 1").select(F.explode(F.array(F.lit('{"query": "broken off'), F.lit("  "))).alias("value"))
    rest.write.text(f"{path}/run=two")
    log = readers.scan_eval_log(spark, path).select((F.col("model") == "right").cast("int").alias("ok"), F.col("broken").isNotNull().cast("long").alias("broken"))
    return log.agg(F.sum(1 - F.col("broken")).alias("cases"), F.sum("ok").alias("correct"), F.round(F.avg("ok"), 6).alias("accuracy"), F.sum("broken").alias("broken"))


@query(f"WITH {CASES}, {VALID} SELECT bucket, CAST(count(*) AS BIGINT) AS cases FROM (SELECT CASE WHEN round(confidence, 9) >= 0.8 THEN 'High' WHEN round(confidence, 9) >= 0.6 THEN 'Good' WHEN round(confidence, 9) >= 0.4 THEN 'Medium' ELSE 'Low' END AS bucket FROM v3) GROUP BY bucket")
def confidence_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = validate.with_confidence(_cases(spark, sf_dir))
    return df.groupBy(validate.confidence_bucket(F.round("confidence", 9)).alias("bucket")).agg(F.count("*").alias("cases"))


@query("""WITH h AS (SELECT a.doc_id, count(*) FILTER (WHERE l.quality = 0) AS old, count(*) FILTER (WHERE l.quality = 1) AS cur FROM documents a JOIN labels l ON l.doc_id BETWEEN a.doc_id - 2 AND a.doc_id + 2 AND l.doc_id // 5 = a.doc_id // 5 GROUP BY a.doc_id)
SELECT doc_id, CASE WHEN old > 0 AND cur = 0 THEN 'all' WHEN old > 0 THEN 'some' END AS warning FROM h""")
def version_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top sources = the labelled documents near a document's id in its block of five; quality 0 = superseded."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 5).alias("g"))
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("other"), "quality", F.floor(F.col("doc_id") / 5).alias("g"))
    near = d.join(lab, "g").where(F.abs(F.col("doc_id") - F.col("other")) <= 2)
    per = near.groupBy("doc_id").agg(F.sum((F.col("quality") == 0).cast("int")).alias("old"), F.sum((F.col("quality") == 1).cast("int")).alias("cur"))
    return per.select("doc_id", validate.version_warning(F.col("old"), F.col("cur")).alias("warning"))
