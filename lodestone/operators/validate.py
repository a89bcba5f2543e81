"""Answer validation: confidence, grounding, decision, evaluation suite."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import HALLUCINATION_PHRASES, REFUSAL_PHRASES, STOP_CONFIDENCE, STOP_SENTENCE
from lodestone.config import SETTINGS as S
from lodestone.functions.text import let, share_contained, terms

#: Specifics that an answer must not invent.
SPECIFICS = {
    "URL": r"(?i)https?://[\p{L}\p{N}_./-]+",
    "email": r"(?i)[\p{L}\p{N}_][\p{L}\p{N}_.+-]*@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]{2,}",
    "phone number": r"\b[0-9]{3}[-.]?[0-9]{3}[-.]?[0-9]{4}\b",
}


def _phrases(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(F.lower(text), F.lit(p.lower())).cast("int") for p in phrases])


def with_confidence(cases: DataFrame) -> DataFrame:
    """cases (q, answer, ctx, top_score, superseded: in the first three) -> plus the four signals, penalty, confidence.

    Unsupported phrases lower the consistency and are taken off again as a penalty; a refusal sets the consistency.
    """
    answer = F.trim(F.coalesce("answer", F.lit("")))
    said = F.least(F.lit(0.4), _phrases(answer, HALLUCINATION_PHRASES) * 0.15)
    base = F.when(F.length(answer) == 0, 0.0).when(F.length(answer) < 20, 0.7).otherwise(1.0)
    base = F.when(_phrases(answer, REFUSAL_PHRASES) > 0, 0.5).otherwise(base)
    df = cases.withColumn("retrieval", F.least(F.lit(1.0), F.coalesce("top_score", F.lit(0.0)) * 20))
    df = df.withColumn("coverage", share_contained(terms(F.col("q"), STOP_CONFIDENCE), F.col("ctx"), F.lit(1.0)))
    grounded = share_contained(terms(F.col("answer"), STOP_CONFIDENCE), F.col("ctx"), F.lit(0.0))
    df = df.withColumn("term_grounding", F.when(F.length(F.coalesce("ctx", F.lit(""))) == 0, 0.0).otherwise(grounded))
    df = df.withColumn("consistency", F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - said)))
    df = df.withColumn("penalty", said + F.when(F.coalesce("superseded", F.lit(False)), S.superseded_penalty).otherwise(0.0))
    blend = F.col("retrieval") * S.weight_retrieval + F.col("coverage") * S.weight_coverage + F.col("term_grounding") * S.weight_grounding + F.col("consistency") * S.weight_consistency
    return df.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), blend - F.col("penalty"))))


def fabrications(answer: Column, ctx: Column) -> Column:
    """array<string>: the specifics of the answer, each with its kind, that the context does not hold as they stand."""
    found = lambda text, p: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0))
    named = lambda kind: lambda x: F.concat(F.lit(f"{kind}: "), x)
    return F.concat(*[F.transform(F.array_sort(F.array_except(found(answer, p), found(ctx, p))), named(kind)) for kind, p in SPECIFICS.items()])


def sentence_grounding(answer: Column, ctx: Column) -> Column:
    """The share of sentences (over 15 characters) of which 40 % of the terms, if any, are in the context; 1 without sentences."""
    sentences = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), r"[.!?\n]"), lambda s: F.trim(s)), lambda s: F.length(s) > 15)

    def held(low: Column, s: Column) -> Column:
        return let(terms(s, STOP_SENTENCE, 3), lambda t: (F.size(t) == 0) | (F.size(F.filter(t, lambda w: F.contains(low, w))) / F.greatest(F.size(t), F.lit(1)) >= 0.40))

    def share(low: Column) -> Column:
        return let(sentences, lambda ss: F.when(F.size(ss) == 0, 1.0).otherwise(F.size(F.filter(ss, lambda s: held(low, s))) / F.size(ss)))

    return let(F.lower(F.coalesce(ctx, F.lit(""))), share)


def version_warning(superseded: Column, active: Column) -> Column:
    """`all`, `some` or null, from how many of the first five sources are superseded or active."""
    return F.when((superseded > 0) & (active == 0), "all").when(superseded > 0, "some")


def validate(cases: DataFrame) -> DataFrame:
    """cases (q, answer, ctx, top_score, superseded) -> signals, fabrications, grounding, verdict, passed, final_confidence.

    Verdicts in this order: pass, fabricated (confidence halved), low_confidence, low_grounding (times 0.7).
    """
    df = with_confidence(cases).withColumn("fabricated", fabrications(F.col("answer"), F.col("ctx"))).withColumn("grounding", sentence_grounding(F.col("answer"), F.col("ctx")))
    sure, faithful = F.col("confidence") >= S.least_confidence, (F.size("fabricated") == 0) & (F.col("grounding") >= S.least_grounding)
    verdict = F.when(sure & faithful, "pass").when(F.size("fabricated") > 0, "fabricated").when(~sure, "low_confidence").otherwise("low_grounding")
    df = df.withColumn("verdict", verdict).withColumn("passed", F.col("verdict") == "pass")
    factor = F.when(F.col("verdict") == "fabricated", 0.5).when(F.col("verdict") == "low_grounding", 0.7).otherwise(1.0)
    return df.withColumn("final_confidence", F.greatest(F.lit(0.0), F.col("confidence") * factor))


def issues(df: DataFrame) -> Column:
    """What an evaluation case may expect to be named: fabricated specifics and low grounding."""
    return F.concat_ws("; ", F.when(F.size("fabricated") > 0, F.lit("fabricated specifics")), F.when(F.col("grounding") < S.least_grounding, F.lit("grounding below threshold")))


def confidence_bucket(c: Column) -> Column:
    return F.when(c >= 0.8, "High").when(c >= 0.6, "Good").when(c >= 0.4, "Medium").otherwise("Low")


#: The labelled cases (question, answer, context, expected to pass, expected issue).
EVAL_CASES = (
    (1, "What is the maximum file upload size?", "- The maximum file upload size is 100MB as specified in the configuration.", "Configuration: MAX_FILE_SIZE_MB is set to 100. Files larger than this are rejected.", True, ""),
    (2, "Where can I find the documentation?", "- Documentation is available at https://fake-docs.example.com/guide", "The system documentation is maintained internally. Contact the admin team.", False, "fabricat"),
    (3, "How does the backup system work?", "- Based on my training data, the backup runs nightly at 2 AM.", "Backups are scheduled via cron. The default schedule is daily at 02:00 UTC.", True, ""),
    (4, "What is the deployment process?", "", "Deployment uses Docker Compose. Run docker-compose up to start services.", False, ""),
    (5, "What is the server architecture?", "- The system uses a quantum computing cluster with 1000 qubits for processing.", "Architecture: FastAPI backend, PostgreSQL database, React frontend.", False, "grounding"),
    (6, "What is the CEO's phone number?", "- I could not find supporting information for that question in the currently uploaded files.", "Company handbook: general policies and procedures.", True, ""),
    (7, "Who should I contact for support?", "- Contact support at help@totally-fake-company.com for assistance.", "For support issues, escalate to the Tier-2 engineering team.", False, "fabricat"),
)


def eval_cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EVAL_CASES), "case_id int, q string, answer string, ctx string, expected_pass boolean, expected_issue string")


def run_suite(cases: DataFrame) -> DataFrame:
    """cases with expected_pass and expected_issue -> plus the validation and whether it is as expected."""
    df = validate(cases.withColumn("top_score", F.lit(0.0)).withColumn("superseded", F.lit(False)))
    df = df.withColumn("issues", issues(df))
    named = (F.col("expected_issue") == "") | F.contains("issues", F.col("expected_issue"))
    return df.withColumn("correct", (F.col("passed") == F.col("expected_pass")) & named)
