"""Soft-membership mixing to target weights (native: DataFrame functions only).

A log-linear classifier, fitted on the labelled table over features chosen within each language and calibrated on rows
held out of it, gives every document a posterior over domains. Rates per document are then fitted so that the expected token totals of the domains meet their targets: least squares over
nonnegative rates by projected gradient steps. In the metric of the documents' tokens the gradient for a document is
its posterior times the domains' relative gaps, and steps are projected lazily (dual averaging): a document's rate is
max(0, 1 + step sums . posterior), so the state of the descent is one number a domain, and one step is one aggregate.
"""

from __future__ import annotations

import collections
import math
import zlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle

SYMBOLS = r"[#%&*$|<>{}\[\]=_~^@!]"
#: Stems of words that are features too, in letters; most languages that get features of their own; maps of weights.
STEMS, LANGUAGES, PARTS = (4, 6), 20, 64


def with_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with `tokens` (words between blanks and line ends) and `feats` (lower-case words between punctuation, their stems, and bins of three shares and the length).

    Columns that are used twice are columns of their own, so that the plan works them out once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(F.replace(F.lower(text), F.lit("\n"), F.lit(" ")), " "), "")
    out = df.withColumn("words__", words).withColumn("tokens", F.size("words__").cast("long")).withColumn("words__", F.array_distinct("words__"))
    share = lambda part, whole: F.floor(F.least(F.lit(1.0), part / F.greatest(whole, F.lit(1))) * 10).cast("int").cast("string")
    bins = F.array(
        F.concat(F.lit("#symbols"), share(F.regexp_count(text, F.lit(SYMBOLS)) * 4, F.length(text))),
        F.concat(F.lit("#varied"), share(F.size("words__"), F.col("tokens"))),
        F.concat(F.lit("#capital"), share(F.regexp_count(text, F.lit(r"\p{Lu}")) * 4, F.length(text))),
        F.concat(F.lit("#length"), F.floor(F.log2(F.col("tokens") + 1)).cast("int").cast("string")),
    )
    # Each distinct word is split at its punctuation once, however often it stands in the text.
    terms = F.array_remove(F.array_distinct(F.split(F.array_join("words__", " "), r"[\s\p{Punct}]+")), "")
    out = out.withColumn("terms__", terms).withColumn("bins__", bins).drop("words__")
    stems = [F.transform("terms__", lambda w, n=n: F.concat(F.lit("^"), F.substring(w, 1, n))) for n in STEMS]
    return out.withColumn("feats", F.concat("terms__", *stems, "bins__")).drop("terms__", "bins__")


def domain_of(quality: Column, toxic: Column) -> Column:
    """toxic, else good or poor by quality; null where a label is missing."""
    return F.when(quality.isNull() | toxic.isNull(), None).when(toxic == 1, "toxic").when(quality == 1, "good").otherwise("poor")


class Classifier:
    """Log-linear model over the chosen features; held_out has (rows, rows labelled right) by language."""

    def __init__(self, domains: list[str], start: list[float], weights: dict[str, list[float]], held_out: dict[str, tuple[int, int]] | None = None):
        self.domains, self.start, self.weights, self.held_out = domains, start, weights, held_out or {}

    def with_posterior(self, df: DataFrame) -> DataFrame:
        """df (feats) with p: array<double> over the domains, adding up to 1; feats is dropped."""
        start = F.array(*[F.lit(float(x)) for x in self.start])
        if self.weights:
            known = F.array(*[F.lit(f) for f in self.weights])
            # A map is searched from end to end; by the feature's hash only a small one is.
            parts: list[dict[str, list[float]]] = [{"": [0.0] * len(self.domains)} for _ in range(PARTS)]
            for f, w in self.weights.items():
                parts[zlib.crc32(f.encode()) % PARTS][f] = w
            table = F.array(*[F.create_map(*[x for f, w in part.items() for x in (F.lit(f), F.array(*[F.lit(float(v)) for v in w]))]) for part in parts])
            weight = lambda f: F.get(table, (F.crc32(f) % PARTS).cast("int"))[f]
            hits = F.array_intersect("feats", known)
            df = df.withColumn("logs__", F.aggregate(hits, start, lambda a, f: F.zip_with(a, weight(f), lambda x, y: x + y))).drop("feats")
        else:
            df = df.withColumn("logs__", start).drop("feats")
        df = df.withColumn("p", F.transform("logs__", lambda x: F.exp(x - F.array_max("logs__")))).drop("logs__")
        return df.withColumn("sum__", F.aggregate("p", F.lit(0.0), lambda a, x: a + x)).withColumn("p", F.transform("p", lambda x: x / F.col("sum__"))).drop("sum__")


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _fit(x: np.ndarray, y: np.ndarray, domains: int, ridge: float = 1.0, steps: int = 400) -> np.ndarray:
    """Multinomial logistic regression by accelerated gradient steps; the last column of x is 1 and its weight is free."""
    want = np.eye(domains)[y]
    size = 0.5 * np.linalg.norm(x, 2) ** 2 + ridge
    w = ahead = np.zeros((x.shape[1], domains))
    a = 1.0
    for _ in range(steps):
        slope = x.T @ (_softmax(x @ ahead) - want)
        slope[:-1] += ridge * ahead[:-1]
        nxt, b = ahead - slope / size, (1 + math.sqrt(1 + 4 * a * a)) / 2
        ahead, w, a = nxt + (a - 1) / b * (nxt - w), nxt, b
    return w


def fit_domains(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 6000, features: int = 150, lang_col: str = "lang") -> Classifier:
    """Fit on a bounded sample: the `sample` labelled rows with the least hash of their id.

    In each language the `features` features with the largest mutual information with the domain are kept, so that none
    stands for a language alone; languages beyond the LANGUAGES most frequent ones, unknown ones and tables without
    `lang_col` are one more language. The driver sees the kept features of the sample only. A fifth of the sample is
    held out of choice and fit; the posteriors' temperature is the one that suits it best. Labels with nulls are left
    out, as are ids without a document. Without labelled rows there is one domain, `all`.
    """
    drawn = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id__"), domain_of(F.col("quality"), F.col("toxic")).alias("domain")).where("domain is not null")
    drawn = drawn.orderBy(F.xxhash64("id__"), "id__", "domain").limit(sample)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col).alias("id__"), F.col(text_col).alias("text"), lang.alias("lang")).join(F.broadcast(drawn), "id__")  # `sample` rows
    held = F.pmod(F.xxhash64(F.lit("held"), "id__"), F.lit(5)) == 0
    rows = settle(with_features(rows).select("domain", "lang", held.alias("held"), F.array_distinct("feats").alias("feats")), "mix-sample")
    sizes: dict[str, dict[str, int]] = {}
    told = rows.groupBy("lang", "domain", "held").count().collect()
    domains = sorted({r.domain for r in told})
    if not domains:
        return Classifier(["all"], [0.0], {})
    many = collections.Counter()
    for r in told:
        many[r.lang] += r["count"]
    named = [x for x, _ in sorted(many.items(), key=lambda x: (-x[1], x[0]))[:LANGUAGES]]
    own = lambda x: x if x in named else ""
    for r in told:
        if not r.held:
            each = sizes.setdefault(own(r.lang), dict.fromkeys(domains, 0))
            each[r.domain] += r["count"]
    rows = rows.withColumn("lang", F.when(F.col("lang").isin(named), F.col("lang")).otherwise(""))
    weights, start, held_out = {}, np.zeros(len(domains)), {}
    counts = rows.where("not held").select("lang", "domain", F.explode("feats").alias("f")).groupBy("lang", "f").agg(*[F.sum((F.col("domain") == d).cast("long")).alias(f"n{i}") for i, d in enumerate(domains)])
    counts = settle(counts, "mix-counts")
    seen = reduce(lambda a, b: a + b, [F.col(f"n{i}") for i in range(len(domains))])
    best: set[str] = set()
    for x, size in sizes.items():
        total = sum(size.values())
        # Mutual information of the feature's presence and the domain.
        cell = lambda joint, row, col: F.when(joint > 0, joint / total * F.log(joint * total / (row * col))).otherwise(0.0)  # noqa: E731, B023
        gain = reduce(lambda a, b: a + b, [cell(F.col(f"n{i}"), seen, F.lit(size[d])) + cell(F.lit(size[d]) - F.col(f"n{i}"), F.lit(total) - seen, F.lit(size[d])) for i, d in enumerate(domains)])
        best |= {r.f for r in counts.where((F.col("lang") == x) & (seen >= 5)).select("f", gain.alias("gain")).orderBy(F.desc("gain"), "f").limit(features).collect()}
    names = sorted(best)
    at = {f: i for i, f in enumerate(names)}
    kept = rows.select("domain", "lang", "held", F.array_intersect("feats", F.array(*[F.lit(f) for f in names]).cast("array<string>")).alias("feats")).collect()
    x, y = np.zeros((len(kept), len(names) + 1)), np.array([domains.index(r.domain) for r in kept])
    x[:, -1] = 1
    for i, r in enumerate(kept):
        x[i, [at[f] for f in r.feats]] = 1
    out = np.array([r.held for r in kept])
    if not out.all():
        w = _fit(x[~out], y[~out], len(domains))
        if out.any():
            scores, rows_out = x[out] @ w, np.arange(out.sum())
            loss = lambda t: -np.log(np.maximum(_softmax(scores * t)[rows_out, y[out]], 1e-12)).mean()
            w *= min(np.geomspace(0.5, 2, 41), key=loss)
            right = scores.argmax(1) == y[out]
            langs = np.array([r.lang for r in kept])[out]
            held_out = {str(k): (int((langs == k).sum()), int(right[langs == k].sum())) for k in np.unique(langs)}
        weights, start = {f: w[i].tolist() for f, i in at.items()}, w[-1]
    return Classifier(domains, list(start), weights, held_out)


def descend(table: DataFrame, domains: list[str], targets: dict[str, float], steps: int = 60, tolerance: float = 1e-4) -> tuple[list[float], list[float]]:
    """table (tokens, p: posteriors) -> (step sums, final totals). One aggregate a step; one number a domain to the driver."""
    own = [F.sum(F.col("tokens") * F.col("p")[i]) for i in range(len(domains))]
    have = [x or 0.0 for x in table.agg(*own).first()]
    goal = [targets.get(d, 0.0) for d in domains]
    sums, now = [0.0] * len(domains), have
    for _ in range(steps):
        gaps = [(n - g) / h if h > 0 else 0.0 for n, g, h in zip(now, goal, have)]
        if max(map(abs, gaps), default=0.0) <= tolerance:
            break
        sums = [s - x for s, x in zip(sums, gaps)]
        rate = rates(sums)
        now = [x or 0.0 for x in table.agg(*[F.sum(F.col("tokens") * rate * F.col("p")[i]) for i in range(len(domains))]).first()]
    return sums, now


def rates(sums: list[float]) -> Column:
    return F.greatest(F.lit(0.0), reduce(lambda a, b: a + b, [F.lit(s) * F.col("p")[i] for i, s in enumerate(sums)], F.lit(1.0)))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], relative: bool = False, id_col: str = "doc_id", text_col: str = "text", sample: int = 6000, lang_col: str = "lang") -> tuple[DataFrame, list[str], dict[str, tuple[float, float]]]:
    """(id, text_hash, tokens, p, rate) for every row of docs, the order of the domains in p, and of each domain the target of
    its tokens and the total that the rates reach.

    The two differ where a target is out of reach: posteriors are soft and rates are linear in them, so that a domain with
    target 0 keeps what rows of other domains are believed to hold of it. text_hash: xxhash64 of the text; with the id it
    tells rows apart, where ids are null or repeat.

    weights: each domain's share of all tokens, or with `relative` the factor on the tokens it has. A domain without a
    weight has target 0. A null or blank text has no tokens; its posterior comes from its length bin. Null ids and
    repeated rows each get a rate; of extra columns only `lang_col` is read, for the labelled sample; an empty table gives an empty result.
    """
    net = fit_domains(docs, labels, id_col, text_col, sample, lang_col=lang_col)
    table = with_features(docs.select(F.col(id_col).alias("id__"), F.xxhash64(text_col).alias("hash__"), F.col(text_col).alias("text")))
    table = settle(net.with_posterior(table.select("id__", "hash__", "tokens", "feats")), "mix-posteriors")
    k = range(len(net.domains))
    total, *have = table.agg(F.sum("tokens"), *[F.sum(F.col("tokens") * F.col("p")[i]) for i in k]).first()
    goals = {d: weights.get(d, 0.0) * ((have[i] if relative else total) or 0.0) for i, d in zip(k, net.domains)}
    sums, reached = descend(table, net.domains, goals)
    out = table.select(F.col("id__").alias(id_col), F.col("hash__").alias("text_hash"), "tokens", "p", rates(sums).alias("rate"))
    return out, net.domains, {d: (goals[d], x) for d, x in zip(net.domains, reached)}


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, tokens, p_good, p_poor, p_toxic, rate for 80 % good, 18 % poor and 2 % toxic tokens."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out, domains, _ = mix(docs, labels, {"good": 0.80, "poor": 0.18, "toxic": 0.02})
    p = {d: F.col("p")[i] for i, d in enumerate(domains)}
    return out.select("doc_id", "tokens", *[p.get(d, F.lit(0.0)).alias(f"p_{d}") for d in ("good", "poor", "toxic")], "rate")
