"""Toxicity by non-negative positive-unlabelled learning with numpy.

Confirmed toxic rows are the positives; training rows whose labels are hidden are the unlabelled text. They are drawn from the
rows that were reviewed at all, as positives come from these too: which documents were reviewed goes by language, so that text
drawn from all documents would make words of the languages reviewed most look toxic. Words and word
beginnings are weighed by how much likelier positives hold them than unlabelled text does, less `z` standard errors; a
document becomes a few numbers (its strongest weights, their sum and density); a logistic classifier is trained on them with
the class-prior-corrected risk pi R_p(+) + max(0, R_u(-) - pi R_p(-)), whose negative part is undone by an ascent step.

The classifier is fitted on bounded samples (`max_positive`, `max_unlabelled` rows, taken in the order of a hash of doc_id);
its features are bounded by `max_features`. Scoring reads every text whole. Labels, lang, source and doc_id are no inputs.

Defined results: null and empty texts get the score of a text without evidence; a null doc_id is scored, held_out is null;
rows that repeat a doc_id are scored one by one; null labels count as unknown; without confirmed positives every score is 0;
an empty table gives no rows. Other columns pass through; one named score is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakequill.llm.common import Store, table

MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES, Z, THRESHOLD = 8_000, 16_000, 50_000, 3.0, 0.7
PREFIXES = (4, 5, 6, 7)
_WORD = re.compile(r"\w+")
_TOP = 4


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3; rows with 1 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def word_features(word: str) -> list[str]:
    """The word, and its beginnings marked by a tilde."""
    return [word, *(word[:n] + "~" for n in PREFIXES if len(word) > n)]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


class Evidence:
    """Weights of words; what a word weighs is remembered, up to a bound."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.known = weights, {}

    def vector(self, text: str | None) -> list[float]:
        words, known, got = words_of(text), self.known, []
        if len(known) > 500_000:
            known.clear()
        for w in words:
            v = known.get(w)
            if v is None:
                v = known[w] = max(self.weights.get(f, 0.0) for f in word_features(w))
            if v:
                got.append(v)
        got.sort(reverse=True)
        total = sum(got)
        return [*(got + [0.0] * _TOP)[:_TOP], np.log1p(total), total / (len(words) + 10) ** 0.5]


def nnpu_fit(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 800, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier under the non-negative risk, by Adam over whole batches."""
    scale = np.maximum(np.concatenate([pos, unl]).std(0), 1e-9)
    p, u = pos / scale, unl / scale
    theta, m, v = np.zeros(p.shape[1] + 1), 0.0, 0.0
    theta[-1] = np.log(prior / (1 - prior))
    p1, u1 = np.c_[p, np.ones(len(p))], np.c_[u, np.ones(len(u))]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        zp, zu = p1 @ theta, u1 @ theta
        below = np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp))
        g_neg = u1.T @ sigmoid(zu) / len(u1) - prior * (p1.T @ sigmoid(zp)) / len(p1)
        g = -prior * (p1.T @ sigmoid(-zp)) / len(p1) + g_neg if below >= 0 else -g_neg
        g[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1] / scale, float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, store: Store, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_features: int = MAX_FEATURES, z: float = Z) -> tuple[dict[str, float], np.ndarray, float] | None:
    """Evidence weights, classifier weights and bias; None without confirmed positives."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(remainder(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = store.save(known, "labels")
    n, positives = known.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    if not positives:
        return None
    prior = min(max(positives / n, 1e-4), 0.9)
    pick = lambda df, seed, most: df.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most).select("doc_id")
    chosen = pick(known.where("toxic = 1"), 1, max_positive).withColumn("p", F.lit(1)).withColumn("u", F.lit(0))
    chosen = chosen.union(pick(known, 2, max_unlabelled).withColumn("p", F.lit(0)).withColumn("u", F.lit(1))).groupBy("doc_id").agg(F.max("p").alias("p"), F.max("u").alias("u"))
    # at most max_positive + max_unlabelled ids of 24 bytes are broadcast
    sample = store.save(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "p", "u"), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, u = Counter(), Counter()
        for b in batches:
            for text, in_p, in_u in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held = {f for w in words_of(text) for f in word_features(w)}
                if in_p:
                    p.update(held)
                if in_u:
                    u.update(held)
        # a feature that only unlabelled text holds never weighs anything
        names = list(p)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([p[w] for w in names], pa.int64()), pa.array([0] * len(names), pa.int64())], names=["f", "p", "u"])
        names = list(u)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([0] * len(names), pa.int64()), pa.array([u[w] for w in names], pa.int64())], names=["f", "p", "u"])

    n_p, n_u = sample.agg(F.sum("p"), F.sum("u")).first()
    if not n_p:
        return None
    counts = sample.mapInArrow(count, "f string, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where("p >= 3")
    ratio = F.log((F.col("p") + 0.5) / (n_p + 1)) - F.log((F.col("u") + 0.5) / (n_u + 1)) - z * F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("u") + 0.5))
    weights = {r["f"]: r["w"] for r in counts.select("f", ratio.alias("w")).where("w > 0").orderBy(F.desc("w"), "f").limit(max_features).collect()}
    evidence = Evidence(weights)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([evidence.vector(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64())), b.column(1), b.column(2)], names=["x", "p", "u"])

    rows = sample.mapInArrow(vectors, "x array<double>, p int, u int").collect()  # bounded like the sample
    x, p, u = np.array([r["x"] for r in rows]), np.array([r["p"] for r in rows]), np.array([r["u"] for r in rows])
    store.drop(sample)
    return weights, *nnpu_fit(x[p == 1], x[u == 1] if u.any() else x, prior)


def score(docs: DataFrame, model: tuple[dict[str, float], np.ndarray, float] | None) -> DataFrame:
    """docs with score, a double from 0 to 1."""
    docs = docs.drop("score")
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    weights, theta, bias = model
    at, names = docs.columns.index("text"), [*docs.columns, "score"]
    evidence = Evidence(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([evidence.vector(t) for t in b.column(at).to_pylist()]).reshape(b.num_rows, len(theta))
            y = 1 / (1 + np.exp(-np.clip(x @ theta + bias, -40, 40)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(y, pa.float64())], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored; predicted at THRESHOLD."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels"), Store(spark, "toxicity")))
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below THRESHOLD."""
    model = train(docs, table(spark, sf_dir, "labels"), Store(spark, "toxicity-stage"))
    return score(docs, model).where(F.col("score") < THRESHOLD).drop("score")
