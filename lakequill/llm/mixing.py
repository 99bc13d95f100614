"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with target weight w gets the mean repetition rate w / sum(w) * total / n, n being its documents and total the size
asked for (the number of mixed documents if none is). A hash of seed and doc_id is a uniform number of [0, 1); inverting the
Poisson distribution at it gives the document's count of copies, the same wherever and however often it is computed. Copies
are dealt to partitions and sorted by a hash of seed, doc_id and copy number, which is a global shuffle in one exchange.

Sources that are not named share the weight `other` as one source (weight 0 leaves them out), a null source among them. A null
doc_id hashes like the text 'null'; rows that repeat a doc_id repeat its count; an empty table gives no rows. All columns
pass through, copy and shuffle_key are added or replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.llm.common import table

SEED = 20240229
#: A head of small sources at equal weight, the crowded first one halved, others together.
WEIGHTS = {"src0": 0.10, **{f"src{i}": 0.045 for i in range(1, 20)}}
OTHER = 0.045


def uniform(key: Column, seed: int) -> Column:
    """52 bits of MD5 as a number of [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_count(u: Column, rate: float) -> Column:
    """The least k with u below the distribution function at k; the series ends where no more 52-bit number can lie above it.

    Large rates, for which exp(-rate) is beyond the range of doubles, start where less than any 52-bit number lies below.
    """
    n, first = int(rate + 12 * rate**0.5 + 30), 0 if rate <= 600 else int(rate - 12 * rate**0.5)
    p = F.exp(F.lit(-rate)) if not first else F.lit(math.exp(first * math.log(rate) - rate - math.lgamma(first + 1)))
    start = F.struct(F.lit(first).alias("k"), p.alias("p"), p.alias("cdf"))
    step = lambda a, i: F.when(u < a["cdf"], a).otherwise(
        F.struct(i.cast("int").alias("k"), (a["p"] * F.lit(rate) / i).alias("p"), (a["cdf"] + a["p"] * F.lit(rate) / i).alias("cdf"))
    )
    return F.aggregate(F.sequence(F.lit(first + 1), F.lit(n)), start, step)["k"]


def mix(docs: DataFrame, weights: dict[str, float], other: float = 0.0, total: int | None = None, seed: int = SEED) -> DataFrame:
    """docs exploded by their Poisson counts, globally shuffled. The driver sees one count for each named source at most."""
    docs = docs.drop("copy", "shuffle_key")
    group = F.when(F.col("source").isin(list(weights)), F.col("source"))  # null: the others
    sizes = {r["g"]: r["n"] for r in docs.groupBy(group.alias("g")).agg(F.count("*").alias("n")).collect()}
    share = {g: (other if g is None else weights[g]) for g in sizes}
    mixed, whole = sum(n for g, n in sizes.items() if share[g] > 0), sum(share.values())
    u, count = uniform(F.col("doc_id"), seed), F.lit(0)
    for g in sorted((g for g in sizes if share[g] > 0), key=lambda g: (g is None, str(g))):
        rate = share[g] / whole * (total or mixed) / sizes[g]
        count = F.when(group.isNull() if g is None else F.col("source") == g, poisson_count(F.col("__u"), rate)).otherwise(count)
    copies = docs.withColumn("__u", u).withColumn("__n", count).where("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    key = F.md5(F.concat(F.lit(f"{seed}:shuffle:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("copy").cast("string")))
    return copies.drop("__u", "__n").withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of documents, at WEIGHTS."""
    return mix(table(spark, sf_dir, "documents"), WEIGHTS, OTHER).select("doc_id", "source", "copy", "shuffle_key", "text")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, WEIGHTS, OTHER)


OP7_SQL = f"""
WITH RECURSIVE weights AS (
  SELECT * FROM (VALUES {", ".join(f"('{s}', {w}::DOUBLE)" for s, w in WEIGHTS.items())}, (NULL, {OTHER}::DOUBLE)) AS w(g, w)
), docs AS (
  SELECT *, CASE WHEN source IN ({", ".join(f"'{s}'" for s in WEIGHTS)}) THEN source END AS g,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM documents
), sizes AS (SELECT g, count(*) AS n FROM docs GROUP BY g),
rates AS (
  SELECT s.g, w.w / (SELECT sum(w2.w) FROM weights w2 JOIN sizes s2 ON w2.g IS NOT DISTINCT FROM s2.g) * (SELECT sum(n) FROM sizes) / s.n AS rate
  FROM sizes s JOIN weights w ON s.g IS NOT DISTINCT FROM w.g
), steps AS (
  SELECT g, rate, 0 AS k, exp(-rate) AS p, 0.0::DOUBLE AS below, exp(-rate) AS cdf FROM rates
  UNION ALL
  SELECT g, rate, k + 1, p * rate / (k + 1), cdf, cdf + p * rate / (k + 1) FROM steps WHERE k < rate + 12 * sqrt(rate) + 29
)
SELECT doc_id, source, unnest(range(1, k + 1))::INTEGER AS copy,
       md5('{SEED}:shuffle:' || coalesce(doc_id::VARCHAR, 'null') || ':' || unnest(range(1, k + 1))::VARCHAR) AS shuffle_key, text
FROM docs d JOIN steps s ON d.g IS NOT DISTINCT FROM s.g AND d.u >= s.below AND d.u < s.cdf
WHERE k > 0
"""
