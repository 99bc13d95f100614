"""Test statistics: sums are Spark aggregates, tails of distributions are arithmetic on one row."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lakequill.operators import ranks


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal tail; Spark has no error function."""
    return z.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2)))


def pooled_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """z of two proportions with pooled variance; 0 where the variance is 0."""
    p = F.try_divide(x1 + x2, n1 + n2)
    se = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1), n1) + F.try_divide(F.lit(1), n2)))
    return F.when(se > 0, (x1 / n1 - x2 / n2) / se).otherwise(F.lit(0.0))


def pairwise_z(rates: DataFrame, arm: str) -> DataFrame:
    """z for each pair of arms (first < second) of a table (arm, successes, trials)."""
    a = rates.select(F.col(arm).alias("arm_a"), F.col("successes").alias("x_a"), F.col("trials").alias("n_a"))
    b = rates.select(F.col(arm).alias("arm_b"), F.col("successes").alias("x_b"), F.col("trials").alias("n_b"))
    return a.join(b, F.col("arm_a") < F.col("arm_b")).withColumn("z", pooled_z(F.col("x_a"), F.col("n_a"), F.col("x_b"), F.col("n_b")))


def corrected(pairs: DataFrame, family_size: int) -> DataFrame:
    """p and its Bonferroni correction, capped at 1; equal rates give z 0 and p 1."""
    return pairs.withColumn("p", two_sided_p("z")).withColumn("p_corrected", F.least(F.col("p") * family_size, F.lit(1.0)))


def minimum_detectable_effect(p: float, n: int, alpha: float = 0.05, power: float = 0.80) -> float:
    """At n a group and base rate p; n is named because tasks and items give different answers."""
    nd = NormalDist()
    return (nd.inv_cdf(1 - alpha / 2) + nd.inv_cdf(power)) * math.sqrt(2 * p * (1 - p) / n)


def non_inferior(df: DataFrame, task: str, arm: str, value: str, base: str, other: str, margin: float) -> DataFrame:
    """Means over tasks that both arms have; the boundary itself is non-inferior."""
    one = lambda a, name: df.where(F.col(arm) == a).select(task, F.col(value).alias(name))
    both = one(base, "x").join(one(other, "y"), task)
    out = both.agg(F.count("*").alias("n"), F.avg("x").alias("mean_base"), F.avg("y").alias("mean_other"))
    return out.withColumn("difference", F.col("mean_other") - F.col("mean_base")).withColumn("non_inferior", F.bround(F.col("difference"), 12) >= -margin)


def binomial_upper_tail(k: int, n: int, p: float) -> float:
    """P(X >= k)."""
    if k <= 0:
        return 1.0
    if p <= 0 or k > n:
        return 0.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return min(1.0, math.fsum(math.exp(log(i)) for i in range(k, n + 1))) if p < 1 else 1.0


def critical_count(n: int, p: float, alpha: float) -> int:
    """The least k whose upper tail is at alpha or below."""
    low, high = 0, n + 1
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if binomial_upper_tail(mid, n, p) <= alpha else (mid + 1, high)
    return low


def upper_95(x: int, n: int) -> float:
    """One-sided exact upper bound of a proportion, by bisection."""
    if x >= n:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - binomial_upper_tail(x + 1, n, mid) > 0.05 else (low, mid)
    return (low + high) / 2


def binomial_tail_column(k: Column, n: Column, p: float) -> Column:
    """P(X >= k) as an expression: the first term from log-factorials as running sums, the others by their ratio."""
    lf = lambda m: F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + F.ln(i.cast("double")))
    first = F.exp(lf(n) - lf(k) - lf(n - k) + k * math.log(p) + (n - k) * math.log1p(-p))
    step = lambda a, i: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * (n - i) / (i + 1) * (p / (1 - p))).alias("term"))
    total = F.aggregate(F.sequence(k.cast("int"), F.greatest(n, k).cast("int")), F.struct(F.lit(0.0).alias("sum"), first.alias("term")), step)["sum"]
    return F.when(k <= 0, F.lit(1.0)).when(k > n, F.lit(0.0)).otherwise(total)


def cochran_armitage(df: DataFrame, score: str, successes: str, trials: str) -> DataFrame:
    """Trend statistic over ordered groups (score, successes, trials); 0 without variance."""
    n, x, s = F.col(trials).cast("double"), F.col(successes).cast("double"), F.col(score).cast("double")
    t = df.agg(F.sum(n).alias("n"), F.sum(x).alias("x"), F.sum(s * x).alias("sx"), F.sum(s * n).alias("sn"), F.sum(s * s * n).alias("ssn"))
    p = F.try_divide("x", "n")
    variance = p * (1 - p) * (F.col("ssn") - F.try_divide(F.col("sn") * F.col("sn"), F.col("n")))
    return t.select(F.col("n").cast("long").alias("trials"), F.col("x").cast("long").alias("successes"), F.when(variance > 0, (F.col("sx") - p * F.col("sn")) / F.sqrt(variance)).otherwise(0.0).alias("z"))


def monotone(df: DataFrame, score: str, successes: str, trials: str, tolerance: float = 0.0) -> DataFrame:
    """(trials, successes, z, rising, passes): a positive trend whose rates rise from each group to the next."""
    rate = F.try_divide(successes, trials)
    step = df.withColumn("_d", rate - F.lag(rate).over(Window.orderBy(score)))
    rising = step.agg(F.bool_and(F.coalesce(F.col("_d") > -tolerance if tolerance else F.col("_d") > 0, F.lit(True))).alias("rising"))
    return cochran_armitage(df, score, successes, trials).crossJoin(F.broadcast(rising)).withColumn("passes", (F.col("z") > 0) & F.col("rising"))


def average_ranks(df: DataFrame, keys: list[str], x: str, name: str) -> DataFrame:
    """Mean ranks of ties: counts by value are summed up to each value, bucket by bucket."""
    counts = df.groupBy(*keys, x).agg(F.count("*").alias("_c"))
    ranked = ranks.running(counts, keys, [x], F.col("_c"), "_upto").select(*keys, x, (F.col("_upto") - (F.col("_c") - 1) / 2).alias(name))
    return df.join(ranked, [*keys, x])


def auroc(df: DataFrame, keys: list[str], score: str, label: str, weight: str | None = None) -> DataFrame:
    """(n_pos, n_neg, auroc) by Mann-Whitney over average ranks; null where there is a single class. A row of weight k counts
    as k equal rows."""
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn("_w", F.col(weight) if weight else F.lit(1))
    counts = known.groupBy(*keys, score).agg(F.sum("_w").alias("_c"), F.sum(F.when(F.col(label) == 1, F.col("_w")).otherwise(0)).alias("_p"))
    ranked = ranks.running(counts, keys, [score], F.col("_c"), "_upto").withColumn("_r", F.col("_upto") - (F.col("_c") - 1) / 2)
    out = ranked.groupBy(*keys).agg(F.sum("_p").alias("n_pos"), (F.sum("_c") - F.sum("_p")).alias("n_neg"), F.sum(F.col("_r") * F.col("_p")).alias("_s"))
    u = F.col("_s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2
    return out.select(*keys, "n_pos", "n_neg", F.try_divide(u, F.col("n_pos") * F.col("n_neg")).alias("auroc"))


def pearson(x: Column, y: Column) -> Column:
    """Null where either side is constant or there are fewer than two rows."""
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(n, spearman)."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
    ranked = average_ranks(average_ranks(known, keys, "_x", "_rx"), keys, "_y", "_ry")
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), pearson(F.col("_rx"), F.col("_ry")).alias("spearman"))


def r_squared(df: DataFrame, keys: list[str], y: str, predicted: str) -> DataFrame:
    """1 - residual over total sum of squares, which is not the squared correlation."""
    d = F.col(y) - F.col(predicted)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), (1 - F.try_divide(F.sum(d * d), F.var_pop(y) * F.count(y))).alias("r2"))


def spearman_brown(df: DataFrame, a: str, b: str) -> DataFrame:
    """Split-half correlation and the reliability of the whole."""
    out = df.agg(F.count("*").alias("n"), pearson(F.col(a), F.col(b)).alias("r"))
    return out.withColumn("reliability", F.try_divide(2 * F.col("r"), 1 + F.col("r")))


def family_mean_predictions(train: DataFrame, test: DataFrame, family: str, y: str) -> DataFrame:
    """test with predicted: the family's mean in train, the overall mean for a family train lacks."""
    means, whole = train.groupBy(family).agg(F.avg(y).alias("_m")), train.agg(F.avg(y).alias("_w"))
    return test.join(means, family, "left").crossJoin(F.broadcast(whole)).withColumn("predicted", F.coalesce("_m", "_w")).drop("_m", "_w")


def within_family(df: DataFrame, family: str, columns: list[str]) -> DataFrame:
    """Columns less their family's mean."""
    means = df.groupBy(family).agg(*(F.avg(c).alias(f"_{c}") for c in columns))
    out = df.join(means, family)
    return out.select(*(F.col(c) - F.col(f"_{c}") if c in columns else F.col(c) for c in df.columns)).toDF(*df.columns)


def residuals(df: DataFrame, y: str, x: list[str], name: str) -> DataFrame:
    """y less its least-squares fit on one or two columns; normal equations from one aggregate."""
    if len(x) == 1:
        a, b = x[0], None
        t = df.agg(F.avg(y).alias("_my"), F.avg(a).alias("_ma"), F.try_divide(F.covar_pop(a, y), F.var_pop(a)).alias("_b"))
        return df.crossJoin(F.broadcast(t)).withColumn(name, F.col(y) - F.col("_my") - F.coalesce("_b", F.lit(0.0)) * (F.col(a) - F.col("_ma"))).select(*df.columns, name)
    a, b = x
    cov = lambda p, q: F.covar_pop(p, q)
    t = df.agg(F.avg(y).alias("_my"), F.avg(a).alias("_ma"), F.avg(b).alias("_mb"), cov(a, a).alias("aa"), cov(b, b).alias("bb"), cov(a, b).alias("ab"), cov(a, y).alias("ay"), cov(b, y).alias("by"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    t = t.select("_my", "_ma", "_mb", F.coalesce(F.try_divide(F.col("ay") * F.col("bb") - F.col("by") * F.col("ab"), det), F.lit(0.0)).alias("_ba"), F.coalesce(F.try_divide(F.col("by") * F.col("aa") - F.col("ay") * F.col("ab"), det), F.lit(0.0)).alias("_bb"))
    fit = F.col("_my") + F.col("_ba") * (F.col(a) - F.col("_ma")) + F.col("_bb") * (F.col(b) - F.col("_mb"))
    return df.crossJoin(F.broadcast(t)).withColumn(name, F.col(y) - fit).select(*df.columns, name)


def lofo_spearman(df: DataFrame, family: str, y: str, predicted: str, tolerance: float = 0.0) -> DataFrame:
    """For each held family: its Spearman, and the share of its values outside the range the other families cover."""
    spans = df.groupBy(family).agg(F.min(y).alias("lo"), F.max(y).alias("hi"))
    others = spans.alias("a").join(spans.alias("b"), F.col(f"a.{family}") != F.col(f"b.{family}")).groupBy(F.col(f"a.{family}").alias(family)).agg(F.min("b.lo").alias("_lo"), F.max("b.hi").alias("_hi"))
    outside = df.join(others, family).groupBy(family).agg(F.avg(((F.col(y) < F.col("_lo") - tolerance) | (F.col(y) > F.col("_hi") + tolerance)).cast("double")).alias("uncovered"))
    return spearman(df, [family], y, predicted).join(outside, family)


def sign_flip(df: DataFrame, family: str, difference: str, permutations: int, seed: int) -> DataFrame:
    """(n, observed, p): paired sign-flip permutation test, the signs being bits of a hash of permutation and family.

    Families are few (one row each); permutations are dealt out, and each reads the families' one array.
    """
    row = df.where(F.col(difference).isNotNull()).agg(F.array_sort(F.collect_list(F.struct(F.col(family).cast("string").alias("f"), F.col(difference).cast("double").alias("d")))).alias("fs"))
    flips = df.sparkSession.range(permutations).crossJoin(F.broadcast(row))
    sign = lambda x: F.when(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), x["f"])), 1, 1), 16, 10).cast("int") < 8, 1.0).otherwise(-1.0)
    total = F.aggregate("fs", F.lit(0.0), lambda a, x: a + sign(x) * x["d"])
    observed = F.aggregate("fs", F.lit(0.0), lambda a, x: a + x["d"])
    n = F.size("fs")
    out = flips.agg(F.first(n).alias("n"), F.first(F.try_divide(observed, n)).alias("observed"), F.sum(F.when(F.abs(total) >= F.abs(observed) - 1e-12, 1).otherwise(0)).alias("_e"))
    return out.select("n", "observed", ((F.col("_e") + 1) / (permutations + 1)).alias("p"))
