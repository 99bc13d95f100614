"""Constraint suites, differences between runs, coverage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakequill.operators import ranks
from lakequill.operators.votes import count_if


def constraints(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(name, violations, checked): nulls violate."""
    row = df.agg(F.count("*").alias("_n"), *(count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()))
    pairs = F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("violations")) for k in checks))
    return row.select(F.explode(pairs).alias("c"), "_n").select("c.name", "c.violations", F.col("_n").alias("checked"))


def exact_mean(x: Column) -> Column:
    """The mean of doubles as they are written, to 12 places, from a decimal sum: the same in any order of rows, so that equal means are
    equal and a mean on a threshold reaches it. Values or sums of over 14 digits before the point, NaN and infinities: avg."""
    d = x.try_cast("decimal(26,12)")
    mean = F.try_divide(F.try_sum(d).try_cast("decimal(26,12)"), F.count(d).cast("decimal(10,0)")).cast("double")
    return F.when(F.count(d) == F.count(x), F.coalesce(mean, F.avg(x))).otherwise(F.avg(x))


def compare(left: DataFrame, right: DataFrame, keys: list[str], value: str, flip: float | None = None) -> DataFrame:
    """(key.., status, delta): only_left, only_right, flip, differs or equal; a flip crosses the threshold."""
    a, b = left.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_l")), right.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_r"))
    both = a.join(b, keys, "full_outer")
    crosses = F.lit(False) if flip is None else (F.col("_a") >= flip) != (F.col("_b") >= flip)
    status = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").when(F.coalesce(crosses, F.lit(False)), "flip").when(F.col("_a").eqNullSafe(F.col("_b")), "equal").otherwise("differs")
    return both.select(*keys, status.alias("status"), (F.col("_b") - F.col("_a")).alias("delta"))


def repeated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def shard_coverage(df: DataFrame, shard: str, key: str, expected: DataFrame) -> DataFrame:
    """(rows, keys, disjoint, missing): whether shards share no key, and how many expected keys none has."""
    pairs = df.select(shard, key).distinct()
    row = pairs.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"))
    missing = expected.select(key).distinct().join(pairs, key, "left_anti").agg(F.count("*").alias("missing"))
    return row.crossJoin(missing).select("rows", "keys", (F.col("rows") == F.col("keys")).alias("disjoint"), "missing")


def running_total(df: DataFrame, keys: list[str], order: str, x: str) -> DataFrame:
    """Sum so far and what remains. Rows of equal order come in any order."""
    out = ranks.running(df, keys, [order], F.col(x), "so_far", "_whole")
    return out.withColumn("remaining", F.col("_whole") - F.col("so_far")).drop("_whole")
