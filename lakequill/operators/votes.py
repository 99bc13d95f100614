"""Votes, verdicts, confusion tables and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_if(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")


def majority(df: DataFrame, keys: list[str], flag: Column, name: str = "majority") -> DataFrame:
    """More than half of the flags; no rows are no majority."""
    return df.groupBy(*keys).agg((count_if(flag) * 2 > F.count("*")).alias(name))


def stability(df: DataFrame, task: str, item: str, state: Column, flag: Column) -> DataFrame:
    """(task, n_items, n_flipped, n_stable, verdict). state is true for the changed world: an item flips if its majority does.

    A task is pass if all its items flip, exclude if none does, else partial. Items need draws in both states.
    """
    per_item = df.groupBy(task, item).agg(
        (count_if(flag & ~state) * 2 > count_if(~state)).alias("before"), (count_if(flag & state) * 2 > count_if(state)).alias("after"),
        count_if(~state).alias("n0"), count_if(state).alias("n1"),
    ).where("n0 > 0 AND n1 > 0")
    flips = F.col("before") & ~F.col("after")
    out = per_item.groupBy(task).agg(F.count("*").alias("n_items"), count_if(flips).alias("n_flipped"), count_if(F.col("before") & F.col("after")).alias("n_stable"))
    verdict = F.when(F.col("n_flipped") == F.col("n_items"), "pass").when(F.col("n_flipped") == 0, "exclude").otherwise("partial")
    return out.withColumn("verdict", verdict)


def adjudicate(df: DataFrame, family: str, item: str, wrong: Column, right: Column, prune_at: int = 2) -> DataFrame:
    """(family, item, n_wrong, pruned) of the families in which the right flags have a majority on some item."""
    per_item = df.groupBy(family, item).agg(count_if(wrong).alias("n_wrong"), (count_if(right) * 2 > F.count("*")).alias("_ok"))
    passing = per_item.groupBy(family).agg(F.bool_or("_ok").alias("_pass")).where("_pass").select(family)
    return per_item.join(passing, family).select(family, item, "n_wrong", (F.col("n_wrong") >= prune_at).alias("pruned"))


def confusion(df: DataFrame, keys: list[str], truth: Column, call: Column) -> DataFrame:
    """Counts and rates; null truth or call is left out, an empty denominator gives null."""
    out = df.where(truth.isNotNull() & call.isNotNull()).groupBy(*keys).agg(
        count_if(truth & call).alias("tp"), count_if(~truth & call).alias("fp"), count_if(truth & ~call).alias("fn"), count_if(~truth & ~call).alias("tn")
    )
    return out.withColumn("fp_rate", F.try_divide("fp", F.col("fp") + F.col("tn"))).withColumn("fn_rate", F.try_divide("fn", F.col("fn") + F.col("tp")))


def consensus(df: DataFrame, key: str, label: str, least: int = 2) -> DataFrame:
    """(key, n_yes, n_no, label): the majority of at least `least` YES or NO votes, null on a tie."""
    out = df.groupBy(key).agg(count_if(F.col(label) == "YES").alias("n_yes"), count_if(F.col(label) == "NO").alias("n_no"))
    enough = F.col("n_yes") + F.col("n_no") >= least
    return out.withColumn("label", F.when(enough & (F.col("n_yes") > F.col("n_no")), "YES").when(enough & (F.col("n_no") > F.col("n_yes")), "NO"))


def kappa(df: DataFrame, keys: list[str], a: str, b: str, gate: float = 0.6) -> DataFrame:
    """Cohen's kappa of two raters by key. Where chance agreement is 1, kappa is 1 if they agree throughout, else 0."""
    rated = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = rated.groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_n"))
    total = cells.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_a").eqNullSafe(F.col("_b")), F.col("_n")).otherwise(0)).alias("agree"))
    sums = cells.select(*keys, F.explode(F.array(F.struct(F.col("_a").alias("v"), F.col("_n").alias("x"), F.lit(0).alias("y")), F.struct(F.col("_b").alias("v"), F.lit(0).cast("long").alias("x"), F.col("_n").alias("y")))).alias("s"))
    chance = sums.groupBy(*keys, "s.v").agg((F.sum("s.x") * F.sum("s.y")).alias("_p")).groupBy(*keys).agg(F.sum("_p").alias("_p"))
    joined = total.join(chance, keys) if keys else total.crossJoin(chance)
    po, pe = F.col("agree") / F.col("n"), F.col("_p") / (F.col("n") * F.col("n"))
    value = F.when(pe == 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    return joined.select(*keys, "n", "agree", value.alias("kappa")).withColumn("passes", F.col("kappa") >= gate)
