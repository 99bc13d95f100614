"""Premise and hypothesis pairs for an external scorer, and what comes back from it; lookups with sentinels and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakequill.operators.votes import count_if


def expand(df: DataFrame, keys: list[str], premises: str, hypothesis: str) -> DataFrame:
    """(keys.., source_idx, direction, premise, hypothesis): both directions of every premise against the hypothesis."""
    rows = df.select(*keys, F.posexplode(premises).alias("source_idx", "_p"), F.col(hypothesis).alias("_h"))
    ways = F.array(F.struct(F.lit(0).alias("direction"), F.col("_p").alias("premise"), F.col("_h").alias("hypothesis")), F.struct(F.lit(1).alias("direction"), F.col("_h").alias("premise"), F.col("_p").alias("hypothesis")))
    return rows.select(*keys, "source_idx", F.explode(ways).alias("w")).select(*keys, "source_idx", "w.*")


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """What the scorer has to see: each pair once."""
    return pairs.select("premise", "hypothesis").distinct()


def scored(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """pairs with score; a pair without one raises."""
    got = scores.select("premise", "hypothesis", F.col("score").alias("_s"))
    score = F.when(F.col("_s").isNull(), F.raise_error(F.lit("unscored pair")).cast("double")).otherwise(F.col("_s"))
    return pairs.join(got, ["premise", "hypothesis"], "left").withColumn("score", score).drop("_s")


def missing_as_error(tasks: DataFrame, arms: list[str], log: DataFrame, key: str, arm: str, value: str) -> DataFrame:
    """(arm, n, errors, total): every task in every arm; a task without a row is an error and adds nothing."""
    every = tasks.select(key).distinct().withColumn(arm, F.explode(F.array(*map(F.lit, arms))))
    joined = every.join(log.select(key, arm, F.col(value).alias("_v"), F.lit(True).alias("_there")), [key, arm], "left")
    return joined.groupBy(arm).agg(F.count("*").alias("n"), count_if(F.col("_there").isNull()).alias("errors"), F.coalesce(F.sum("_v"), F.lit(0)).alias("total"))


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, sentinel: object = -1) -> DataFrame:
    """df with value by key, the sentinel where the table has no such key."""
    return df.join(table.select(key, F.col(value).alias("_v")), key, "left").withColumn(value, F.coalesce("_v", F.lit(sentinel))).drop("_v")


def regenerated(derived: DataFrame, logged: DataFrame, key: str, column: str) -> DataFrame:
    """(key, matches): whether a record derived anew hashes to what the log says; a record the log lacks doesn't match."""
    mine = derived.select(key, F.sha2(F.col(column), 256).alias("_h"))
    return mine.join(logged.select(key, F.col("hash").alias("_l")), key, "left").select(key, F.coalesce(F.col("_h") == F.col("_l"), F.lit(False)).alias("matches"))


def standardised(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """test less train's means over train's population deviations; a constant column keeps scale one."""
    row = train.agg(*(f for c in columns for f in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))))
    scale = lambda c: F.when(F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"_s_{c}"))
    out = test.crossJoin(F.broadcast(row))
    return out.select(*(((F.col(c) - F.col(f"_m_{c}")) / scale(c)).alias(c) if c in columns else F.col(c) for c in test.columns))


def oriented(df: DataFrame, score: str, label: str, mask: Column) -> DataFrame:
    """(subset, n_pos, n_neg, auroc): risk orientation (minus the score) over all known rows, and over the masked ones."""
    from lakequill.operators.stats import auroc

    risk = df.where(F.col(score).isNotNull()).select((-F.col(score)).alias("_r"), label, F.coalesce(mask, F.lit(False)).alias("_m"))
    subsets = risk.withColumn("subset", F.explode(F.when(F.col("_m"), F.array(F.lit("all"), F.lit("masked"))).otherwise(F.array(F.lit("all")))))
    return auroc(subsets, ["subset"], "_r", label)


def degenerate(volume: Column, floor: float) -> Column:
    """No volume, or one at or below the floor."""
    return F.coalesce(volume <= floor, F.lit(True))


def bands(df: DataFrame, band: str, x: str) -> DataFrame:
    return df.where(F.col(band).isNotNull()).groupBy(band).agg(F.count(x).alias("n"), F.min(x).alias("low"), F.avg(x).alias("mean"), F.max(x).alias("high"))


def evidence_mass(df: DataFrame, correct: Column, least: int) -> DataFrame:
    """(n_negatives, evaluable): whether there are enough wrong answers to judge anything by."""
    return df.agg(count_if(~correct).alias("n_negatives")).withColumn("evaluable", F.col("n_negatives") >= least)
