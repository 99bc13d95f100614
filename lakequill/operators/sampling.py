"""Seeded sampling. Order is the MD5 of seed and id, the same on any engine and any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakequill.operators import ranks


def seeded(column: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")))


def even_stride(df: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """k rows of each stratum at even strides through its order; all of a smaller one."""
    ranked = ranks.row_numbers(df, keys, [order], "_i", "_n").withColumn("_i", F.col("_i") - 1)
    # row i is taken if some j < k has floor(j n / k) = i
    j = F.ceil(F.col("_i") * k / F.col("_n"))
    return ranked.where((F.col("_n") <= k) | ((j < k) & (F.floor(j * F.col("_n") / k) == F.col("_i")))).drop("_i", "_n")


def round_robin(df: DataFrame, keys: list[str], order: str, shards: int) -> DataFrame:
    return ranks.row_numbers(df, keys, [order], "_i").withColumn("shard", ((F.col("_i") - 1) % shards).cast("int")).drop("_i")


def stratified(df: DataFrame, stratum: str, key: str, seed: int, fraction: float, least: int) -> DataFrame:
    """max(least, floor(n * fraction)) rows of each stratum."""
    ranked = ranks.row_numbers(df.withColumn("_h", seeded(key, seed)), [stratum], ["_h", key], "_k", "_n")
    return ranked.where(F.col("_k") <= F.greatest(F.lit(least), F.floor(F.col("_n") * fraction))).drop("_h", "_k", "_n")


def proportional(df: DataFrame, stratum: str, key: str, seed: int, n: int) -> DataFrame:
    """Exactly n rows (or all): half-even quotas, then the drift is taken from or given to the largest strata, one each."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_t"))
    quota = sizes.crossJoin(F.broadcast(total)).withColumn("_q", F.least(F.bround(F.lit(n) * F.col("_n") / F.col("_t")).cast("long"), F.col("_n")))
    drift = quota.agg((F.least(F.lit(n), F.max("_t")) - F.sum("_q")).alias("_d"))
    order = Window.orderBy(F.desc("_n"), F.col(stratum))
    fixed = quota.crossJoin(F.broadcast(drift)).withColumn("_r", F.row_number().over(order))
    fixed = fixed.withColumn("_q", F.col("_q") + F.when(F.col("_r") <= F.abs("_d"), F.signum("_d")).otherwise(0).cast("long")).select(stratum, "_q")
    ranked = ranks.row_numbers(df.withColumn("_h", seeded(key, seed)), [stratum], ["_h", key], "_k")
    return ranked.join(fixed, stratum).where(F.col("_k") <= F.col("_q")).drop("_k", "_q").select(*df.columns)


def covering(df: DataFrame, forced: Column, cell: str, key: str, seed: int, cap: int) -> DataFrame:
    """Forced rows first, then the first row of every cell, then cells in turn, up to cap rows."""
    ranked = df.withColumn("_f", F.when(forced, 0).otherwise(1)).withColumn("_h", seeded(key, seed))
    turn = F.row_number().over(Window.partitionBy("_f", cell).orderBy("_h", key))
    tier = ranked.withColumn("_t", F.when(F.col("_f") == 0, 0).otherwise(turn))
    return tier.orderBy("_t", "_h", key).limit(cap).select(*df.columns)


def folds(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """fold 0..k-1 by hash: no row has to be moved."""
    digits = F.conv(F.substring(seeded(key, seed), 1, 8), 16, 10).cast("long")
    return df.withColumn("fold", (digits % k).cast("int"))


def leave_one_out_splits(df: DataFrame, family: str, families: list[str]) -> DataFrame:
    """Every row once for each family, role test where it is the held one."""
    return df.withColumn("held", F.explode(F.array(*map(F.lit, families)))).withColumn("role", F.when(F.col(family) == F.col("held"), "test").otherwise("train"))
