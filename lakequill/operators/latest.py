"""Rows that win within a key. Winners are found by a partial aggregate over structs, so a hot key never meets in one task unreduced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _winner(df: DataFrame, keys: list[str], order: list[Column], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)), F.struct(*rest).alias("_row"))
    return df.groupBy(*keys).agg(pick(row).alias("_w")).select(*keys, *(F.col(f"_w._row.{c}").alias(c) for c in rest)).select(*df.columns)


def last_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the largest sequence of each key; equal sequences fall to the largest row."""
    return _winner(df, keys, [F.col(seq)], F.max)


def first_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return _winner(df, keys, [F.col(seq)], F.min)


def top_level(df: DataFrame, family: str, dose: str, seq: str) -> DataFrame:
    """The highest dose of each family, the first in sequence on ties."""
    return _winner(df, [family], [-F.col(dose), F.col(seq)], F.min)


def first_n(df: DataFrame, keys: list[str], n: int, *order: str) -> DataFrame:
    """The first n rows of each key; Spark limits rank groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def todo(tasks: DataFrame, arms: list[str], done: DataFrame, key: str, arm: str = "arm") -> DataFrame:
    """tasks x arms that no done row has. Rows that ended in an error aren't done; pass only good ones."""
    every = tasks.select(key).distinct().withColumn(arm, F.explode(F.array(*map(F.lit, arms))))
    return every.join(done.select(key, arm).distinct(), [key, arm], "left_anti")


def pruned(items: DataFrame, register: DataFrame, keys: list[str]) -> DataFrame:
    """Items by their original index that the register doesn't name; an empty register prunes nothing."""
    return items.join(register.select(*keys).distinct(), keys, "left_anti")


def overlay(base: DataFrame, replacement: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Base rows with columns replaced where the key is in the other table."""
    new = replacement.select(key, F.lit(True).alias("_new"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = base.join(new, key, "left")
    return joined.select(*(F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns))


def union_first(*tables: DataFrame, key: str) -> DataFrame:
    """All rows, earlier tables winning a key."""
    every = None
    for i, t in enumerate(tables):
        t = t.withColumn("_source", F.lit(i))
        every = t if every is None else every.unionByName(t)
    return first_wins(every, [key], "_source").drop("_source")
