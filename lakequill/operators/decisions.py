"""Verdict tables: ordered rules over aggregates, thresholds swept over a grid."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verdict(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds; a rule over nulls doesn't."""
    out = None
    for name, rule in rules:
        ok = F.coalesce(rule, F.lit(False))
        out = F.when(ok, name) if out is None else out.when(ok, name)
    return out.otherwise(otherwise)


def withheld(value: Column, pending: Column, partial: Column, oracle: Column) -> Column:
    """A verdict, unless data are pending or partial, or the oracle disagrees."""
    return verdict([("PENDING", pending), ("PARTIAL", partial), ("ORACLE_MISMATCH", ~oracle)], "") if value is None else F.when(pending, "PENDING").when(partial, "PARTIAL").when(~oracle, "ORACLE_MISMATCH").otherwise(value)


def sweep(df: DataFrame, grid: dict[str, list], branch: Column) -> DataFrame:
    """branch for each row of aggregates and each point of the grid; df is small by then."""
    points = df.sparkSession.createDataFrame(list(product(*grid.values())), list(grid))
    return df.crossJoin(F.broadcast(points)).withColumn("branch", branch)


def stability(swept: DataFrame, keys: list[str]) -> DataFrame:
    """(points, branches, stable, commonest): whether the verdict moves with the thresholds."""
    by = swept.groupBy(*keys, "branch").agg(F.count("*").alias("_n"))
    out = by.groupBy(*keys).agg(F.sum("_n").alias("points"), F.count("*").alias("branches"), F.min(F.struct(-F.col("_n"), F.col("branch"))).alias("_m"))
    return out.select(*keys, "points", "branches", (F.col("branches") == 1).alias("stable"), F.col("_m.branch").alias("commonest"))


def cell(a_correct: Column, a_wrong: Column) -> Column:
    """Two-letter code of a case: T or F for the right and for the wrong answer."""
    return F.concat(F.when(a_correct, "T").otherwise("F"), F.when(a_wrong, "T").otherwise("F"))


def gate_table(row: DataFrame, bars: dict[str, tuple[str, float]]) -> DataFrame:
    """(gate, bar, observed, passes) from a row of observed values; bars are (>= or <=, value)."""
    one = lambda c, op, v: F.struct(F.lit(c).alias("gate"), F.lit(float(v)).alias("bar"), F.col(c).cast("double").alias("observed"), F.coalesce(F.col(c) >= v if op == ">=" else F.col(c) <= v, F.lit(False)).alias("passes"))
    return row.select(F.explode(F.array(*(one(c, *b) for c, b in bars.items()))).alias("g")).select("g.*")
