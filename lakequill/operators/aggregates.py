"""Rates, tables, distributions, histograms and gates as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakequill.operators.votes import count_if


def pooled_rates(df: DataFrame, arm: str, successes: str, trials: str) -> DataFrame:
    """Ratio of sums by arm, which is not the mean of the tasks' rates."""
    out = df.groupBy(arm).agg(F.sum(successes).alias("successes"), F.sum(trials).alias("trials"))
    return out.withColumn("rate", F.try_divide("successes", "trials"))


def mean_rates(df: DataFrame, arm: str, task: str, flag: Column, empty: float | None = None) -> DataFrame:
    """Mean over tasks of the share of flags; tasks whose flags are all null count as `empty`."""
    per_task = df.groupBy(arm, task).agg(F.avg(flag.cast("double")).alias("_r"))
    rate = F.coalesce("_r", F.lit(empty)) if empty is not None else F.col("_r")
    return per_task.groupBy(arm).agg(F.count("*").alias("n_tasks"), F.avg(rate).alias("mean_rate"))


def fraction_asserted(df: DataFrame, keys: list[str], flag: Column) -> DataFrame:
    """Asserted items, items and their share; a key whose items are all missing raises."""
    n = F.count(flag)
    share = F.when(n > 0, count_if(flag) / n).otherwise(F.raise_error(F.lit("no items")).cast("double"))
    return df.groupBy(*keys).agg(count_if(flag).alias("asserted"), n.alias("items"), share.alias("fraction"))


def densify(df: DataFrame, keys: DataFrame, on: list[str], fill: dict[str, object]) -> DataFrame:
    """A row for each key, filled where there was none."""
    return keys.join(df, on, "left").fillna(fill)


def dose_counts(df: DataFrame, dose: str, violation: Column, doses: list[int]) -> DataFrame:
    counted = df.groupBy(dose).agg(count_if(violation).alias("violations"), F.count("*").alias("trials"))
    every = df.sparkSession.createDataFrame([(d,) for d in doses], f"{dose} int")
    return densify(counted, F.broadcast(every), [dose], {"violations": 0, "trials": 0})


def value_table(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by row, a column for each named value."""
    return df.groupBy(row).agg(*(count_if(F.col(column) == v).alias(f"n_{v}") for v in values), F.count("*").alias("n"))


def distribution(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Exact quartiles (interpolated), extremes, mean and population deviation."""
    q = lambda p: F.percentile(x, F.lit(p))
    return df.groupBy(*keys).agg(F.min(x).alias("min"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count(x).alias("n"))


def index_quantiles(df: DataFrame, keys: list[str], x: str, tails: list[float]) -> DataFrame:
    """Largest, mean, and the sorted values at n/2 and at 0.95 n by index, with counts beyond the tails.

    Values are counted first, so that the window runs over distinct values.
    """
    counted = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys).orderBy(x)
    upto = counted.withColumn("_to", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    at = lambda i: F.max(F.when((F.col("_to") - F.col("_c") <= i) & (i < F.col("_to")), F.col(x)))
    return upto.groupBy(*keys).agg(
        F.sum("_c").alias("n"), F.max(x).alias("max"), (F.sum(F.col(x) * F.col("_c")) / F.sum("_c")).alias("mean"),
        at(F.floor(F.col("_n") / 2)).alias("p50"), at(F.floor(F.col("_n") * F.lit(0.95))).alias("p95"),
        *(F.sum(F.when(F.col(x) > t, F.col("_c")).otherwise(0)).alias(f"over_{t:g}") for t in tails),
    )


def histogram(df: DataFrame, x: str, width: float, bins: int) -> DataFrame:
    """(bin, n) with every bin; the last one is closed, negative values fall into the first."""
    b = F.greatest(F.least(F.floor(F.col(x) / width), F.lit(bins - 1)), F.lit(0)).cast("int")
    counted = df.where(F.col(x).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return densify(counted, df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")), ["bin"], {"n": 0})


def eta_squared(df: DataFrame, family: str, y: str) -> DataFrame:
    """Share of variance between families, from the families' moments alone."""
    g = df.where(F.col(y).isNotNull()).groupBy(family).agg(F.count(y).alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
    total = g.agg(F.sum(F.col("n") * F.col("m")).alias("s"), F.sum("n").alias("n"))
    both = g.crossJoin(F.broadcast(total.select((F.col("s") / F.col("n")).alias("mean"))))
    between, within = F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2), F.sum(F.col("n") * F.col("v"))
    return both.agg(F.sum("n").alias("n"), F.count("*").alias("families"), F.try_divide(between, between + within).alias("eta_squared"))


def exclusions(df: DataFrame, family: str, reasons: dict[str, Column]) -> DataFrame:
    """How many rows of each family every reason leaves out, and how many are left."""
    any_ = F.lit(False)
    for c in reasons.values():
        any_ = any_ | F.coalesce(c, F.lit(False))
    return df.groupBy(family).agg(F.count("*").alias("n"), *(count_if(F.coalesce(c, F.lit(False))).alias(f"out_{k}") for k, c in reasons.items()), count_if(~any_).alias("kept"))


def bidirectional(df: DataFrame, item: str, source: str, direction: str, score: str) -> DataFrame:
    """Both directions averaged by source, the best source by item; a missing direction raises."""
    both = F.when(F.count_distinct(direction) == 2, F.avg(score)).otherwise(F.raise_error(F.concat(F.lit("one direction only: "), F.first(item).cast("string"))).cast("double"))
    return df.groupBy(item, source).agg(both.alias("s")).groupBy(item).agg(F.max("s").alias("score"), F.count("*").alias("n_sources"))


def nested(df: DataFrame, key: str, order: str, value: str, name: str = "items") -> DataFrame:
    """Values of a key in order as one array; keys are meant to have few."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias(name))


def signatures(df: DataFrame, columns: list[str]) -> DataFrame:
    sig = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in columns))
    return df.groupBy(sig.alias("signature")).agg(F.count("*").alias("n"))


def gates(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(gate, all_pass, any_pass, n_fail) for each named row condition."""
    flat = df.select(F.explode(F.create_map(*(x for k, c in checks.items() for x in (F.lit(k), F.coalesce(c, F.lit(False)))))).alias("gate", "ok"))
    return flat.groupBy("gate").agg(F.bool_and("ok").alias("all_pass"), F.bool_or("ok").alias("any_pass"), count_if(~F.col("ok")).alias("n_fail"))


def accuracy(df: DataFrame, a: str, b: str, correct: Column, counted: Column) -> DataFrame:
    """Accuracy by a, by b, by both and over all, over counted rows only."""
    return df.cube(a, b).agg(count_if(counted).alias("n"), count_if(counted & correct).alias("correct"), F.try_divide(count_if(counted & correct), count_if(counted)).alias("accuracy"), F.grouping_id().alias("level"))
