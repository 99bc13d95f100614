"""Exact binomial tests inside the plan, and verdict tables for any number of axes at once. Nothing here comes to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakequill.functions.text import once

#: Terms that a tail is summed over: beyond so many deviations and terms they add nothing that a double holds.
DEVIATIONS, LEAST_TERMS, STEPS = 40, 60, 60
#: Tasks that different pairs of counts are dealt out to.
PAIR_TASKS = 24


def _log_factorial(n: Column) -> Column:
    """By Stirling's series from 20 on (error below 1e-15 of the value), below that by products."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(F.lit(2 * 3.141592653589793) * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0)))
    small = F.element_at(F.array(*(F.lit(v) for v in _small())), F.least(n, F.lit(19)).cast("int") + 1)
    return F.when(n < 20, small).otherwise(series)


def _small() -> list[float]:
    from math import lgamma

    return [lgamma(i + 1) for i in range(20)]


def upper_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) of a binomial count, summed from the side where terms fall; memory grows with the root of n."""
    k, n = k.cast("long"), n.cast("long")
    reach = F.ceil(F.sqrt(n.cast("double")) * DEVIATIONS).cast("long") + LEAST_TERMS
    high = k > n * p

    def side(start: Column, end: Column, ratio) -> Column:  # noqa: ANN001
        first = F.exp(_log_factorial(n) - _log_factorial(start) - _log_factorial(n - start) + F.when(start == 0, 0.0).otherwise(start * F.log(p)) + F.when(start == n, 0.0).otherwise((n - start) * F.log1p(-p)))
        step = lambda a, i: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * ratio(i)).alias("term"))
        return F.aggregate(F.sequence(F.lit(0).cast("long"), F.least(F.abs(end - start), reach)), F.struct(F.lit(0.0).alias("sum"), first.alias("term")), step)["sum"]

    odds = p / (1 - p)
    up = lambda i: (n - k - i) / (k + i + 1).cast("double") * odds
    down = lambda i: (k - 1 - i) / (n - k + 2 + i).cast("double") / odds
    inside = F.when(high, side(F.least(k, n), n, up)).otherwise(1 - side(F.greatest(k - 1, F.lit(0)), F.lit(0).cast("long"), down))
    known = k.isNotNull() & n.isNotNull() & p.isNotNull()
    return F.when(~known, None).when(k <= 0, 1.0).when((k > n) | (p <= 0), 0.0).when(p >= 1, 1.0).otherwise(F.greatest(F.least(inside, F.lit(1.0)), F.lit(0.0)))


def _bisected(low: Column, high: Column, middle, left, steps: int) -> Column:  # noqa: ANN001
    """(low, high) after so many halvings; left(m) says that what is sought lies at m or below."""

    def step(a: Column, _: Column) -> Column:
        m = middle(a["low"], a["high"])
        go = F.get(F.transform(F.array(m), left), F.lit(0))
        return F.struct(F.when(go, a["low"]).otherwise(m).alias("low"), F.when(go, m).otherwise(a["high"]).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(low.alias("low"), high.alias("high")), step)


def critical_count(n: Column, p: Column, alpha: Column) -> Column:
    """The least k whose upper tail is at alpha or below, up to rounding; n + 1 if there is none."""
    n = n.cast("long")
    found = _bisected(F.lit(-1).cast("long"), n + 1, lambda a, b: F.floor((a + b) / 2).cast("long"), lambda m: upper_tail(m, n, p) <= alpha * (1 + 1e-12), 50)
    return F.when(n.isNotNull() & p.isNotNull(), found["high"])


def upper_bound(x: Column, n: Column, level: float = 0.95) -> Column:
    """One-sided exact bound of a proportion: where x or fewer of n are as likely as 1 - level; 1 if all are, null of none."""
    found = _bisected(F.lit(0.0), F.lit(1.0), lambda a, b: (a + b) / 2, lambda p: upper_tail(x + 1, n, p) >= level, STEPS)
    return F.when(n > 0, F.when(x >= n, 1.0).otherwise(once(found, lambda f: (f["low"] + f["high"]) / 2)))


def upper_bounds(rows: DataFrame, x: str, n: str, level: float = 0.95) -> DataFrame:
    """rows with bound (upper_bound) and tail (what it leaves above x, null where all of n are successes). Each different (x, n) is
    bisected once, however many rows have it."""
    pairs = rows.select(F.col(x).alias("_x"), F.col(n).alias("_n")).distinct()
    # in shares by hash: few pairs are much work, and come in partitions that would be coalesced by their bytes
    bounds = pairs.repartition(PAIR_TASKS, "_x", "_n").withColumn("bound", upper_bound(F.col("_x"), F.col("_n"), level))
    bounds = bounds.withColumn("tail", F.when(F.col("_x") < F.col("_n"), upper_tail(F.col("_x") + 1, F.col("_n"), F.col("bound"))))
    return rows.join(bounds, F.col(x).eqNullSafe(F.col("_x")) & F.col(n).eqNullSafe(F.col("_n")), "left").drop("_x", "_n")


def axis_verdicts(counts: DataFrame, axes: DataFrame) -> DataFrame:
    """A row for each axis of `axes` (axis, theta, alpha, expected, present, oracle), from counts (axis, dose 1 to 3, x, n).

    status: PENDING without results, PARTIAL_WITHHELD while fewer than expected are there, ORACLE_WITHHELD unless the oracle
    passed, else SCORED. A dose without trials voids the axis: breaks is null. An axis breaks where the trend rises from each
    dose to the next and the top count reaches its critical one.
    """
    doses = (1, 2, 3)
    at = lambda c, d: F.coalesce(F.sum(F.when(F.col("dose") == d, F.col(c))), F.lit(0)).cast("long").alias(f"{c}{d}")
    wide = counts.groupBy("axis").agg(*(at(c, d) for c in "xn" for d in doses))
    rows = axes.join(wide, "axis", "left").na.fill(0, [f"{c}{d}" for c in "xn" for d in doses])
    x, n = ([F.col(f"{c}{d}").cast("double") for d in doses] for c in "xn")
    total = lambda values: values[0] + values[1] + values[2]
    p = F.try_divide(total(x), total(n))
    sn, ssn, sx = (total([d**k * v for d, v in zip(doses, values, strict=True)]) for k, values in ((1, n), (2, n), (1, x)))
    spread = p * (1 - p) * (ssn - F.try_divide(sn * sn, total(n)))
    z = F.when(spread > 0, (sx - p * sn) / F.sqrt(spread)).otherwise(0.0)
    rates = [F.try_divide(a, b) for a, b in zip(x, n, strict=True)]
    void = F.least(*n) == 0
    rising = F.coalesce((rates[0] < rates[1]) & (rates[1] < rates[2]), F.lit(False))
    judged = rows.withColumns({"void": void, "z": F.when(~void, z), "rising": F.when(~void, rising), "critical": F.when(~void, critical_count(F.col("n3"), F.col("theta"), F.col("alpha")))})
    judged = judged.withColumn("breaks", (F.col("z") > 0) & F.col("rising") & (F.col("x3") >= F.col("critical")))
    none = F.coalesce("present", F.lit(0)) == 0
    status = F.when(none, "PENDING").when(F.col("present") < F.col("expected"), "PARTIAL_WITHHELD").when(F.coalesce("oracle", F.lit("MISSING")) != "PASS", "ORACLE_WITHHELD").otherwise("SCORED")
    return judged.withColumn("status", status).withColumn("breaks", F.when(~none, F.col("breaks")))


def program_verdict(verdicts: DataFrame, *keys: str) -> DataFrame:
    """(status, broke, any_break) for each program: FINAL once every axis is scored and none void, else PENDING with what broke so far."""
    scored = (F.col("status") == "SCORED") & F.col("breaks").isNotNull()
    out = verdicts.groupBy(*keys).agg(F.bool_and(scored).alias("_all"), F.array_sort(F.collect_list(F.when(scored & F.col("breaks"), F.col("axis")))).alias("broke"))
    return out.select(*keys, F.when(F.col("_all"), "FINAL").otherwise("PENDING").alias("status"), "broke", F.when(F.col("_all"), F.size("broke") > 0).alias("any_break"))
