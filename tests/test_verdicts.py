"""Exact tests inside the plan against sums of exact terms; verdict tables."""

from fractions import Fraction
from math import comb

from pyspark.sql import functions as F

from lakequill.operators import ranks, stats, verdicts


def tail(k, n, p):
    q = Fraction(p)
    return float(sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(max(k, 0), n + 1)))


def test_tails_and_inversions(spark):
    rows = [(k, n, p) for n in (1, 2, 19, 20, 21, 150) for p in (0.01, 0.3, 0.5, 0.97) for k in sorted({0, 1, n // 3, n // 2, n - 1, n, n + 1})]
    df = spark.createDataFrame(rows, "k long, n long, p double").select("*", verdicts.upper_tail(*map(F.col, "knp")).alias("t"))
    assert all(abs(r.t - tail(r.k, r.n, r.p)) < 1e-11 for r in df.collect())
    pairs = [(n, p, a) for n in (1, 5, 40, 200) for p in (0.05, 0.5, 0.9) for a in (0.05, 0.0125)]
    got = spark.createDataFrame(pairs, "n long, p double, a double").select("*", verdicts.critical_count(*map(F.col, "npa")).alias("k")).collect()
    assert all(tail(r.k, r.n, r.p) <= r.a < tail(r.k - 1, r.n, r.p) for r in got)
    pairs = [(x, n) for n in (1, 7, 60, 300) for x in sorted({0, 1, n // 2, n - 1, n}) if x <= n]
    got = spark.createDataFrame(pairs, "x long, n long").select("*", verdicts.upper_bound(F.col("x"), F.col("n")).alias("b")).collect()
    assert all(abs(r.b - stats.upper_95(r.x, r.n)) < 1e-9 for r in got)


def test_large_counts_and_nulls(spark):
    df = spark.createDataFrame([(500_500, 1_000_000, 0.5), (None, 5, 0.5), (2, None, 0.5)], "k long, n long, p double")
    big, *none = [r.t for r in df.select(verdicts.upper_tail(*map(F.col, "knp")).alias("t")).collect()]
    assert abs(big - 0.158897) < 1e-5 and none == [None, None]


def test_verdicts(spark):
    counts = [(a, d, x, n) for a in "pqrsu" for d, x, n in ((1, 1, 100), (2, 10, 100), (3, 40, 100)) if (a, d) != ("u", 2)] + [("t", d, 20, 100) for d in (1, 2, 3)]
    axes = [("p", 0.2, 0.05, 5, 5, "PASS"), ("q", 0.2, 0.05, 5, 4, "FAIL"), ("r", 0.2, 0.05, None, 5, None), ("s", 0.4, 0.05, 5, 5, "PASS"), ("t", 0.1, 0.05, 5, 5, "PASS"), ("u", 0.2, 0.05, 5, 5, "PASS"), ("v", 0.2, 0.05, 5, 0, "PASS")]
    out = verdicts.axis_verdicts(spark.createDataFrame(counts, "axis string, dose int, x long, n long"), spark.createDataFrame(axes, "axis string, theta double, alpha double, expected int, present int, oracle string"))
    assert {r.axis: (r.status, r.breaks) for r in out.collect()} == {"p": ("SCORED", True), "q": ("PARTIAL_WITHHELD", True), "r": ("ORACLE_WITHHELD", True), "s": ("SCORED", False), "t": ("SCORED", False), "u": ("SCORED", None), "v": ("PENDING", None)}
    final = verdicts.program_verdict(out.where("axis IN ('p', 's', 't')")).first()
    assert tuple(final) == ("FINAL", ["p"], True) and tuple(verdicts.program_verdict(out).first()) == ("PENDING", ["p"], None)


def test_buckets_are_even(spark):
    """One value in all rows, and names with a common beginning, are dealt out by the rest of the order."""
    df = spark.range(40_000).select("id", F.lit(1.0).alias("x"), F.format_string("Customer#%09d", "id").alias("name"))
    for order in (["x", "id"], ["name"], ["x", "name"]):
        sizes = [r["count"] for r in ranks.bucketed(df, order).groupBy("_b").count().collect()]
        assert len(sizes) > 50 and max(sizes) < 4_000, order
    got = ranks.running(df.select("x"), [], ["x"], F.col("x"), "s").agg(F.count("*"), F.count_distinct("s"), F.max("s")).first()
    assert tuple(got) == (40_000, 40_000, 40_000.0)


def test_bounds_of_different_pairs_only(spark):
    rows = spark.range(600).selectExpr("id", "id % 3 AS x", "if(id % 7 = 0, NULL, 5) AS n")
    got = verdicts.upper_bounds(rows, "x", "n")
    assert "Aggregate [_x" in got._jdf.queryExecution().optimizedPlan().toString()
    assert str(verdicts.upper_bound(F.col("x"), F.col("n"))).count("sequence(1, 60") == 1  # not once for each end of the interval
    alone = {r["id"]: r for r in rows.limit(21).select("id", verdicts.upper_bound(F.col("x"), F.col("n")).alias("b")).collect()}
    out = got.collect()
    assert len(out) == 600 and all((r["bound"] is None) == (r["n"] is None) for r in out)
    assert all(r["bound"] == alone[r["id"]]["b"] for r in out if r["id"] in alone)
    assert all(abs(r["tail"] - 0.95) < 1e-9 for r in out if r["n"] is not None)
