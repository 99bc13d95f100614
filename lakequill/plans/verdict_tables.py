"""Verdict tables and exact bounds for many groups at once, over lineitem and supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.operators import verdicts as V
from lakequill.plans.catalog import Tables, query, r6, rounded

_COUNTS = """
c AS (SELECT axis, dose, sum((l_quantity > 46 - 4 * dose)::INT)::BIGINT AS x, count(*) AS n FROM (SELECT l_suppkey % 8 AS axis, l_linenumber % 3 + 1 AS dose, l_quantity FROM lineitem WHERE l_suppkey % 8 <> 0 AND NOT (l_suppkey % 8 = 4 AND l_linenumber % 3 = 1)) GROUP BY ALL),
r AS (SELECT axis, (0.1 + 0.1 * (axis % 4))::DOUBLE AS theta, expected, CASE axis WHEN 0 THEN 0 WHEN 1 THEN expected - 1 ELSE expected END AS present, CASE axis WHEN 2 THEN 'FAIL' WHEN 3 THEN NULL ELSE 'PASS' END AS oracle FROM (SELECT s_suppkey % 8 AS axis, count(*) AS expected FROM supplier GROUP BY 1)),
w AS (SELECT r.*, coalesce(x1, 0) AS x1, coalesce(x2, 0) AS x2, coalesce(x3, 0) AS x3, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, coalesce(n3, 0) AS n3 FROM r LEFT JOIN
  (SELECT axis, sum(x) FILTER (dose = 1) AS x1, sum(x) FILTER (dose = 2) AS x2, sum(x) FILTER (dose = 3) AS x3, sum(n) FILTER (dose = 1) AS n1, sum(n) FILTER (dose = 2) AS n2, sum(n) FILTER (dose = 3) AS n3 FROM c GROUP BY axis) USING (axis)),
k AS (SELECT axis, theta, n3, unnest(range(0, n3::BIGINT + 1)) AS k FROM w),
t AS (SELECT axis, k, sum(exp(lgamma(n3 + 1) - lgamma(k + 1) - lgamma(n3 - k + 1) + k * ln(theta) + (n3 - k) * ln(1 - theta))) OVER (PARTITION BY axis ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS tail FROM k),
e AS (SELECT axis, coalesce(min(k) FILTER (tail <= 0.05 / 3), max(k) + 1) AS critical FROM t GROUP BY axis),
v AS (SELECT w.*, least(n1, n2, n3) = 0 AS void, critical, (x1 + x2 + x3) / (n1 + n2 + n3) AS p, n1 + 2 * n2 + 3 * n3 AS sn, n1 + 4 * n2 + 9 * n3 AS ssn, x1 + 2 * x2 + 3 * x3 AS sx, n1 + n2 + n3 AS n FROM w LEFT JOIN e USING (axis)),
z AS (SELECT *, (sx - p * sn) / sqrt(p * (1 - p) * (ssn - sn * sn / n)) AS z FROM v),
o AS (SELECT axis, CASE WHEN present = 0 THEN 'PENDING' WHEN present < expected THEN 'PARTIAL_WITHHELD' WHEN coalesce(oracle, '') <> 'PASS' THEN 'ORACLE_WITHHELD' ELSE 'SCORED' END AS status, void,
  CASE WHEN NOT void THEN round(z, 6) END AS z, CASE WHEN NOT void THEN critical END AS critical, CASE WHEN NOT void AND present > 0 THEN z > 0 AND x1 / n1 < x2 / n2 AND x2 / n2 < x3 / n3 AND x3 >= critical END AS breaks FROM z)
"""


def _axes(t: Tables) -> DataFrame:
    axis = (F.col("l_suppkey") % 8).alias("axis")
    lines = t.lineitem.select(axis, (F.col("l_linenumber") % 3 + 1).alias("dose"), "l_quantity").where("axis <> 0 AND NOT (axis = 4 AND dose = 2)")
    counts = lines.groupBy("axis", "dose").agg(F.count_if(F.col("l_quantity") > 46 - 4 * F.col("dose")).alias("x"), F.count("*").alias("n"))
    a = F.col("axis")
    register = t.supplier.groupBy((F.col("s_suppkey") % 8).alias("axis")).agg(F.count("*").alias("expected")).select(
        "axis", (0.1 + 0.1 * (a % 4)).alias("theta"), F.lit(0.05 / 3).alias("alpha"), "expected",
        F.when(a == 0, 0).when(a == 1, F.col("expected") - 1).otherwise(F.col("expected")).alias("present"), F.when(a == 2, "FAIL").when(a != 3, "PASS").alias("oracle"),
    )
    return V.axis_verdicts(counts, register)


@query(f"WITH {_COUNTS} SELECT axis, status, void, z, critical, breaks FROM o")
def axis_verdict_table(t: Tables) -> DataFrame:
    """Axes without results, with too few, with a failed or missing oracle, and with an empty dose, beside those that are scored."""
    return rounded(_axes(t).select("axis", "status", "void", "z", "critical", "breaks"), "z")


@query(f"WITH {_COUNTS}, q AS (SELECT axis >= 5 AS late, count(*) FILTER (status <> 'SCORED' OR breaks IS NULL) = 0 AS final, coalesce(string_agg(axis, ',' ORDER BY axis) FILTER (status = 'SCORED' AND breaks), '') AS broke FROM o GROUP BY 1) SELECT late, CASE WHEN final THEN 'FINAL' ELSE 'PENDING' END AS status, broke, CASE WHEN final THEN broke <> '' END AS any_break FROM q")
def program_verdict_table(t: Tables) -> DataFrame:
    """Two programs: the first waits for axes, the second is final."""
    out = V.program_verdict(_axes(t).withColumn("late", F.col("axis") >= 5), "late")
    return out.select("late", "status", F.array_join("broke", ",").alias("broke"), "any_break")


@query("""
WITH g AS (SELECT l_partkey, sum((l_quantity > 45)::INT)::BIGINT AS x, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_partkey, x, n, CASE WHEN x >= n THEN NULL ELSE 0.95 END AS tail, CASE WHEN x = 0 THEN round(1 - pow(0.05, 1 / n), 6) WHEN x = n THEN 1 WHEN x = n - 1 THEN round(pow(0.95, 1 / n), 6) END AS bound FROM g
""")
def exact_bounds_by_part(t: Tables) -> DataFrame:
    """Upper bounds of a share for each part: the tail they leave for all, and the bound where it has a closed form."""
    g = t.lineitem.groupBy("l_partkey").agg(F.count_if(F.col("l_quantity") > 45).alias("x"), F.count("*").alias("n"))
    closed = F.when(F.col("x").isin(0) | (F.col("x") >= F.col("n") - 1), r6(F.col("bound")))
    return V.upper_bounds(g, "x", "n").select("l_partkey", "x", "n", r6(F.col("tail")).alias("tail"), closed.alias("bound"))
