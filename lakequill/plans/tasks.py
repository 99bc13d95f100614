"""Tasks of differing shape, made from orders as JSON texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakequill.functions import routing as R
from lakequill.plans.catalog import Tables, query, rounded


def _tasks(t: Tables) -> DataFrame:
    """Five shapes: whole; a default and a text as dose; parameters that are a text; a verdict that is no list; no JSON."""
    k, n = F.col("o_orderkey"), (1 + F.col("o_orderkey") % 4).cast("int")
    listed = lambda size, f: F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), size), f), ", "), F.lit("]"))
    numbers = lambda size: F.when(size < 1, "[]").otherwise(listed(F.greatest(size, F.lit(1)), lambda i: i.cast("string")))
    roles = listed(n + F.when(k % 11 == 0, 1).otherwise(0), lambda i: F.when(i == 1, '"insurance"').otherwise('"node"'))
    verdicts = listed(n, lambda i: F.when(i % 2 == 1, "true").otherwise("false"))
    ops = F.concat(F.lit(', "derivation": {"ops": '), numbers(n - 1 + F.when(k % 7 == 0, 1).otherwise(0)), F.lit("}"))
    shape = k % 5

    def body(dose: Column, side: Column, params: Column) -> Column:
        return F.concat(F.lit('{"axis": "'), F.col("o_orderstatus"), F.lit('", "dose_level": '), dose, side, F.lit(', "must_persist": [1, 2], "must_change": '), numbers(n), F.lit(', "axis_params": '), params, F.lit("}"))

    side = lambda s: F.lit(f', "break_side": "{s}"')
    own = F.concat(F.lit('{"verdict_item": '), verdicts, F.lit(', "item_roles": '), roles, ops, F.lit("}"))
    text = F.when(shape == 0, body((k % 3 + 1).cast("string"), side("must_change"), own))
    text = text.when(shape == 1, body(F.lit('"D2"'), side("must_persist"), F.concat(F.lit('{"item_roles": '), roles, ops, F.lit("}"))))
    text = text.when(shape == 2, body(F.lit("1"), side("must_change"), F.lit('"none"')))
    text = text.when(shape == 3, body(F.lit('"x"'), F.lit(""), F.concat(F.lit('{"verdict_item": "yes", "item_roles": '), roles, F.lit("}"))))
    return t.orders.select("o_orderkey", R.task(text.otherwise(F.lit('{"axis": '))).alias("task"))


@query("""
WITH o AS (SELECT *, o_orderkey % 5 AS shape, 1 + o_orderkey % 4 AS n FROM orders)
SELECT o_orderkey, o_orderstatus AS axis, CASE shape WHEN 0 THEN o_orderkey % 3 + 1 WHEN 1 THEN 2 WHEN 2 THEN 1 END::INT AS dose_level, CASE shape WHEN 1 THEN 'must_persist' WHEN 3 THEN NULL ELSE 'must_change' END AS break_side,
  (CASE shape WHEN 1 THEN 2 ELSE n END)::INT AS items, (CASE shape WHEN 0 THEN (n + 1) // 2 WHEN 1 THEN 2 ELSE n END)::INT AS counted, shape <> 0 AS verdict_item_defaulted, CASE WHEN shape <> 2 THEN n + (o_orderkey % 11 = 0)::INT END::INT AS roles,
  round(CASE shape WHEN 0 THEN 1.0 ELSE 1.0 / (CASE shape WHEN 1 THEN 2 ELSE least(n, 2) END) END, 6)::DOUBLE AS rate
FROM o WHERE shape <> 4
""")
def routed_tasks(t: Tables) -> DataFrame:
    """The rate is over the first two items: the first is asserted, the second is not, all others are pruned."""
    r = _tasks(t).where("task IS NOT NULL").select("o_orderkey", R.routing(F.col("task")).alias("r"))
    asserted = F.create_map(F.lit("0"), F.lit(True), F.lit("1"), F.lit(False))
    out = r.select("o_orderkey", "r.axis", "r.dose_level", "r.break_side", F.size("r.verdict_item").alias("items"), F.size(F.filter("r.verdict_item", lambda x: x)).alias("counted"), "r.verdict_item_defaulted", F.when(F.col("r.item_roles").isNotNull(), F.size("r.item_roles")).alias("roles"), R.verdict_rate(F.col("r.verdict_item"), asserted).alias("rate"))
    return rounded(out, "rate")


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'verdict_item' WHEN 2 THEN 'axis_params' WHEN 3 THEN 'verdict_item' WHEN 4 THEN 'json'
  ELSE CASE WHEN o_orderkey % 11 = 0 THEN 'lengths' WHEN o_orderkey % 7 = 0 THEN 'steps' END END AS reason FROM orders
""")
def rejected_tasks(t: Tables) -> DataFrame:
    return _tasks(t).select("o_orderkey", R.rejection(F.col("task")).alias("reason"))
