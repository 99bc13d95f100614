"""Runs that share a memo of scored pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.operators import memo as M
from lakequill.plans.catalog import Tables, query

_PAIRS_SQL = """
p AS (SELECT a.turn, a.text AS a, b.text AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.text IS NOT NULL AND b.text IS NOT NULL),
s AS (SELECT a, b, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y, min(turn) AS turn FROM p GROUP BY a, b),
j AS (SELECT turn, len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) AS score FROM s)"""


def _overlap(df: DataFrame) -> DataFrame:
    x, y = (F.array_distinct(F.split(c, " ")) for c in ("a", "b"))
    return df.withColumn("score", F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


@query(f"""
WITH {_PAIRS_SQL}
SELECT r::INT AS run, count(*) FILTER (turn < 3 OR r > 1) AS asked, count(*) FILTER (CASE r WHEN 1 THEN turn < 3 WHEN 2 THEN turn >= 3 ELSE false END) AS scored, round(avg(score) FILTER (turn < 3 OR r > 1), 6) AS mean_score
FROM j, range(1, 4) x(r) GROUP BY r
""")
def memo_runs(t: Tables) -> DataFrame:
    """Each turn paired with the next. The first run asks for the pairs of three turns, the second for all, the third for all again."""
    turns = t.conversations.select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    pairs = turns.join(after, ["conv_id", "turn"]).select("turn", "text", "next")
    path = t.scratch("memo")
    table = path.rsplit("/", 1)[1].replace("-", "_")
    M.create(t.spark, table, path, 8)
    out = None
    for run in (1, 2, 3):
        asked = pairs.where("turn < 3") if run == 1 else pairs
        before = t.spark.table(table).count()
        M.extend(asked, "text", "next", table, _overlap)
        known = M.looked_up(asked, "text", "next", table).where("score IS NOT NULL").groupBy("text", "next").agg(F.max("score").alias("score"))
        one = known.agg(F.lit(run).alias("run"), F.count("*").alias("asked"), F.lit(t.spark.table(table).count() - before).alias("scored"), F.round(F.avg("score"), 6).alias("mean_score"))
        out = one if out is None else out.unionByName(one)
    return out
