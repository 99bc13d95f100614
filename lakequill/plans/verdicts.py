"""Classification, parsing and verdict queries over records made from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.functions import echo, outputs
from lakequill.functions import records as R
from lakequill.operators import cases as C
from lakequill.operators import puzzles as Z
from lakequill.plans.catalog import Tables, query, rounded

_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity <> l_linenumber * 5 THEN 'INSTRUMENT' WHEN l_quantity = round(l_tax * 100) THEN 'INSTRUMENT' WHEN l_returnflag = 'R' THEN 'SUPERSESSION' ELSE 'REAL' END AS class FROM lineitem
""")
def value_echo_classes(t: Tables) -> DataFrame:
    """A line's quantity as the stale value, five times its number as the asserted one, its tax as the right one."""
    n = lambda c: c.cast("int").cast("string")
    statement = F.concat(F.lit("The stock is "), n(F.col("l_quantity")), F.lit(" kg."))
    said = F.concat(F.when(F.col("l_returnflag") == "R", "The stock is no longer ").otherwise("The stock is "), n(F.col("l_linenumber") * 5), F.lit(" kg."))
    right = F.concat(n(F.round(F.col("l_tax") * 100)), F.lit(" kg"))
    return t.lineitem.select(*_KEY, echo.classified(statement, F.array(said), right).alias("class"))


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'keys' WHEN 'P' THEN 'duplicate id' END AS reason, CASE WHEN o_orderstatus = 'O' THEN 2 END::INT AS claims FROM orders
""")
def strict_output_parsing(t: Tables) -> DataFrame:
    claim = lambda i: F.concat(F.lit('{"id": '), i.cast("string"), F.lit(', "text": "t", "source_ids": [0]}'))
    second = claim(F.when(F.col("o_orderstatus") == "P", F.lit(0)).otherwise(F.lit(1)))
    raw = F.concat(F.lit('{"claims": ['), claim(F.lit(0)), F.lit(", "), second, F.lit('], "conclusion": "c"'), F.when(F.col("o_orderstatus") == "F", ', "extra": 1}').otherwise("}"))
    parsed = t.orders.select("o_orderkey", outputs.parse(raw).alias("p"))
    return parsed.select("o_orderkey", "p.reason", F.when(F.col("p.output").isNotNull(), F.size("p.output.claims")).alias("claims"))


@query("""
SELECT l_orderkey, count(*) FILTER (l_suppkey % 5 < 3)::INT AS kept, count(*) FILTER (l_suppkey % 5 >= 3)::INT AS dropped FROM lineitem GROUP BY 1
""")
def citation_sanitise(t: Tables) -> DataFrame:
    """Claims that cite a source which isn't there are dropped and counted; three sources exist."""
    claim = F.struct(F.col("l_linenumber").alias("id"), F.array(F.col("l_suppkey") % 5).alias("source_ids"))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(claim).alias("claims"))
    kept = F.size(R.sane_claims(F.col("claims"), F.lit(3)))
    return rows.select("l_orderkey", kept.alias("kept"), (F.size("claims") - kept).alias("dropped"))


@query("""
WITH r AS (SELECT CASE WHEN event_type = 'click' THEN 'N-k1' WHEN event_type = 'view' THEN 'S-k2' ELSE 'draft' END AS run, value > 240 AS failed, value < 1 AS skipped FROM events)
SELECT count(*) AS n, count(*) FILTER (failed) AS failures, round(count(*) FILTER (failed) / count(*), 6) AS rate, count(*) FILTER (failed) / count(*) <= 0.02 AS comparable FROM r WHERE run <> 'draft' AND NOT skipped
""")
def comparability_gate(t: Tables) -> DataFrame:
    run = F.when(F.col("event_type") == "click", "N-k1").when(F.col("event_type") == "view", "S-k2").otherwise("draft")
    return rounded(C.comparability(t.events.select(run.alias("run"), (F.col("value") > 240).alias("failed"), "value"), F.col("value") < 1), "rate")


@query("""
WITH c AS (SELECT l_suppkey % 20 AS family, l_returnflag AS arm, 1 + l_linenumber % 3 AS dose, CASE WHEN l_quantity % 3 = 0 THEN 'TF' WHEN l_quantity % 3 = 1 THEN 'FT' ELSE 'FF' END AS cell, l_discount < 0.06 AS kept FROM lineitem),
t AS (SELECT CASE arm WHEN 'N' THEN 'BLANKET' ELSE 'SCOPED' END AS arm, dose, cell, arm <> 'N' AS scoped, CASE WHEN arm <> 'N' THEN kept AND cell <> 'FF' ELSE true END AS trial FROM c)
SELECT arm, dose::INT AS dose_level, count(*) FILTER (trial AND CASE WHEN scoped THEN cell = 'FT' ELSE cell <> 'TF' END) AS events, count(*) FILTER (trial) AS trials, count(*) FILTER (scoped AND cell = 'FF') AS ff, 0::BIGINT AS tt, 0::BIGINT AS mismatches FROM t GROUP BY 1, 2
""")
def scoped_case_counts(t: Tables) -> DataFrame:
    """Cases with exact-decimal answers: right is 10, wrong 20 (none in the blanket arm)."""
    third = (F.col("l_quantity") % 3).cast("int")
    blanket = F.col("l_returnflag") == "N"
    emitted = F.when(third == 0, "10.0").when(third == 1, "20").otherwise("30")
    case = lambda cls, said: F.struct(F.lit("c").alias("case_id"), F.lit(cls).alias("cls"), F.lit("10").alias("A_correct"), F.when(~blanket, "20").alias("A_wrong"), said.alias("emitted"), F.lit(None).cast("boolean").alias("a_correct_fired"), F.lit(None).cast("boolean").alias("a_wrong_fired"))
    kept = case("EXCEPTED", F.when(F.col("l_discount") < 0.06, "10").otherwise("20"))
    rows = t.lineitem.select(F.col("l_orderkey").cast("string").alias("task_id"), (F.col("l_suppkey") % 20).alias("family_id"), F.when(blanket, "BLANKET").otherwise("SCOPED").alias("arm"), (1 + F.col("l_linenumber") % 3).cast("int").alias("dose_level"), F.array(kept, case("RULE", emitted)).alias("scored_cases"))
    return C.by_dose(C.exploded(rows))


_PUZZLE_SQL = """
e AS (SELECT o_orderkey AS k, list_transform(range(0, 5), lambda a: md5('0:' || o_orderkey::VARCHAR || ':' || a::VARCHAR)) AS h FROM orders),
t AS (SELECT k, list_transform(h, lambda x: len(list_filter(h, lambda y: y <= x))) AS s FROM e),
c AS (SELECT k, CASE WHEN s[a + 1] = b THEN 'at' ELSE 'nat' END AS op, a, b FROM t, range(0, 5) x(a), range(1, 6) y(b)
  UNION ALL SELECT k, CASE WHEN abs(s[a + 1] - s[b + 1]) = 1 THEN 'imm' ELSE 'lt' END, CASE WHEN s[a + 1] < s[b + 1] THEN a ELSE b END, CASE WHEN s[a + 1] < s[b + 1] THEN b ELSE a END FROM t, range(0, 5) x(a), range(0, 5) y(b) WHERE a < b),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY md5('0:' || k::VARCHAR || ':' || op || ':' || a::VARCHAR || ':' || b::VARCHAR)) - 1 AS i FROM c),
p AS (SELECT [v, w, x, y, z] AS p, v + 16 * w + 256 * x + 4096 * y + 65536 * z AS code FROM range(1, 6) a(v), range(1, 6) b(w), range(1, 6) c(x), range(1, 6) d(y), range(1, 6) e(z) WHERE len(list_distinct([v, w, x, y, z])) = 5),
m AS (SELECT k, code, sum(CASE WHEN CASE op WHEN 'at' THEN p[a + 1] = b WHEN 'nat' THEN p[a + 1] <> b WHEN 'imm' THEN p[a + 1] + 1 = p[b + 1] ELSE p[a + 1] < p[b + 1] END THEN 0 ELSE 1::BIGINT << i::INT END)::BIGINT AS m FROM o, p GROUP BY ALL)"""


def _puzzles(t: Tables) -> DataFrame:
    """A puzzle costs far more than its key, so keys are dealt to all cores."""
    return Z.hashed_puzzles(t.orders.select("o_orderkey").repartition(4 * t.spark.sparkContext.defaultParallelism, "o_orderkey"), "o_orderkey", 5)


@query(f"""
WITH {_PUZZLE_SQL},
f AS (SELECT k, list(DISTINCT m) FILTER (m > 0) AS ms, (max(log2(m & -m)) FILTER (m > 0))::INT + 1 AS prefix FROM m GROUP BY k),
g AS (SELECT k, prefix, list_reduce(list_prepend((1::BIGINT << 35) - 1, range(0, 35)), lambda s, i: CASE WHEN len(list_filter(ms, lambda x: x & (s & ~(1::BIGINT << i::INT)) = 0)) = 0 THEN s & ~(1::BIGINT << i::INT) ELSE s END) AS kept FROM f)
SELECT g.k AS o_orderkey, any_value(prefix) AS prefix, string_agg(op || ' ' || a::VARCHAR || ' ' || b::VARCHAR, ', ' ORDER BY i) AS minimal,
  (SELECT list_position(s, 2 + g.k % 3) - 1 FROM t WHERE t.k = g.k) AS gold
FROM g JOIN o ON g.k = o.k AND (kept >> o.i::INT) & 1 = 1 GROUP BY g.k
""")
def seating_puzzles(t: Tables) -> DataFrame:
    """A puzzle of five names from each order: how many clues from the left are enough, a minimal set of them, and who sits at a seat."""
    done = Z.solved(_puzzles(t), F.lit(5), "clues", 5)
    said = F.array_join(F.transform("minimal", lambda c: F.concat_ws(" ", c["op"], c["a"].cast("string"), c["b"].cast("string"))), ", ")
    asked = F.filter(F.sequence(F.lit(0), F.lit(4)), lambda a: Z.seat(F.col("solutions")[0], a) == 2 + F.col("o_orderkey") % 3)[0]
    return done.select("o_orderkey", "prefix", said.alias("minimal"), asked.alias("gold"))


@query(f"""
WITH {_PUZZLE_SQL} SELECT k AS o_orderkey, count(*) FILTER (m & 15 = 0)::INT AS solutions, min(code) FILTER (m & 15 = 0) AS first_solution, CASE WHEN count(*) FILTER (m & 15 = 0) > 1 THEN 'several' END AS reason FROM m GROUP BY 1
""")
def seating_solutions(t: Tables) -> DataFrame:
    """All seatings under the first four clues of each order's puzzle."""
    rows = _puzzles(t).withColumn("clues", F.slice("clues", 1, 4))
    return Z.solved(rows, F.lit(5), "clues", 5).select("o_orderkey", F.size("solutions").alias("solutions"), F.col("solutions")[0].alias("first_solution"), "reason")


@query("""
SELECT e.event_id, (100 + e.user_id * 3)::BIGINT AS total, (e.value >= 50) <> (e.value + 10 >= 50) AS flipped FROM events e
""")
def requirement_flips(t: Tables) -> DataFrame:
    return t.events.select("event_id", (100 + F.col("user_id") * 3).alias("total"), echo.flipped(F.col("value"), F.col("value") + 10, F.lit(50)).alias("flipped"))


@query("""
SELECT event_id, CASE WHEN (props::JSON->>'k')::INT = 7 THEN '{"k": 1500}' ELSE props END AS text, CASE WHEN (props::JSON->>'k')::INT <> 7 THEN 'absent' END AS reason FROM events
""")
def numeric_rewrite(t: Tables) -> DataFrame:
    done = t.events.select("event_id", "props", echo.rewrite_number(F.col("props"), F.lit(7.0), F.lit(1500.0)).alias("r"))
    return done.select("event_id", F.coalesce("r.text", "props").alias("text"), "r.reason")
