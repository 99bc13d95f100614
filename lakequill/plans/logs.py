"""Log, join, vote and verdict queries. Events stand in for a result log: user = task, event_type = arm, event_id = sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.functions.records import dose
from lakequill.operators import aggregates as A
from lakequill.operators import decisions as D
from lakequill.operators import latest as L
from lakequill.operators import quality as Q
from lakequill.operators import stats as S
from lakequill.operators import votes as V
from lakequill.plans.catalog import Tables, query, rounded
from lakequill.sources.readers import split_composite
from lakequill.sources.writers import batches

_LATEST = "latest AS (SELECT * FROM (SELECT user_id, event_type, event_id % 7 AS item, event_id, value, row_number() OVER (PARTITION BY user_id, event_type, event_id % 7 ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1)"


def _latest(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", (F.col("event_id") % 7).alias("item"), "event_id", "value")
    return L.last_wins(rows, ["user_id", "event_type", "item"], "event_id")


def _register(t: Tables) -> DataFrame:
    return t.events.where("value > 300").select("user_id", (F.col("event_id") % 7).alias("item"))


@query(f"""
WITH {_LATEST}, kept AS (SELECT * FROM latest WHERE (user_id, item) NOT IN (SELECT user_id, event_id % 7 FROM events WHERE value > 300)),
rates AS (SELECT event_type, sum((value > 50)::INT) AS x, count(*) AS n FROM kept GROUP BY event_type)
SELECT a.event_type AS arm_a, b.event_type AS arm_b, a.x::BIGINT AS x_a, a.n AS n_a, b.x::BIGINT AS x_b, b.n AS n_b,
       round((a.x / a.n - b.x / b.n) / sqrt(((a.x + b.x) / (a.n + b.n)) * (1 - (a.x + b.x) / (a.n + b.n)) * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)), 6) AS z
FROM rates a JOIN rates b ON a.event_type < b.event_type
""")
def arm_pooled_ztest(t: Tables) -> DataFrame:
    """Latest rows, prune register, pooled counts, a z for each pair of arms."""
    kept = L.pruned(_latest(t), _register(t), ["user_id", "item"])
    flags = kept.groupBy("event_type", "user_id").agg(V.count_if(F.col("value") > 50).alias("x"), F.count("*").alias("n"))
    return rounded(S.pairwise_z(A.pooled_rates(flags, "event_type", "x", "n"), "event_type"), "z")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def last_row_wins(t: Tables) -> DataFrame:
    return L.last_wins(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k = 1")
def first_row_per_family(t: Tables) -> DataFrame:
    return L.first_wins(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id"], "event_id")


@query("""
SELECT o_custkey, o_orderkey, dose FROM (
  SELECT o_custkey, o_orderkey, substr(o_orderpriority, 1, 1)::INT AS dose,
         row_number() OVER (PARTITION BY o_custkey ORDER BY substr(o_orderpriority, 1, 1)::INT DESC, o_orderkey) AS k FROM orders) WHERE k = 1
""")
def top_dose_per_family(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", dose(F.col("o_orderpriority")).alias("dose"))
    return L.top_level(rows, "o_custkey", "dose", "o_orderkey")


@query("""
SELECT t.user_id, a.arm FROM (SELECT DISTINCT user_id FROM events) t CROSS JOIN (VALUES ('click'), ('view'), ('error')) a(arm)
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = t.user_id AND e.event_type = a.arm AND e.value > 150)
""")
def todo_anti_join(t: Tables) -> DataFrame:
    done = t.events.where("value > 150").select("user_id", F.col("event_type").alias("arm"))
    return L.todo(t.events, ["click", "view", "error"], done, "user_id")


@query(f"WITH {_LATEST} SELECT user_id, event_type, item, event_id, value FROM latest WHERE (user_id, item) NOT IN (SELECT user_id, event_id % 7 FROM events WHERE value > 300)")
def pruned_items(t: Tables) -> DataFrame:
    return L.pruned(_latest(t), _register(t), ["user_id", "item"])


@query("""
SELECT c.c_custkey, c.c_mktsegment, CASE WHEN b.k IS NOT NULL THEN b.v ELSE c.c_acctbal END AS c_acctbal
FROM customer c LEFT JOIN (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON c.c_custkey = b.k
""")
def overlay_by_key(t: Tables) -> DataFrame:
    new = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return L.overlay(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), new, "c_custkey", ["c_acctbal"])


@query("""
WITH u AS (SELECT user_id AS id, 0 AS s, value FROM events WHERE event_type = 'signup' UNION ALL SELECT user_id, 1, value FROM events WHERE event_type = 'purchase')
SELECT id, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, value) AS k FROM u) WHERE k = 1
""")
def union_with_precedence(t: Tables) -> DataFrame:
    part = lambda kind: t.events.where(F.col("event_type") == kind).select(F.col("user_id").alias("id"), "value")
    return L.union_first(part("signup"), part("purchase"), key="id").select("id", "value")


@query("""
SELECT event_type, sum(x)::BIGINT AS successes, sum(n)::BIGINT AS trials, round(sum(x) / sum(n), 6) AS rate
FROM (SELECT event_type, user_id, sum((value > 50)::INT) AS x, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1
""")
def pooled_rate_by_arm(t: Tables) -> DataFrame:
    flags = t.events.groupBy("event_type", "user_id").agg(V.count_if(F.col("value") > 50).alias("x"), F.count("*").alias("n"))
    return rounded(A.pooled_rates(flags, "event_type", "x", "n"), "rate")


@query("SELECT event_type, count(*) AS n_tasks, round(avg(r), 6) AS mean_rate FROM (SELECT event_type, user_id, avg((value > 50)::INT::DOUBLE) AS r FROM events GROUP BY 1, 2) GROUP BY 1")
def mean_rate_by_arm(t: Tables) -> DataFrame:
    return rounded(A.mean_rates(t.events, "event_type", "user_id", F.col("value") > 50), "mean_rate")


@query("SELECT user_id, count(*) FILTER (value > 30) AS asserted, count(*) AS items, round(count(*) FILTER (value > 30) / count(*), 6) AS fraction FROM events GROUP BY 1")
def fraction_asserted_by_task(t: Tables) -> DataFrame:
    return rounded(A.fraction_asserted(t.events, ["user_id"], F.col("value") > 30), "fraction")


@query("SELECT user_id, event_type, (2 * count(*) FILTER (value > 40) > count(*)) AS majority FROM events GROUP BY 1, 2")
def majority_vote(t: Tables) -> DataFrame:
    return V.majority(t.events, ["user_id", "event_type"], F.col("value") > 40)


@query("""
WITH i AS (
  SELECT user_id, event_id % 5 AS item, 2 * count(*) FILTER (value > 30 AND event_type = 'view') > count(*) FILTER (event_type = 'view') AS b,
         2 * count(*) FILTER (value > 30 AND event_type = 'click') > count(*) FILTER (event_type = 'click') AS a
  FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2
  HAVING count(*) FILTER (event_type = 'view') > 0 AND count(*) FILTER (event_type = 'click') > 0)
SELECT user_id, count(*) AS n_items, count(*) FILTER (b AND NOT a) AS n_flipped, count(*) FILTER (b AND a) AS n_stable,
       CASE WHEN count(*) FILTER (b AND NOT a) = count(*) THEN 'pass' WHEN count(*) FILTER (b AND NOT a) = 0 THEN 'exclude' ELSE 'partial' END AS verdict
FROM i GROUP BY 1
""")
def stability_verdict(t: Tables) -> DataFrame:
    rows = t.events.where(F.col("event_type").isin("view", "click")).withColumn("item", F.col("event_id") % 5)
    return V.stability(rows, "user_id", "item", F.col("event_type") == "click", F.col("value") > 30)


@query("""
WITH i AS (SELECT user_id, event_type, count(*) FILTER (value > 90) AS n_wrong, 2 * count(*) FILTER (value < 30) > count(*) AS ok FROM events GROUP BY 1, 2),
p AS (SELECT user_id FROM i GROUP BY 1 HAVING bool_or(ok))
SELECT user_id, event_type, n_wrong, n_wrong >= 2 AS pruned FROM i WHERE user_id IN (SELECT user_id FROM p)
""")
def adjudicate_filter(t: Tables) -> DataFrame:
    return V.adjudicate(t.events, "user_id", "event_type", F.col("value") > 90, F.col("value") < 30)


@query("""
SELECT d.dose, coalesce(c.violations, 0)::BIGINT AS violations, coalesce(c.trials, 0)::BIGINT AS trials FROM (SELECT unnest(range(0, 7))::INT AS dose) d
LEFT JOIN (SELECT substr(o_orderpriority, 1, 1)::INT AS dose, count(*) FILTER (o_totalprice > 200000) AS violations, count(*) AS trials FROM orders GROUP BY 1) c USING (dose)
""")
def dose_violations(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("dose", dose(F.col("o_orderpriority")))
    return A.dose_counts(rows, "dose", F.col("o_totalprice") > 200000, list(range(7)))


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS correct, round(count(*) FILTER (l_discount > 0.05) / count(*), 6) AS accuracy,
       (2 * grouping(l_returnflag) + grouping(l_linestatus))::BIGINT AS level
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
""")
def family_arm_tables(t: Tables) -> DataFrame:
    return rounded(A.accuracy(t.lineitem, "l_returnflag", "l_linestatus", F.col("l_discount") > 0.05, F.lit(True)), "accuracy")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"n_F\", count(*) FILTER (o_orderstatus = 'O') AS \"n_O\", count(*) FILTER (o_orderstatus = 'P') AS \"n_P\", count(*) AS n FROM orders GROUP BY 1")
def value_count_table(t: Tables) -> DataFrame:
    return A.value_table(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("""
SELECT l_orderkey, round(max(s), 6) AS score, count(*) AS n_sources FROM (
  SELECT l_orderkey, l_suppkey, avg(d) AS s FROM (SELECT l_orderkey, l_suppkey, l_discount AS d FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey, l_tax FROM lineitem) GROUP BY 1, 2) GROUP BY 1
""")
def bidirectional_best_source(t: Tables) -> DataFrame:
    """Pair scores in both directions; discount and tax stand in for injected entailment scores."""
    pairs = t.lineitem.select("l_orderkey", "l_suppkey", F.explode(F.array(F.struct(F.lit(0).alias("d"), F.col("l_discount").alias("s")), F.struct(F.lit(1).alias("d"), F.col("l_tax").alias("s")))).alias("p"))
    return rounded(A.bidirectional(pairs.select("l_orderkey", "l_suppkey", "p.d", F.col("p.s").alias("x")), "l_orderkey", "l_suppkey", "d", "x"), "score")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS items, count(*) AS n FROM events GROUP BY 1")
def nested_results(t: Tables) -> DataFrame:
    return A.nested(t.events, "user_id", "event_id", "event_type").select("user_id", F.array_join("items", ",").alias("items"), F.size("items").cast("long").alias("n"))


@query("SELECT event_type || '|' || (value > 100)::VARCHAR AS signature, count(*) AS n FROM events GROUP BY 1")
def provenance_signatures(t: Tables) -> DataFrame:
    return A.signatures(t.events.withColumn("big", F.col("value") > 100), ["event_type", "big"])


@query("""
SELECT gate, bool_and(ok) AS all_pass, bool_or(ok) AS any_pass, count(*) FILTER (NOT ok) AS n_fail FROM (
  SELECT 'positive' AS gate, value > 0 AS ok FROM events UNION ALL SELECT 'small', value < 400 FROM events UNION ALL SELECT 'negative', value < 0 FROM events) GROUP BY 1
""")
def any_all_gates(t: Tables) -> DataFrame:
    return A.gates(t.events, {"positive": F.col("value") > 0, "small": F.col("value") < 400, "negative": F.col("value") < 0})


@query("""
SELECT l_returnflag AS stratum, count(*) FILTER (l_quantity > 25) AS kept, count(*) FILTER (l_quantity <= 25) AS dropped,
       round(avg((l_discount > 0.05)::INT) FILTER (l_quantity > 25), 6) AS rate_kept, round(avg((l_discount > 0.05)::INT) FILTER (l_quantity <= 25), 6) AS rate_dropped
FROM lineitem GROUP BY 1
""")
def filter_bias(t: Tables) -> DataFrame:
    kept, flag = F.col("l_quantity") > 25, (F.col("l_discount") > 0.05).cast("double")
    out = t.lineitem.groupBy(F.col("l_returnflag").alias("stratum")).agg(V.count_if(kept).alias("kept"), V.count_if(~kept).alias("dropped"), F.avg(F.when(kept, flag)).alias("rate_kept"), F.avg(F.when(~kept, flag)).alias("rate_dropped"))
    return rounded(out, "rate_kept", "rate_dropped")


@query("SELECT event_id, user_id, value, (props::JSON->>'k')::INT AS k FROM events WHERE event_type <> 'error'")
def log_projection(t: Tables) -> DataFrame:
    """JSON payloads parsed against a schema; error rows left out."""
    return t.events.where("event_type <> 'error'").select("event_id", "user_id", "value", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT event_id::VARCHAR || '||' || user_id::VARCHAR || '||' || event_type AS key, event_id, user_id::INT AS user_id, event_type FROM events")
def composite_key_split(t: Tables) -> DataFrame:
    keys = t.events.select(F.concat_ws("||", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type").alias("key"))
    return split_composite(keys, "key", ["event_id", "user_id", "event_type"], {"event_id": "long", "user_id": "int"})


@query("SELECT o_custkey, o_orderkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 3)::INT AS batch FROM orders")
def batch_chunks(t: Tables) -> DataFrame:
    return batches(t.orders.select("o_custkey", "o_orderkey"), 3, "o_orderkey", within="o_custkey")


@query("""
WITH a AS (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id,
       CASE WHEN b.v IS NULL THEN 'only_left' WHEN a.v IS NULL THEN 'only_right' WHEN (a.v >= 50) <> (b.v >= 50) THEN 'flip' WHEN a.v = b.v THEN 'equal' ELSE 'differs' END AS status, round(b.v - a.v, 6) AS delta
FROM a FULL JOIN b ON a.user_id = b.user_id
""")
def equivalence_diff(t: Tables) -> DataFrame:
    part = lambda kind: t.events.where(F.col("event_type") == kind).groupBy("user_id").agg(Q.exact_mean(F.col("value")).alias("v"))
    found = Q.compare(part("view"), part("click"), ["user_id"], "v", flip=50.0)
    return rounded(rounded(found, "delta", digits=12), "delta")  # the difference of doubles is off by some 1e-14


@query("SELECT user_id FROM events WHERE event_type = 'error' AND value > 100 INTERSECT SELECT user_id FROM events WHERE event_type = 'click' AND value > 100")
def shared_tasks(t: Tables) -> DataFrame:
    part = lambda kind: t.events.where((F.col("event_type") == kind) & (F.col("value") > 100)).select("user_id")
    return part("error").intersect(part("click"))


@query("SELECT user_id, event_type FROM events WHERE value > 20 EXCEPT ALL SELECT user_id, event_type FROM events WHERE value > 100")
def multiset_difference(t: Tables) -> DataFrame:
    part = lambda v: t.events.where(F.col("value") > v).select("user_id", "event_type")
    return part(20).exceptAll(part(100))


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def cross_source_duplicates(t: Tables) -> DataFrame:
    return Q.repeated(t.documents, "text")


@query("""
WITH s AS (SELECT DISTINCT user_id % 4 AS shard, user_id FROM events WHERE value > 80)
SELECT count(*) AS rows, count(DISTINCT user_id) AS keys, count(*) = count(DISTINCT user_id) AS disjoint,
       (SELECT count(*) FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT user_id FROM s)) AS missing FROM s
""")
def shard_coverage(t: Tables) -> DataFrame:
    shards = t.events.where("value > 80").withColumn("shard", F.col("user_id") % 4)
    return Q.shard_coverage(shards, "shard", "user_id", t.events)


@query("""
SELECT name, violations::BIGINT AS violations, (SELECT count(*) FROM documents) AS checked FROM (
  SELECT 'has_text' AS name, count(*) FILTER (NOT coalesce(length(text) > 0, false)) AS violations FROM documents UNION ALL
  SELECT 'known_lang', count(*) FILTER (NOT coalesce(lang IN ('en', 'de'), false)) FROM documents UNION ALL
  SELECT 'length', count(*) FILTER (NOT coalesce(n_chars = length(text), false)) FROM documents)
""")
def corpus_constraints(t: Tables) -> DataFrame:
    return Q.constraints(t.documents, {"has_text": F.length("text") > 0, "known_lang": F.col("lang").isin("en", "de"), "length": F.col("n_chars") == F.length("text")})


@query("""
SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS so_far,
       round(sum(o_totalprice) OVER (PARTITION BY o_custkey) - sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) + 0 AS remaining FROM orders
""")
def running_totals(t: Tables) -> DataFrame:
    out = Q.running_total(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey", "o_totalprice")
    return rounded(out.drop("o_totalprice"), "so_far", "remaining", digits=2).withColumn("remaining", F.col("remaining") + 0)


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 2")
def first_two_labelers(t: Tables) -> DataFrame:
    return L.first_n(t.orders.select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], 2, "o_orderkey")


@query("""
WITH c AS (SELECT event_type, count(*) FILTER (value > 60) AS x, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, threshold, margin, CASE WHEN n < 100 THEN 'PENDING' WHEN x / n > threshold + margin THEN 'BREAK' WHEN x / n < threshold - margin THEN 'HOLD' ELSE 'UNCLEAR' END AS branch
FROM c, (VALUES (0.25::DOUBLE), (0.3::DOUBLE), (0.35::DOUBLE)) a(threshold), (VALUES (0.0::DOUBLE), (0.05::DOUBLE)) b(margin)
""")
def threshold_sweep(t: Tables) -> DataFrame:
    counts = t.events.groupBy("event_type").agg(V.count_if(F.col("value") > 60).alias("x"), F.count("*").alias("n"))
    rate = F.col("x") / F.col("n")
    branch = D.verdict([("PENDING", F.col("n") < 100), ("BREAK", rate > F.col("threshold") + F.col("margin")), ("HOLD", rate < F.col("threshold") - F.col("margin"))], "UNCLEAR")
    return D.sweep(counts, {"threshold": [0.25, 0.3, 0.35], "margin": [0.0, 0.05]}, branch).select("event_type", "threshold", "margin", "branch")


@query("""
WITH c AS (SELECT event_type, count(*) FILTER (value > 60) AS x, count(*) AS n FROM events GROUP BY 1),
s AS (SELECT event_type, CASE WHEN x / n > threshold THEN 'BREAK' ELSE 'HOLD' END AS branch FROM c, (VALUES (0.25), (0.28), (0.3), (0.32)) a(threshold)),
b AS (SELECT event_type, branch, count(*) AS k FROM s GROUP BY 1, 2)
SELECT event_type, sum(k)::BIGINT AS points, count(*) AS branches, count(*) = 1 AS stable, (list(branch ORDER BY k DESC, branch))[1] AS commonest FROM b GROUP BY 1
""")
def sweep_stability(t: Tables) -> DataFrame:
    counts = t.events.groupBy("event_type").agg(V.count_if(F.col("value") > 60).alias("x"), F.count("*").alias("n"))
    swept = D.sweep(counts, {"threshold": [0.25, 0.28, 0.3, 0.32]}, D.verdict([("BREAK", F.col("x") / F.col("n") > F.col("threshold"))], "HOLD"))
    return D.stability(swept, ["event_type"])


@query("""
WITH r AS (SELECT avg((value > 50)::INT) AS rate, count(DISTINCT user_id) AS tasks FROM events)
SELECT 'rate' AS gate, 0.4::DOUBLE AS bar, round(rate, 6) AS observed, rate <= 0.4 AS passes FROM r UNION ALL SELECT 'tasks', 100, tasks, tasks >= 100 FROM r
""")
def gate_table(t: Tables) -> DataFrame:
    row = t.events.agg(F.avg((F.col("value") > 50).cast("double")).alias("rate"), F.count_distinct("user_id").alias("tasks"))
    return rounded(D.gate_table(row, {"rate": ("<=", 0.4), "tasks": (">=", 100)}), "observed")


@query("""
SELECT user_id, round(avg(value) FILTER (event_type = 'view'), 6) AS baseline, round(avg(value) FILTER (event_type = 'click'), 6) AS now,
       CASE WHEN (avg(value) FILTER (event_type = 'view') >= 50) <> (avg(value) FILTER (event_type = 'click') >= 50) THEN 'flip' ELSE 'same' END AS verdict FROM events GROUP BY 1
""")
def baseline_flip(t: Tables) -> DataFrame:
    mean = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    out = t.events.groupBy("user_id").agg(mean("view").alias("baseline"), mean("click").alias("now"))
    return rounded(out.withColumn("verdict", D.verdict([("flip", (F.col("baseline") >= 50) != (F.col("now") >= 50))], "same")), "baseline", "now")


@query("""
SELECT CASE WHEN a THEN 'T' ELSE 'F' END || CASE WHEN b THEN 'T' ELSE 'F' END AS cell, count(*) AS n FROM (SELECT l_quantity > 25 AS a, l_discount > 0.05 AS b FROM lineitem) GROUP BY 1
""")
def case_cells(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(D.cell(F.col("l_quantity") > 25, F.col("l_discount") > 0.05).alias("cell")).agg(F.count("*").alias("n"))
