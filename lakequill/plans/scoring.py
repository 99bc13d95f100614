"""Pair scoring with a lexical stand-in for the injected scorer, and masked, looked-up and standardised values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.functions.text import jaccard, tokens
from lakequill.operators import aggregates as A
from lakequill.operators import pairs as P
from lakequill.plans.catalog import Tables, query, rounded

_TOKENS = "list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"


@query(f"""
WITH last AS (SELECT conv_id, text AS h, turn AS lt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS k FROM conversations) WHERE k = 1),
p AS (SELECT c.conv_id, {_TOKENS.format(x='c.text')} AS a, {_TOKENS.format(x='l.h')} AS b FROM conversations c JOIN last l USING (conv_id) WHERE c.turn < l.lt),
s AS (SELECT conv_id, CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END AS s FROM p)
SELECT conv_id, round(max(s), 6) AS score, count(*) AS n_sources FROM s GROUP BY 1
""")
def grounding_by_pairs(t: Tables) -> DataFrame:
    """The last turn of a conversation against each earlier one in both directions; best source of the averages."""
    talks = t.conversations.groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"), F.collect_list(F.struct("turn", "text")).alias("every"))
    earlier = F.transform(F.filter(F.array_sort("every"), lambda s: s["turn"] < F.col("last.turn")), lambda s: s["text"])
    pairs = P.expand(talks.select("conv_id", earlier.alias("premises"), F.col("last.text").alias("h")), ["conv_id"], "premises", "h")
    scores = P.distinct_pairs(pairs).withColumn("score", jaccard(tokens(F.col("premise")), tokens(F.col("hypothesis"))))
    return rounded(A.bidirectional(P.scored(pairs, scores), "conv_id", "source_idx", "direction", "score"), "score")


@query("""
WITH a AS (SELECT unnest(['click', 'view', 'refund']) AS event_type), u AS (SELECT DISTINCT user_id FROM events), l AS (SELECT user_id, event_type, max(event_id) AS v FROM events WHERE value > 100 GROUP BY 1, 2)
SELECT a.event_type, count(*) AS n, count(*) FILTER (l.v IS NULL) AS errors, coalesce(sum(l.v), 0)::BIGINT AS total FROM u CROSS JOIN a LEFT JOIN l ON l.user_id = u.user_id AND l.event_type = a.event_type GROUP BY 1
""")
def missing_rows_as_errors(t: Tables) -> DataFrame:
    log = t.events.where("value > 100").groupBy("user_id", "event_type").agg(F.max("event_id").alias("v"))
    return P.missing_as_error(t.events, ["click", "view", "refund"], log, "user_id", "event_type", "v")


@query("SELECT o_orderkey, coalesce(c.c_nationkey, -1) AS c_nationkey FROM orders LEFT JOIN (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 0) c ON o_custkey = c.c_custkey")
def sentinel_lookup(t: Tables) -> DataFrame:
    table = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return P.lookup(t.orders.select("o_orderkey", "o_custkey"), table, "o_custkey", "c_nationkey").select("o_orderkey", "c_nationkey")


@query("SELECT p_partkey, p_brand = 'Brand#2' AS matches FROM part")
def regeneration_check(t: Tables) -> DataFrame:
    logged = t.part.select("p_partkey", F.sha2(F.concat(F.lit("Brand#2"), F.lit(" "), "p_name"), 256).alias("hash"))
    derived = t.part.select("p_partkey", F.concat("p_brand", F.lit(" "), "p_name").alias("r"))
    return P.regenerated(derived, logged, "p_partkey", "r")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - m) / s, 6) + 0 AS l_quantity FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem WHERE l_linestatus = 'O')
""")
def standardised_quantity(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    out = P.standardised(t.lineitem.where("l_linestatus = 'O'"), rows, ["l_quantity"])
    return out.withColumn("l_quantity", F.round("l_quantity", 6) + 0)


@query("""
WITH m AS (SELECT d.n_chars, l.toxic, l.quality FROM documents d JOIN labels l USING (doc_id)), s AS (SELECT 'all' AS subset, * FROM m UNION ALL SELECT 'masked', * FROM m WHERE quality = 1),
r AS (SELECT subset, toxic, rank() OVER (PARTITION BY subset ORDER BY -n_chars) + (count(*) OVER (PARTITION BY subset, n_chars) - 1) / 2.0 AS k FROM s)
SELECT subset, sum(toxic)::BIGINT AS n_pos, sum(1 - toxic)::BIGINT AS n_neg, round((sum(k) FILTER (toxic = 1) - sum(toxic) * (sum(toxic) + 1) / 2.0) / (sum(toxic) * sum(1 - toxic)), 6) AS auroc FROM r GROUP BY 1
""")
def oriented_auroc(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    return rounded(P.oriented(rows, "n_chars", "toxic", F.col("quality") == 1), "auroc")


@query("SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS low, round(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS high FROM orders GROUP BY 1")
def dose_bands(t: Tables) -> DataFrame:
    return rounded(P.bands(t.orders, "o_orderpriority", "o_totalprice"), "mean", digits=4)


@query("SELECT count(*) FILTER (l_discount > 0.05) AS n_negatives, count(*) FILTER (l_discount > 0.05) >= 100 AS evaluable FROM lineitem")
def evidence_precondition(t: Tables) -> DataFrame:
    return P.evidence_mass(t.lineitem, F.col("l_discount") <= 0.05, 100)
