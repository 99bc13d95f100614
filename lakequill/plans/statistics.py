"""Statistics and sampling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.functions.records import dose, entropy, leave_one_out, softmax
from lakequill.operators import aggregates as A
from lakequill.operators import probes as P
from lakequill.operators import resample as B
from lakequill.operators import sampling as M
from lakequill.operators import stats as S
from lakequill.operators import votes as V
from lakequill.plans.catalog import Tables, query, rounded


def _doses(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("dose", dose(F.col("o_orderpriority")))
    return rows.groupBy("o_orderstatus", "dose").agg(V.count_if(F.col("o_totalprice") > 250000).alias("x"), F.count("*").alias("n"))


_DOSES = "d AS (SELECT o_orderstatus, substr(o_orderpriority, 1, 1)::INT AS dose, (count(*) FILTER (o_totalprice > 250000))::DOUBLE AS x, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2)"
_TREND = "(sum(dose * x) - sum(x) / sum(n) * sum(dose * n)) / sqrt(sum(x) / sum(n) * (1 - sum(x) / sum(n)) * (sum(dose * dose * n) - sum(dose * n) * sum(dose * n) / sum(n)))"


@query(f"WITH {_DOSES} SELECT sum(n)::BIGINT AS trials, sum(x)::BIGINT AS successes, round({_TREND}, 6) AS z FROM d WHERE o_orderstatus = 'F'")
def cochran_armitage_trend(t: Tables) -> DataFrame:
    return rounded(S.cochran_armitage(_doses(t).where("o_orderstatus = 'F'"), "dose", "x", "n"), "z")


@query(f"""
WITH {_DOSES}, l AS (SELECT *, x / n - lag(x / n) OVER (ORDER BY dose) AS step FROM d WHERE o_orderstatus = 'O')
SELECT sum(n)::BIGINT AS trials, sum(x)::BIGINT AS successes, round({_TREND}, 6) AS z, bool_and(coalesce(step > 0, true)) AS rising, {_TREND} > 0 AND bool_and(coalesce(step > 0, true)) AS passes FROM l
""")
def monotonicity_gate(t: Tables) -> DataFrame:
    return rounded(S.monotone(_doses(t).where("o_orderstatus = 'O'"), "dose", "x", "n"), "z")


@query("""
WITH c AS (SELECT event_type, count(*) FILTER (value > 150) AS k, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, k, n, round(CASE WHEN k <= 0 THEN 1.0 ELSE list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05) + (n - i) * ln(0.95)))) END, 8) AS tail FROM c
""")
def exact_binomial_tail(t: Tables) -> DataFrame:
    counts = t.events.groupBy("event_type").agg(V.count_if(F.col("value") > 150).alias("k"), F.count("*").alias("n"))
    return rounded(counts.withColumn("tail", S.binomial_tail_column(F.col("k"), F.col("n"), 0.05)), "tail", digits=8)


@query("""
WITH r AS (SELECT user_id, avg((value > 50)::INT) FILTER (event_type = 'view') AS x, avg((value > 50)::INT) FILTER (event_type = 'click') AS y FROM events GROUP BY 1)
SELECT count(*) AS n, round(avg(x), 6) AS mean_base, round(avg(y), 6) AS mean_other, round(avg(y) - avg(x), 6) AS difference, avg(y) - avg(x) >= -0.1 AS non_inferior FROM r WHERE x IS NOT NULL AND y IS NOT NULL
""")
def completeness_non_inferiority(t: Tables) -> DataFrame:
    rates = t.events.groupBy("user_id", "event_type").agg(F.avg((F.col("value") > 50).cast("double")).alias("r"))
    return rounded(S.non_inferior(rates, "user_id", "event_type", "r", "view", "click", 0.1), "mean_base", "mean_other", "difference")


_LABELLED = "m AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))"


def _labelled(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id")


@query(f"""
WITH {_LABELLED}, r AS (SELECT toxic, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS k FROM m)
SELECT sum(toxic)::BIGINT AS n_pos, sum(1 - toxic)::BIGINT AS n_neg, round((sum(k) FILTER (toxic = 1) - sum(toxic) * (sum(toxic) + 1) / 2.0) / (sum(toxic) * sum(1 - toxic)), 6) AS auroc FROM r
""")
def auroc_by_ranks(t: Tables) -> DataFrame:
    return rounded(S.auroc(_labelled(t), [], "n_chars", "toxic"), "auroc")


@query(f"""
WITH {_LABELLED}, r AS (SELECT lang, toxic, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS k FROM m)
SELECT lang, sum(toxic)::BIGINT AS n_pos, sum(1 - toxic)::BIGINT AS n_neg, round((sum(k) FILTER (toxic = 1) - sum(toxic) * (sum(toxic) + 1) / 2.0) / (sum(toxic) * sum(1 - toxic)), 6) AS auroc FROM r GROUP BY lang
""")
def auroc_by_family(t: Tables) -> DataFrame:
    return rounded(S.auroc(_labelled(t), ["lang"], "n_chars", "toxic"), "auroc")


_RANKS = "rank() OVER (PARTITION BY {p} ORDER BY {x}) + (count(*) OVER (PARTITION BY {p}, {x}) - 1) / 2.0"


@query(f"""
WITH r AS (SELECT event_type, {_RANKS.format(p="event_type", x="value")} AS a, {_RANKS.format(p="event_type", x="user_id")} AS b FROM events)
SELECT event_type, count(*) AS n, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1
""")
def spearman_by_arm(t: Tables) -> DataFrame:
    return rounded(S.spearman(t.events, ["event_type"], "value", "user_id"), "spearman")


@query("SELECT l_returnflag, count(*) AS n, round(1 - sum((l_extendedprice - l_quantity * 1500) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) AS r2 FROM lineitem GROUP BY 1")
def r_squared(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("p", F.col("l_quantity") * 1500)
    return rounded(S.r_squared(rows, ["l_returnflag"], "l_extendedprice", "p"), "r2")


@query("""
WITH h AS (SELECT user_id, avg(value) FILTER (event_id % 2 = 0) AS a, avg(value) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY 1)
SELECT count(*) AS n, round(corr(a, b), 6) AS r, round(2 * corr(a, b) / (1 + corr(a, b)), 6) AS reliability FROM h
""")
def split_half_reliability(t: Tables) -> DataFrame:
    half = lambda k: F.avg(F.when(F.col("event_id") % 2 == k, F.col("value")))
    return rounded(S.spearman_brown(t.events.groupBy("user_id").agg(half(0).alias("a"), half(1).alias("b")), "a", "b"), "r", "reliability")


@query(f"""
WITH {_LABELLED}, tr AS (SELECT lang, avg(n_chars) AS mu FROM m WHERE quality = 1 GROUP BY 1), w AS (SELECT avg(n_chars) AS mu FROM m WHERE quality = 1)
SELECT count(*) AS n, round(1 - sum((n_chars - coalesce(tr.mu, w.mu)) ** 2) / (var_pop(n_chars) * count(*)), 6) AS r2 FROM m LEFT JOIN tr USING (lang), w WHERE quality = 0
""")
def family_mean_r2(t: Tables) -> DataFrame:
    rows = _labelled(t)
    predicted = S.family_mean_predictions(rows.where("quality = 1"), rows.where("quality = 0"), "lang", "n_chars")
    return rounded(S.r_squared(predicted, [], "n_chars", "predicted"), "r2")


@query("""
WITH c AS (SELECT l_quantity - avg(l_quantity) OVER (PARTITION BY l_returnflag) AS q, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS p FROM lineitem)
SELECT count(*) AS n, round(corr(q, p), 6) AS r FROM c
""")
def within_family_correlation(t: Tables) -> DataFrame:
    rows = S.within_family(t.lineitem.select("l_returnflag", "l_quantity", "l_extendedprice"), "l_returnflag", ["l_quantity", "l_extendedprice"])
    return rounded(rows.agg(F.count("*").alias("n"), S.pearson(F.col("l_quantity"), F.col("l_extendedprice")).alias("r")), "r")


@query("""
WITH f AS (SELECT avg(l_extendedprice) AS my, avg(l_quantity) AS mx, covar_pop(l_quantity, l_extendedprice) / var_pop(l_quantity) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice - my - b * (l_quantity - mx), 2) + 0 AS residual FROM lineitem, f
""")
def length_residuals(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    out = S.residuals(rows, "l_extendedprice", ["l_quantity"], "residual").drop("l_quantity", "l_extendedprice")
    return out.withColumn("residual", F.round("residual", 2) + 0)


@query(f"""
WITH {_LABELLED}, s AS (SELECT lang, min(n_chars) AS lo, max(n_chars) AS hi FROM m GROUP BY 1),
o AS (SELECT a.lang, min(b.lo) AS lo, max(b.hi) AS hi FROM s a JOIN s b ON a.lang <> b.lang GROUP BY 1),
u AS (SELECT lang, avg((n_chars < o.lo OR n_chars > o.hi)::INT) AS uncovered FROM m JOIN o USING (lang) GROUP BY 1),
r AS (SELECT lang, {_RANKS.format(p="lang", x="n_chars")} AS a, {_RANKS.format(p="lang", x="doc_id")} AS b FROM m)
SELECT lang, count(*) AS n, round(corr(a, b), 6) AS spearman, round(any_value(uncovered), 6) AS uncovered FROM r JOIN u USING (lang) GROUP BY lang
""")
def leave_one_family_out(t: Tables) -> DataFrame:
    return rounded(S.lofo_spearman(_labelled(t), "lang", "n_chars", "doc_id"), "spearman", "uncovered")


@query(f"WITH {_LABELLED} SELECT lang, count(*) AS n, count(*) FILTER (n_chars < 500) AS out_short, count(*) FILTER (quality = 0) AS out_poor, count(*) FILTER (NOT (n_chars < 500 OR quality = 0)) AS kept FROM m GROUP BY 1")
def exclusion_report(t: Tables) -> DataFrame:
    return A.exclusions(_labelled(t), "lang", {"short": F.col("n_chars") < 500, "poor": F.col("quality") == 0})


@query(f"""
WITH {_LABELLED}, g AS (SELECT lang, count(*) AS n, avg(n_chars) AS mu, var_pop(n_chars) AS v FROM m GROUP BY 1), a AS (SELECT sum(n * mu) / sum(n) AS mu FROM g)
SELECT sum(n)::BIGINT AS n, count(*) AS families, round(sum(n * (g.mu - a.mu) ** 2) / (sum(n * (g.mu - a.mu) ** 2) + sum(n * v)), 6) AS eta_squared FROM g, a
""")
def variance_between_families(t: Tables) -> DataFrame:
    return rounded(A.eta_squared(_labelled(t), "lang", "n_chars"), "eta_squared")


@query("""
SELECT o_orderstatus, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q3,
       max(o_totalprice) AS max, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std, count(*) AS n FROM orders GROUP BY 1
""")
def distribution_summary(t: Tables) -> DataFrame:
    return rounded(A.distribution(t.orders, ["o_orderstatus"], "o_totalprice"), "q1", "median", "q3", "mean", "std", digits=4)


@query("""
WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS n, max(value) AS max, round(avg(value), 6) AS mean, max(value) FILTER (i = n // 2) AS p50, max(value) FILTER (i = floor(n * 0.95::DOUBLE)) AS p95, count(*) FILTER (value > 100) AS over_100, count(*) FILTER (value > 200) AS over_200 FROM s GROUP BY 1
""")
def delta_distribution(t: Tables) -> DataFrame:
    return rounded(A.index_quantiles(t.events, ["event_type"], "value", [100, 200]), "mean")


@query("SELECT b.bin, coalesce(c.n, 0)::BIGINT AS n FROM (SELECT unnest(range(10))::INT AS bin) b LEFT JOIN (SELECT greatest(least(floor(value / 10), 9), 0)::INT AS bin, count(*) AS n FROM events GROUP BY 1) c USING (bin)")
def histogram_0_100(t: Tables) -> DataFrame:
    return A.histogram(t.events, "value", 10, 10)


@query(f"""
WITH {_LABELLED} SELECT lang, quality AS difficulty, count(*) FILTER (n_chars < 5000) AS n, count(*) FILTER (n_chars < 5000 AND toxic = 0) AS correct,
  round(count(*) FILTER (n_chars < 5000 AND toxic = 0) / nullif(count(*) FILTER (n_chars < 5000), 0), 6) AS accuracy, (2 * grouping(lang) + grouping(quality))::BIGINT AS level FROM m GROUP BY CUBE (lang, quality)
""")
def accuracy_tables(t: Tables) -> DataFrame:
    rows = _labelled(t).withColumnRenamed("quality", "difficulty")
    return rounded(A.accuracy(rows, "lang", "difficulty", F.col("toxic") == 0, F.col("n_chars") < 5000), "accuracy")


@query(f"""
WITH {_LABELLED} SELECT lang, count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 0 AND quality = 0) AS fp, count(*) FILTER (toxic = 1 AND quality = 1) AS fn, count(*) FILTER (toxic = 0 AND quality = 1) AS tn,
  round(count(*) FILTER (toxic = 0 AND quality = 0) / nullif(count(*) FILTER (toxic = 0), 0), 6) AS fp_rate, round(count(*) FILTER (toxic = 1 AND quality = 1) / nullif(count(*) FILTER (toxic = 1), 0), 6) AS fn_rate FROM m GROUP BY 1
""")
def confusion_by_family(t: Tables) -> DataFrame:
    return rounded(V.confusion(_labelled(t), ["lang"], F.col("toxic") == 1, F.col("quality") == 0), "fp_rate", "fn_rate")


@query(f"""
WITH {_LABELLED}, v AS (SELECT doc_id, quality = 1 AS yes FROM m UNION ALL SELECT doc_id, toxic = 0 FROM m UNION ALL SELECT doc_id, n_chars > 1000 FROM m WHERE n_chars > 200)
SELECT doc_id, count(*) FILTER (yes) AS n_yes, count(*) FILTER (NOT yes) AS n_no, CASE WHEN count(*) >= 2 AND count(*) FILTER (yes) > count(*) FILTER (NOT yes) THEN 'YES' WHEN count(*) >= 2 AND count(*) FILTER (NOT yes) > count(*) FILTER (yes) THEN 'NO' END AS label FROM v GROUP BY 1
""")
def consensus_labels(t: Tables) -> DataFrame:
    yes = lambda c: F.when(c, "YES").otherwise("NO")
    third = F.when(F.col("n_chars") > 200, yes(F.col("n_chars") > 1000)).otherwise("UNSURE")
    votes = _labelled(t).select("doc_id", F.explode(F.array(yes(F.col("quality") == 1), yes(F.col("toxic") == 0), third)).alias("label"))
    return V.consensus(votes, "doc_id", "label")


@query(f"""
WITH {_LABELLED}, g AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1 - toxic) AS agree, sum(quality) / count(*) AS pa, sum(1 - toxic) / count(*) AS pb FROM m GROUP BY 1)
SELECT lang, n, agree, round(k, 6) AS kappa, k >= 0.6 AS passes
FROM (SELECT *, CASE WHEN pe = 1 THEN CASE WHEN agree = n THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE (agree / n - pe) / (1 - pe) END AS k FROM (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM g))
""")
def cohens_kappa(t: Tables) -> DataFrame:
    rows = _labelled(t).withColumn("clean", 1 - F.col("toxic"))
    return rounded(V.kappa(rows, ["lang"], "quality", "clean").withColumn("agree", F.col("agree").cast("long")), "kappa")


@query("""
SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
WHERE n <= 12 OR i IN (SELECT j * n // 12 FROM range(12) r(j))
""")
def even_stride_sample(t: Tables) -> DataFrame:
    return M.even_stride(t.orders.select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], "o_orderkey", 12)


@query("SELECT c_nationkey, c_custkey, ((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) % 4)::INT AS shard FROM customer")
def round_robin_shards(t: Tables) -> DataFrame:
    return M.round_robin(t.customer.select("c_nationkey", "c_custkey"), ["c_nationkey"], "c_custkey", 4)


@query("""
SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('5:' || c_custkey::VARCHAR), c_custkey) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
WHERE k <= greatest(10, floor(n * 0.05::DOUBLE))
""")
def stratified_sample(t: Tables) -> DataFrame:
    return M.stratified(t.customer.select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", 5, 0.05, 10)


@query("""
WITH s AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), q AS (SELECT c_nationkey, n, least(round_even(100.0::DOUBLE * n / (SELECT sum(n) FROM s), 0)::BIGINT, n) AS q FROM s),
d AS (SELECT least(100, (SELECT sum(n) FROM s)) - sum(q) AS d FROM q),
f AS (SELECT c_nationkey, q + CASE WHEN row_number() OVER (ORDER BY n DESC, c_nationkey) <= abs(d) THEN sign(d) ELSE 0 END AS q FROM q, d)
SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('9:' || c_custkey::VARCHAR), c_custkey) AS k FROM customer) JOIN f USING (c_nationkey) WHERE k <= q
""")
def proportional_sample(t: Tables) -> DataFrame:
    return M.proportional(t.customer.select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", 9, 100)


@query("""
WITH r AS (SELECT p_brand, p_partkey, (p_size = 50)::INT AS forced, md5('3:' || p_partkey::VARCHAR) AS h FROM part),
k AS (SELECT *, CASE WHEN forced = 1 THEN 0 ELSE row_number() OVER (PARTITION BY forced, p_brand ORDER BY h, p_partkey) END AS tier FROM r)
SELECT p_brand, p_partkey FROM k ORDER BY tier, h, p_partkey LIMIT 90
""")
def covering_sample(t: Tables) -> DataFrame:
    rows = t.part.select("p_brand", "p_partkey", "p_size")
    return M.covering(rows, F.col("p_size") == 50, "p_brand", "p_partkey", 3, 90).select("p_brand", "p_partkey")


@query("SELECT c_custkey, sha256(c_custkey::VARCHAR) AS h, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256(c_custkey::VARCHAR)) AS position, c_nationkey FROM customer")
def hash_shuffle(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    rows = t.customer.select("c_custkey", F.sha2(F.col("c_custkey").cast("string"), 256).alias("h"), "c_nationkey")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("h")).cast("long"))


@query("""
SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount FROM lineitem WHERE l_quantity > 49 ORDER BY l_discount DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50
""")
def confident_errors(t: Tables) -> DataFrame:
    """Top-k report."""
    rows = t.lineitem.where("l_quantity > 49").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount")
    return rows.orderBy(F.desc("l_discount"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(50)


@query("SELECT doc_id, (('0x' || substr(md5('1:' || doc_id::VARCHAR), 1, 8))::BIGINT % 5)::INT AS fold FROM documents")
def hash_folds(t: Tables) -> DataFrame:
    return M.folds(t.documents.select("doc_id"), "doc_id", 5, 1)


@query("SELECT d.doc_id, f.held, CASE WHEN d.lang = f.held THEN 'test' ELSE 'train' END AS role FROM documents d, (VALUES ('en'), ('de'), ('fr'), ('es')) f(held)")
def family_splits(t: Tables) -> DataFrame:
    return M.leave_one_out_splits(t.documents.select("doc_id", "lang"), "lang", ["en", "de", "fr", "es"]).drop("lang")


@query("SELECT event_id, round(list_sum(list_transform([value, user_id, 10.0], lambda x: -(x / (value + user_id + 10)) * ln(greatest(x, 1e-300) / (value + user_id + 10)))), 6) AS entropy FROM events")
def token_entropy(t: Tables) -> DataFrame:
    total = F.col("value") + F.col("user_id") + 10
    p = F.transform(F.array("value", F.col("user_id").cast("double"), F.lit(10.0)), lambda x: x / total)
    return rounded(t.events.select("event_id", entropy(p).alias("entropy")), "entropy")


@query("SELECT event_id, round(exp(value / 100 - m) / (exp(value / 100 - m) + exp(user_id / 100 - m) + exp(0.5 - m)), 6) AS p FROM (SELECT event_id, value, user_id, greatest(value / 100, user_id / 100, 0.5) AS m FROM events)")
def softmax_first(t: Tables) -> DataFrame:
    logits = F.array(F.col("value") / 100, F.col("user_id") / 100, F.lit(0.5))
    return rounded(t.events.select("event_id", softmax(logits)[0].alias("p")), "p")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(l_discount, l_tax, 0.04::DOUBLE) - greatest(l_tax, 0.04::DOUBLE), 6) AS contrast FROM lineitem")
def leave_one_out_contrast(t: Tables) -> DataFrame:
    scores = F.array("l_discount", "l_tax", F.lit(0.04))
    return rounded(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", leave_one_out(scores, F.lit(0)).alias("contrast")), "contrast")


@query()
def semantic_volume_by_label(t: Tables) -> DataFrame:
    return rounded(P.semantic_volume(t.embeddings, "label", "embedding"), "volume", digits=4)


@query()
def ridge_probe_out_of_fold(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", "embedding", "label").withColumn("y", F.col("label").cast("double"))
    return S.r_squared(P.out_of_fold(rows, "embedding", "y", "vec_id"), [], "y", "predicted")


@query()
def logistic_median_split(t: Tables) -> DataFrame:
    rows = t.embeddings.withColumn("high", (F.col("label") >= 5).cast("int"))
    w, b = P.logistic(rows, "embedding", "high")
    return S.auroc(P.predict(rows, "embedding", w, b), [], "predicted", "high")


_LABELLED_SQL = "SELECT d.doc_id, d.n_chars, d.doc_id % 97 AS other, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NOT NULL"
_LEAF, _REPLICATES = 64, 50
_SIZES_SQL = """
size AS (SELECT count(*) FILTER (toxic = 1) AS np, count(*) AS n FROM k),
cdf AS (SELECT j, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(np / n) + (n - j) * ln(1 - np / n))) OVER (ORDER BY j) AS f FROM (SELECT *, unnest(range(0, n + 1)) AS j FROM size)),
tried AS (SELECT r, a, count(*) FILTER (f <= (h + 0.5) / 4294967296) AS m FROM (SELECT r, a, {hash} AS h FROM range(1, 51) x(r), range(0, 20) y(a)), cdf GROUP BY ALL),
positives AS (SELECT r, arg_min(m, a) AS m FROM tried, size WHERE m > 0 AND m < n GROUP BY r),
share AS (SELECT r, 1 AS c, m::BIGINT AS m FROM positives UNION ALL SELECT r, 0, (n - m)::BIGINT FROM positives, size)"""


def _hash_sql(*parts: str) -> str:
    x = "xor(h, p)"
    for shift, times in ((16, 0x7FEB352D), (15, 0x2C1B3C6D)):
        x = f"((xor({x}, ({x}) >> {shift}) * {times}) & 4294967295)"
    return f"list_reduce([0::BIGINT, {', '.join(f'({p})::BIGINT' for p in parts)}], lambda h, p: xor({x}, ({x}) >> 16))"


def _drawn_sql(share: str) -> str:
    """w(r, w, toxic, ...): counts of rows drawn with replacement, `share` (r, c, m) of them from each class, by splits of blocks in two."""
    u = _hash_sql("0", "r", "c", "level", "node")
    pmf = "exp(lgamma(m + 1) - lgamma(b.j + 1) - lgamma(m - b.j + 1) + b.j * ln(greatest(q, 1e-300)) + (m - b.j) * ln(greatest(1 - q, 1e-300)))"
    steps = f"list_reduce(list_prepend({{'j': -1::BIGINT, 's': 0::DOUBLE, 'n': 0::BIGINT}}, list_transform(range(0, m + 1), lambda x: {{'j': x, 's': 0::DOUBLE, 'n': 0::BIGINT}})), lambda a, b: {{'j': b.j, 's': a.s + {pmf}, 'n': a.n + (a.s + {pmf} <= u)::BIGINT}}).n"
    return f"""
k AS ({_LABELLED_SQL}), {share},
row AS (SELECT *, (toxic = 1)::INT AS c, row_number() OVER (PARTITION BY toxic = 1 ORDER BY doc_id::VARCHAR) - 1 AS i FROM k),
total AS (SELECT c, count(*) AS n, CASE WHEN count(*) <= {_LEAF} THEN 0 ELSE floor(log2(ceil(count(*) / {_LEAF}) - 1))::INT + 1 END AS depth FROM row GROUP BY c),
node AS (SELECT r, s.c, n, depth, 0 AS level, 0::BIGINT AS node, m FROM share s JOIN total t ON s.c = t.c),
tree AS (SELECT * FROM node UNION ALL
  SELECT r, c, n, depth, level + 1, 2 * node + side, CASE WHEN side = 0 THEN ml ELSE m - ml END
  FROM (SELECT *, CASE WHEN q >= 1 THEN m WHEN q <= 0 THEN 0 ELSE {steps} END AS ml
    FROM (SELECT *, greatest(0, least(w, n - 2 * node * w)) / greatest(1, greatest(0, least(2 * w, n - 2 * node * w))) AS q, ({u} + 0.5) / 4294967296 AS u
      FROM (SELECT *, ({_LEAF} << (depth - level - 1))::BIGINT AS w FROM tree WHERE level < depth))), range(0, 2) z(side)),
dealt AS (SELECT r, c, node * {_LEAF} + (({_hash_sql("0", "r", "c", "100", "node", "d")} * least({_LEAF}, n - node * {_LEAF})) >> 32) AS i
  FROM (SELECT *, unnest(range(0, m)) AS d FROM tree WHERE level = depth)),
w AS (SELECT 0 AS r, 1 AS w, k.* FROM k UNION ALL SELECT g.r, g.w, row.* EXCLUDE (c, i) FROM (SELECT r, c, i, count(*) AS w FROM dealt GROUP BY ALL) g JOIN row ON g.c = row.c AND g.i = row.i)"""


_DRAWN_SQL = _drawn_sql(_SIZES_SQL.format(hash=_hash_sql("0", "r", "2", "a")).strip())
_MIXTURE_SQL = _drawn_sql("share AS (SELECT r, c, CASE c WHEN 1 THEN 94 ELSE 32 END::BIGINT AS m FROM range(1, 51) x(r), range(0, 2) y(c))")


def _auroc_sql(score: str) -> str:
    """AUROC of each replicate by weighted average ranks."""
    return f"""(SELECT r, (sum(rank * p) - sum(p) * (sum(p) + 1) / 2) / nullif(sum(p) * (sum(c) - sum(p)), 0) AS auroc
      FROM (SELECT r, c, p, sum(c) OVER (PARTITION BY r ORDER BY s) - (c - 1) / 2 AS rank FROM (SELECT r, {score} AS s, sum(w) AS c, sum(w * toxic) AS p FROM w WHERE w > 0 AND {score} IS NOT NULL GROUP BY ALL)) GROUP BY r)"""


_INTERVAL_SQL = "SELECT round(max(x) FILTER (r = 0), 6) AS observed, round(quantile_cont(x, 0.025) FILTER (r > 0), 6) AS low, round(quantile_cont(x, 0.975) FILTER (r > 0), 6) AS high FROM d WHERE x IS NOT NULL"


@query(f"WITH RECURSIVE {_DRAWN_SQL}, d AS (SELECT a.r, a.auroc - b.auroc AS x FROM {_auroc_sql('n_chars')} a JOIN {_auroc_sql('other')} b ON a.r = b.r) SELECT *, low > 0 OR high < 0 AS excludes_zero FROM ({_INTERVAL_SQL})")
def bootstrap_auroc_interval(t: Tables) -> DataFrame:
    rows = _labelled(t).withColumn("other", F.col("doc_id") % 97)
    return rounded(B.bootstrap_auroc_difference(rows, "n_chars", "other", "toxic", _REPLICATES, key="doc_id", leaf=_LEAF), "observed", "low", "high")


@query(f"WITH RECURSIVE {_DRAWN_SQL}, d AS (SELECT r, auroc AS x FROM {_auroc_sql('n_chars')}) {_INTERVAL_SQL}")
def bootstrap_single_interval(t: Tables) -> DataFrame:
    return rounded(B.bootstrap_auroc(_labelled(t), "n_chars", "toxic", _REPLICATES, key="doc_id", leaf=_LEAF), "observed", "low", "high")


@query(f"""WITH RECURSIVE {_MIXTURE_SQL}, d AS (SELECT r, auroc AS x FROM {_auroc_sql('n_chars')} WHERE r > 0), l AS (SELECT quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.975) AS high, quantile_cont(x, 0.5) AS median FROM d)
SELECT round(low, 6) AS low, round(high, 6) AS high, round(high - low, 6) AS width, round(median, 6) AS median, (SELECT count(*) FROM k WHERE toxic = 1) AS n_pos, (SELECT count(*) FROM k WHERE toxic <> 1) AS n_neg FROM l""")
def bootstrap_mixture_interval(t: Tables) -> DataFrame:
    """126 rows of which a quarter are negative, which the labels don't have."""
    return rounded(B.mixture(_labelled(t), "n_chars", "toxic", 126, 0.25, _REPLICATES, key="doc_id", leaf=_LEAF), "low", "high", "width", "median")


@query("""
WITH f AS (SELECT user_id::VARCHAR AS f, avg(value) FILTER (event_type = 'view') - avg(value) FILTER (event_type = 'click') AS d FROM events GROUP BY 1), g AS (SELECT * FROM f WHERE d IS NOT NULL),
s AS (SELECT p, sum(CASE WHEN ('0x' || substr(md5('4:' || p::VARCHAR || ':' || f), 1, 1))::INT < 8 THEN d ELSE -d END) AS t FROM g, range(500) r(p) GROUP BY p)
SELECT (SELECT count(*) FROM g)::INT AS n, round((SELECT avg(d) FROM g), 6) AS observed, round((sum((abs(t) >= abs((SELECT sum(d) FROM g)) - 1e-12)::INT) + 1) / 501, 6) AS p FROM s
""")
def sign_flip_permutation(t: Tables) -> DataFrame:
    mean = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    diffs = t.events.groupBy("user_id").agg((mean("view") - mean("click")).alias("d"))
    return rounded(S.sign_flip(diffs, "user_id", "d", 500, 4), "observed", "p")
