"""Scans and sinks, scored answers, statements, verdicts and generated records, over rows made from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.functions import echo, outputs, scorer
from lakequill.functions import records as R
from lakequill.functions import text as X
from lakequill.operators import cases, pairs, puzzles
from lakequill.operators import stats as S
from lakequill.plans.catalog import Tables, query, rounded, spread
from lakequill.sources import readers, writers

_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_SQL_KEY = ", ".join(_KEY)


def _int(c: str) -> F.Column:
    return F.col(c).cast("int").cast("string")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def json_round_trip(t: Tables) -> DataFrame:
    path = t.scratch("orders")
    writers.write_json(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return readers.read_jsonl(t.spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100")
def first_json_rows(t: Tables) -> DataFrame:
    path = t.scratch("orders")
    writers.write_json(t.orders.select("o_orderkey", "o_custkey"), path)
    return readers.read_jsonl(t.spark, path, "o_orderkey long, o_custkey long", limit=100, order="o_orderkey")


@query("SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def appended_log(t: Tables) -> DataFrame:
    """Two appends to a log, and a log that was never written."""
    path, rows = t.scratch("log"), t.orders.select("o_orderkey", "o_orderstatus")
    for status in ("F", "O"):
        writers.append_jsonl(rows.where(F.col("o_orderstatus") == status), path)
    schema = "o_orderkey long, o_orderstatus string"
    every = readers.read_log(t.spark, path, schema).union(readers.read_log(t.spark, t.scratch("none"), schema))
    return every.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"))


@query("SELECT event_id, user_id FROM events WHERE event_id < (SELECT max(event_id) // 2 FROM events)")
def torn_log(t: Tables) -> DataFrame:
    """A log whose line in the middle is broken off: what comes before it counts."""
    path = t.scratch("torn")
    middle = t.events.agg(F.floor(F.max("event_id") / 2).alias("_m"))
    whole = F.to_json(F.struct("event_id", "user_id"))
    torn = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "us'))
    t.events.crossJoin(F.broadcast(middle)).select(F.when(F.col("event_id") == F.col("_m"), torn).otherwise(whole)).write.text(path)
    return readers.read_torn_log(t.spark, path, "event_id long, user_id long", "event_id")


@query("SELECT n_name AS task_id, n_nationkey AS nation FROM nation")
def result_folder(t: Tables) -> DataFrame:
    """A file for each of the nations, and one that is to be skipped."""
    path = t.scratch("results")
    for r in t.nation.select("n_name", "n_nationkey").collect():  # the TPC-H nations: 25 rows at any scale
        writers.write_record(t.spark, f"{path}/{r[0]}.json", {"nation": r[1]})
    writers.write_record(t.spark, f"{path}/_partial.json", {"nation": "broken"})
    return readers.read_result_dir(t.spark, path, "nation long").select(F.replace("task_id", F.lit("%20"), F.lit(" ")).alias("task_id"), "nation")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 3")
def per_key_folders(t: Tables) -> DataFrame:
    """A folder for each region, one of which is left out without a look at the others."""
    path = t.scratch("by-region")
    writers.write_per_key(t.nation.select("n_nationkey", "n_name", "n_regionkey"), path, "n_regionkey")
    return t.spark.read.schema("n_nationkey long, n_name string, n_regionkey long").json(path).where("n_regionkey <> 3")


@query("SELECT l_linenumber::INT AS item_index, count(*) AS n FROM lineitem WHERE NOT (l_linenumber = 2 AND l_orderkey % 3 = 0) GROUP BY 1")
def register_scan(t: Tables) -> DataFrame:
    """Rows of a register of pruned items are read back and left out."""
    path, missing = t.scratch("register"), t.scratch("none")
    rows = t.lineitem.select(F.col("l_orderkey").cast("string").alias("task_id"), F.col("l_linenumber").cast("int").alias("item_index"))
    writers.write_json(rows.where("item_index = 2 AND cast(task_id AS long) % 3 = 0").distinct(), path)
    register = readers.read_register(t.spark, path).union(readers.read_register(t.spark, missing))
    return rows.join(register, ["task_id", "item_index"], "left_anti").groupBy("item_index").agg(F.count("*").alias("n"))


@query("""
SELECT c_custkey::VARCHAR AS annotator_id, u.item, CASE u.item WHEN 'q1' THEN CASE WHEN c_nationkey % 4 = 0 THEN 'YES' WHEN c_nationkey % 4 = 1 THEN 'NO' WHEN c_nationkey % 4 = 2 THEN 'UNSURE' END ELSE 'NO' END AS label
FROM customer, (VALUES ('q1'), ('q2')) u(item)
""")
def human_labels(t: Tables) -> DataFrame:
    said = F.element_at(F.array(F.lit(" yes"), F.lit("No "), F.lit("unsure"), F.lit("maybe")), (F.col("c_nationkey") % 4 + 1).cast("int"))
    rows = t.customer.select(F.col("c_custkey").cast("string").alias("annotator_id"), F.lit("human").alias("annotator_kind"), F.create_map(F.lit("q1"), said, F.lit("q2"), F.lit("no")).alias("labels"))
    return readers.read_labels(rows)


@query("""
SELECT 1 AS line, '| r_regionkey | r_name |' AS text UNION ALL SELECT 2, '|---|---|' UNION ALL
SELECT 2 + row_number() OVER (ORDER BY r_regionkey), '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region
""")
def region_report(t: Tables) -> DataFrame:
    """A Markdown table of the regions, line by line."""
    report = writers.markdown_table(t.region.select("r_regionkey", "r_name").orderBy("r_regionkey"))
    return t.spark.createDataFrame(list(enumerate(report.split("\n"), 1)), "line long, text string")


@query("SELECT r_regionkey, r_name || ' is region ' || r_regionkey || ', {{missing}}' AS text, 'missing' AS missing FROM region")
def filled_templates(t: Tables) -> DataFrame:
    template = "{{name}} is region {{ n }}, {{missing}}"
    rows = [(r[0], *writers.fill_template(template, {"name": r[1], "n": str(r[0])})) for r in t.region.select("r_regionkey", "r_name").collect()]
    return t.spark.createDataFrame([(k, text, ",".join(gone)) for k, text, gone in rows], "r_regionkey long, text string, missing string")


@query("""SELECT r_regionkey, sha256('{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}') AS hash FROM region""")
def canonical_hashes(t: Tables) -> DataFrame:
    rows = [(r["r_regionkey"], writers.canonical_hash(r.asDict())) for r in t.region.select("r_regionkey", "r_name").collect()]
    return t.spark.createDataFrame(rows, "r_regionkey long, hash string")


@query(f"""
SELECT {_SQL_KEY}, CASE WHEN l_linenumber % 2 = 0 THEN 'one|three' ELSE 'zero|one|three|' || l_returnflag END AS docs FROM lineitem
""")
def axis_documents(t: Tables) -> DataFrame:
    """Even lines are of the axis that leaves sources out, the others get their flag as a correction."""
    source = lambda i, text: F.struct(F.lit(i).alias("id"), F.lit(text).alias("text"))
    sources = F.array(source(3, "three"), source(0, "zero"), source(1, "one"))
    docs = R.axis_documents(F.when(F.col("l_linenumber") % 2 == 0, "A2").otherwise("A1"), sources, F.array(F.lit(0)), F.array("l_returnflag"))
    return t.lineitem.select(*_KEY, F.array_join(docs, "|").alias("docs"))


@query("SELECT l_orderkey, 1 + count(*)::INT AS n, max(greatest(l_returnflag, 'C')) AS last FROM lineitem GROUP BY 1")
def asserted_texts(t: Tables) -> DataFrame:
    claims = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("id"), F.col("l_returnflag").alias("text"))).alias("claims"))
    said = R.asserted_texts(F.lit("C"), F.col("claims"))
    return claims.select("l_orderkey", F.size(said).alias("n"), F.array_max(said).alias("last"))


@query(f"SELECT {_SQL_KEY}, l_suppkey % 4 = 0 OR l_returnflag = 'R' AS flagged FROM lineitem")
def flagged_claims(t: Tables) -> DataFrame:
    ids = F.when(F.col("l_suppkey") % 4 > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return t.lineitem.select(*_KEY, R.flagged(ids, F.col("l_returnflag") == "R").alias("flagged"))


@query("""
SELECT list_aggregate(r, 'string_agg', ',') AS reasons, count(*) AS n
FROM (SELECT list_filter([CASE WHEN NOT o_totalprice < 100000 THEN 'price' END, CASE WHEN NOT o_orderstatus <> 'P' THEN 'status' END], lambda x: x IS NOT NULL) AS r FROM orders) GROUP BY 1
""")
def quarantined_rows(t: Tables) -> DataFrame:
    good, bad = readers.quarantine(t.orders.select("o_totalprice", "o_orderstatus"), {"price": F.col("o_totalprice") < 100000, "status": F.col("o_orderstatus") != "P"})
    every = good.select(F.lit(None).cast("string").alias("reasons")).union(bad.select(F.array_join("reasons", ",")))
    return every.groupBy("reasons").agg(F.count("*").alias("n"))


@query("""
SELECT 'read' AS part, count(*) AS n FROM embeddings WHERE len(embedding) = 64 AND vec_id % 5 > 0 UNION ALL
SELECT 'shape', count(*) FROM embeddings WHERE NOT (len(embedding) = 64 AND vec_id % 5 > 0)
""")
def vector_scan(t: Tables) -> DataFrame:
    """Every fifth vector is cut short; the scan goes on and says which it could not use."""
    cut = F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 60)).otherwise(F.col("embedding"))
    good, bad = readers.check_vectors(t.embeddings.select("vec_id", cut.alias("embedding")), "embedding", 64)
    return good.agg(F.lit("read").alias("part"), F.count("*").alias("n")).union(bad.agg(F.max(F.array_join("reasons", ",")), F.count("*")))


_ERFC = "1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * CASE WHEN {x} = 0 THEN 0 ELSE exp((2 * k + 1) * ln({x}) - lgamma(k + 1) - ln(2 * k + 1)) END))"


@query(f"""
WITH r AS (SELECT event_type AS arm, count(*) FILTER (value > 60) AS x, count(*) AS n FROM events GROUP BY 1),
z AS (SELECT a.arm AS arm_a, b.arm AS arm_b, (a.x / a.n - b.x / b.n) / sqrt((a.x + b.x) / (a.n + b.n) * (1 - (a.x + b.x) / (a.n + b.n)) * (1 / a.n + 1 / b.n)) AS z FROM r a JOIN r b ON a.arm < b.arm),
p AS (SELECT *, {_ERFC.format(x="(abs(z) / sqrt(2))")} AS p FROM z)
SELECT arm_a, arm_b, round(z, 6) AS z, round(p, 6) AS p, round(least(3 * p, 1), 6) AS p_corrected FROM p
""")
def corrected_p_values(t: Tables) -> DataFrame:
    rates = t.events.groupBy(F.col("event_type").alias("arm")).agg(F.count_if(F.col("value") > 60).alias("successes"), F.count("*").alias("trials"))
    out = S.corrected(S.pairwise_z(rates, "arm"), 3).select("arm_a", "arm_b", "z", "p", "p_corrected")
    return rounded(out, "z", "p", "p_corrected")


@query("SELECT event_type, round((1.959963984540054 + 0.8416212335729143) * sqrt(2 * r * (1 - r) / n), 6) AS effect FROM (SELECT event_type, avg((value > 60)::INT) AS r, count(*) AS n FROM events GROUP BY 1)")
def detectable_effects(t: Tables) -> DataFrame:
    rates = t.events.groupBy("event_type").agg(F.avg((F.col("value") > 60).cast("int")).alias("r"), F.count("*").alias("n")).collect()  # one row an event type
    rows = [(r["event_type"], round(S.minimum_detectable_effect(r["r"], r["n"]), 6)) for r in rates]
    return t.spark.createDataFrame(rows, "event_type string, effect double")


@query("SELECT r_regionkey, round(1 - pow(0.05, 1 / (10 + 7 * r_regionkey)), 6) AS none, round(pow(0.95, 1 / (10 + 7 * r_regionkey)), 6) AS all_but_one FROM region")
def exact_upper_bounds(t: Tables) -> DataFrame:
    """Exact one-sided bounds where they have a closed form: no success, and all but one."""
    rows = [(r[0], round(S.upper_95(0, 10 + 7 * r[0]), 6), round(S.upper_95(9 + 7 * r[0], 10 + 7 * r[0]), 6)) for r in t.region.select("r_regionkey").collect()]
    return t.spark.createDataFrame(rows, "r_regionkey long, none double, all_but_one double")


@query("SELECT event_id, value < 5 OR value <= 40 AS degenerate FROM events")
def degenerate_volumes(t: Tables) -> DataFrame:
    return t.events.select("event_id", pairs.degenerate(F.when(F.col("value") >= 5, F.col("value")), 40.0).alias("degenerate"))


_BARS = {"r2": 0.5, "spearman": 0.4, "within": 0.3, "margin": 0.1, "negatives": 10, "ood_pooled": 0.2, "ood_min": 0.1, "vs_verbal": 0.0, "vs_entropy": 0.02, "probe_over": 0.05, "auc": 0.7}


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS neg, l_quantity / 50 AS r2, l_discount * 10 AS sp, l_tax * 10 AS wi, l_discount AS ma, l_discount * 6 AS wr, l_returnflag = 'R' AS un, l_tax * 5 AS op, l_tax * 3 AS om, l_discount - 0.02 AS vv, l_tax - 0.01 AS ve, l_tax AS pr, l_discount * 10 AS auc FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN neg < 10 THEN 'not_evaluable'
  WHEN r2 >= 0.5 AND sp >= 0.4 AND wi >= 0.3 AND ma >= 0.1 THEN CASE WHEN wr < 0.3 THEN 'length_confounded' WHEN un THEN 'range_uncovered' WHEN op < 0.2 OR om < 0.1 THEN 'ood_failure' WHEN vv <= 0 THEN 'no_margin_over_verbalised'
    WHEN ve <= 0.02 THEN 'no_margin_over_entropy' WHEN pr > 0.05 THEN 'dominated_by_correctness_probe' ELSE 'confirmed' END
  WHEN auc >= 0.7 THEN 'binary_only' WHEN r2 >= 0.5 THEN 'margin_only' ELSE 'no_signal' END AS verdict FROM v
""")
def fidelity_verdicts(t: Tables) -> DataFrame:
    """Fidelity measures made of a line's numbers; every branch occurs."""
    q, d, x = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    made = {"n_negatives": q, "r2": q / 50, "spearman": d * 10, "within_spearman": x * 10, "oracle_margin": d, "within_length_residual": d * 6, "range_uncovered": F.col("l_returnflag") == "R", "ood_pooled": x * 5, "ood_min": x * 3, "vs_verbal_low": d - 0.02, "vs_entropy_low": x - 0.01, "probe_over_low": x, "auc": d * 10}
    return t.lineitem.select(*_KEY, *(c.alias(n) for n, c in made.items())).select(*_KEY, cases.fidelity_verdict(_BARS).alias("verdict"))


@query("SELECT count(*) AS controls, count(*) FILTER (l_quantity = l_linenumber * 10) AS fired FROM lineitem WHERE l_returnflag <> 'N'")
def positive_controls(t: Tables) -> DataFrame:
    control = F.struct(F.concat(_int("l_quantity"), F.lit(".0")).alias("target"), (F.col("l_linenumber") * 10).cast("string").alias("emitted"))
    return cases.positive_controls(t.lineitem.select(F.when(F.col("l_returnflag") != "N", control).alias("positive_control")))


@query("SELECT c_custkey, c_name, c_acctbal < 0 AS debt FROM customer")
def blinded_packets(t: Tables) -> DataFrame:
    """What an annotator sees, joined with what is kept back by the key alone."""
    shown, hidden = cases.blinded(t.customer.withColumn("debt", F.col("c_acctbal") < 0), "c_custkey", ["c_name"], ["debt"])
    return shown.join(hidden, "c_custkey")


@query("SELECT part, count(*) AS n, count(*) FILTER (flagged) AS flagged FROM (SELECT 'census' AS part, true AS flagged FROM customer WHERE c_acctbal < 0 UNION ALL (SELECT 'control', false FROM customer WHERE NOT c_acctbal < 0 LIMIT 40)) GROUP BY 1")
def census_and_controls(t: Tables) -> DataFrame:
    """All customers in debt, and forty of the others in proportion to their segments."""
    picked = cases.census_and_controls(t.customer, F.col("c_acctbal") < 0, "c_custkey", 3, 40, "c_mktsegment")
    return picked.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("flagged"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\r\f\x0b]+', ' ', 'g'))) AS h FROM documents")
def collapsed_space(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.collapse_space(F.col("text"))).alias("h"))


@query("""
SELECT doc_id, md5(replace(replace(replace(replace(replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'), 'ø', 'o'), 'ł', 'l')) AS h FROM documents
""")
def folded_texts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.fold(F.col("text"))).alias("h"))


@query("SELECT o_orderkey, list_aggregate(list_sort(list_distinct([o_orderkey::VARCHAR, format('{:,}', o_orderkey), format('{:,}', o_orderkey) || '.00', o_orderkey || '.0'])), 'string_agg', '|') AS forms FROM orders")
def number_spellings(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.array_join(F.array_sort(X.number_forms(F.col("o_orderkey"))), "|").alias("forms"))


@query(f"SELECT {_SQL_KEY}, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 7 END::DOUBLE AS number FROM lineitem")
def numbers_after_markers(t: Tables) -> DataFrame:
    said = F.concat(F.lit("1 of 2, Total "), _int("l_quantity"), F.lit(" in 7"))
    return t.lineitem.select(*_KEY, X.number_after_marker(F.when(F.col("l_linenumber") % 2 == 0, said).otherwise(F.replace(said, F.lit("Total"), F.lit("sum"))), "total").alias("number"))


@query(f"SELECT {_SQL_KEY}, chr((65 + l_linenumber % 5)::INT) AS letter FROM lineitem")
def conclusion_letters(t: Tables) -> DataFrame:
    letter = F.element_at(F.split(F.lit("A B C D E"), " "), (F.col("l_linenumber") % 5 + 1).cast("int"))
    return t.lineitem.select(*_KEY, X.conclusion_letter(F.concat(F.lit("A or B? A's not it, Bad. So "), letter, F.lit("."))).alias("letter"))


@query(f"SELECT {_SQL_KEY}, l_quantity::DOUBLE AS a, l_suppkey::DOUBLE AS b, 2 AS n FROM lineitem")
def worksheets(t: Tables) -> DataFrame:
    """The last of equal names wins; a line that isn't a name and a number is no entry."""
    sheet = F.concat(F.lit("a: 1\nb = "), F.col("l_suppkey").cast("string"), F.lit("\nnothing here\na: "), F.col("l_quantity").cast("string"))
    return t.lineitem.select(*_KEY, X.worksheet(sheet).alias("m")).select(*_KEY, F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), F.size("m").alias("n"))


@query(f"SELECT {_SQL_KEY}, l_linenumber % 3 = 0 AND l_returnflag <> 'A' AS superseded FROM lineitem")
def only_superseded(t: Tables) -> DataFrame:
    """The flag is mentioned in every third line, and then retracted unless it is A."""
    first = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("The flag was revised from "), F.col("l_returnflag"))).otherwise("Nothing")
    second = F.when((F.col("l_linenumber") % 3 == 0) & (F.col("l_returnflag") == "A"), "The flag stands").otherwise("Other things were revised")
    return t.lineitem.select(*_KEY, X.only_superseded(F.array(first, second), "flag", "revised").alias("superseded"))


@query(f"SELECT {_SQL_KEY}, round(l_extendedprice + l_quantity, 2) AS total FROM lineitem")
def currency_totals(t: Tables) -> DataFrame:
    said = F.concat(F.lit("It cost $"), F.format_number("l_extendedprice", 2), F.lit(", for "), _int("l_quantity"), F.lit(" pieces."))
    return rounded(t.lineitem.select(*_KEY, F.aggregate(echo.money(said), F.lit(0.0), lambda a, x: a + x).alias("total")), "total", digits=2)


@query(f"SELECT {_SQL_KEY}, l_returnflag = 'R' AS marker, l_suppkey % 3 > 0 AS avoids, l_quantity = l_linenumber * 5 AS number, l_returnflag = 'R' OR l_suppkey % 3 > 0 OR l_quantity = l_linenumber * 5 AS acknowledged FROM lineitem")
def acknowledged_corrections(t: Tables) -> DataFrame:
    """Source 0 is superseded; the correction gives five times the line's number."""
    said = F.concat(F.when(F.col("l_returnflag") == "R", "The revised stock is ").otherwise("The stock is "), _int("l_quantity"))
    correction = F.concat(F.lit("The stock is "), (F.col("l_linenumber") * 5).cast("string"))
    return t.lineitem.select(*_KEY, echo.acknowledged(F.array(said), F.array(F.col("l_suppkey") % 3), F.array(F.lit(0)).cast("array<bigint>"), F.array(correction)).alias("a")).select(*_KEY, "a.*")


@query(f"SELECT {_SQL_KEY}, l_returnflag || CASE WHEN l_quantity > 25 THEN ' holds.' ELSE ' does not hold.' END AS sentence FROM lineitem")
def boolean_sentences(t: Tables) -> DataFrame:
    return t.lineitem.select(*_KEY, outputs.boolean_sentence(F.col("l_quantity") > 25, F.col("l_returnflag")).alias("sentence"))


@query(f"SELECT {_SQL_KEY}, CASE WHEN l_returnflag = 'N' THEN l_quantity WHEN l_returnflag = 'R' THEN l_linenumber END::INT AS value, l_returnflag = 'A' AS missing FROM lineitem")
def verbalised_confidence(t: Tables) -> DataFrame:
    """The first answer has a number where the flag is N, the second where it is R."""
    first = F.when(F.col("l_returnflag") == "N", F.concat(F.lit("I am "), _int("l_quantity"), F.lit("% sure"))).otherwise("Hard to say, 1999 maybe")
    second = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("About "), F.col("l_linenumber").cast("string"))).otherwise("No")
    return t.lineitem.select(*_KEY, outputs.verbalised(first, second).alias("v")).select(*_KEY, "v.value", "v.missing")


@query("""SELECT o_orderkey, '{"claims":[{"id":' || o_custkey || ',"text":"t","source_ids":[0]},{"id":' || (o_custkey + 1) || ',"text":"stale","source_ids":[0]}],"conclusion":"c stale"}' AS json FROM orders""")
def contaminated_outputs(t: Tables) -> DataFrame:
    raw = F.concat(F.lit('{"claims": [{"id": '), F.col("o_custkey").cast("string"), F.lit(', "text": "t", "source_ids": [0]}], "conclusion": "c"}'))
    return t.orders.select("o_orderkey", outputs.serialise(outputs.contaminate(outputs.parse(raw)["output"], F.lit("stale"))).alias("json"))


@query(f"""
SELECT {_SQL_KEY}, CASE l_linenumber % 3 WHEN 0 THEN l_returnflag <> 'R' AND abs(l_quantity - l_suppkey % 50) <= 2 WHEN 1 THEN l_returnflag <> 'R' AND l_returnflag = 'N' ELSE l_suppkey % 2 = 0 END AS correct,
  CASE WHEN l_linenumber % 3 = 2 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'token-run-match' WHEN l_returnflag = 'R' THEN 'truncated-excluded' ELSE 'no-token-match' END
       WHEN l_returnflag = 'R' THEN 'truncated-excluded' WHEN l_linenumber % 3 = 0 THEN 'numeric[after-marker]tol=2.0' WHEN l_returnflag = 'N' THEN 'conclusion-letter-match' ELSE 'conclusion-letter-mismatch' END AS note
FROM lineitem
""")
def scored_answers(t: Tables) -> DataFrame:
    """Answers of three families by line number; those flagged R were cut off."""
    kind = F.col("l_linenumber") % 3
    family = F.when(kind == 0, "arithmetic").when(kind == 1, "deduction").otherwise("factual")
    gold = F.when(kind == 0, _int("l_quantity")).when(kind == 1, "N").otherwise("Lake Van")
    word = F.when(F.col("l_suppkey") % 2 == 0, "It lies at the Van lake, or Lake Van").otherwise("It lies at Lake Tuz")
    answer = F.when(kind == 0, F.concat(F.lit("Of 99 things, the answer is "), (F.col("l_suppkey") % 50).cast("string"))).when(kind == 1, F.concat(F.lit("X and Y, therefore "), F.col("l_returnflag"))).otherwise(word)
    lines = spread(t.lineitem.select(*_KEY, "l_quantity", "l_returnflag"), *_KEY)
    said = scorer.score(lines, "s", family, gold, answer, F.array().cast("array<string>"), F.lit(2.0), F.col("l_returnflag") != "R")
    return said.select(*_KEY, "s.correct", "s.note")


@query(f"SELECT {_SQL_KEY}, CASE WHEN l_linenumber > 1 THEN l_quantity END::DOUBLE AS value, CASE WHEN l_linenumber > 1 THEN 150 END::DOUBLE AS threshold FROM lineitem")
def stale_values(t: Tables) -> DataFrame:
    """First lines name a label only."""
    said = F.when(F.col("l_linenumber") > 1, F.concat(F.lit("Cabin 7's load is $"), _int("l_quantity"), F.lit(", below 150."))).otherwise("The load exceeds Silo 4's capacity.")
    return t.lineitem.select(*_KEY, echo.stale_value(said).alias("s")).select(*_KEY, "s.value", "s.threshold")


@query("SELECT p_partkey, list_aggregate(list_filter(string_split(lower(p_name), ' '), lambda w: len(w) >= 4)[1:4], 'string_agg', ' ') AS topic FROM part")
def statement_topics(t: Tables) -> DataFrame:
    topic = echo.topic(F.concat(F.lit("The "), F.col("p_name"), F.lit(" exceeds the limit of many others")))
    return t.part.select("p_partkey", F.when(F.size(topic) > 0, F.array_join(topic, " ")).alias("topic"))


@query("""
SELECT f.f AS family, k.k AS k, 5 + (((f.f * 4 + k.k + 11) * 1103515245::BIGINT + 12345) % 2147483648 // 65536) % 16 AS value FROM (SELECT s_suppkey AS f FROM supplier) f, range(4) k(k)
""")
def generated_draws(t: Tables) -> DataFrame:
    return puzzles.draws(t.supplier, "s_suppkey", 4, 11, 5, 20)


@query("""
WITH d AS (SELECT f.f AS family, k.k AS k, -20 + (((f.f * 3 + k.k + 7) * 1103515245::BIGINT + 12345) % 2147483648 // 65536) % 81 AS v FROM (SELECT c_custkey AS f FROM customer) f, range(3) k(k)),
p AS (SELECT family, max(v) FILTER (k = 0) + 100 AS base, max(v) FILTER (k = 1) AS c1, max(v) FILTER (k = 2) AS c2 FROM d GROUP BY 1)
SELECT family, base, base + c1 + c2 AS final, CASE WHEN c1 = 0 OR c2 = 0 THEN 'no change' WHEN least(base, base + c1, base + c1 + c2) < 0 THEN 'negative' WHEN c1 + c2 = 0 THEN 'repeated total' END AS reason FROM p
""")
def generated_families(t: Tables) -> DataFrame:
    """Quantities with two corrections each, one for each customer, and why some are to be left out."""
    return puzzles.families(t.customer, "c_custkey", 7, 2).select("family", "base", F.element_at("totals", -1).alias("final"), "reason")
