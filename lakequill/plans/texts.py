"""Text and record queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.functions import records as R
from lakequill.functions import text as X
from lakequill.operators import similarity as J
from lakequill.plans.catalog import Tables, query, rounded

_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
_TOKENS = "list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"
_NUMS = r"list_filter(list_transform(regexp_extract_all({x}, '-?\d[\d,]*(?:\.\d+)?'), lambda y: try_cast(replace(y, ',', '') AS DOUBLE)), lambda y: y IS NOT NULL)"


@query("SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS norm FROM documents")
def normalised_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.norm_exact(F.col("text"))).alias("norm"))


@query(f"SELECT doc_id, len({_TOKENS.format(x='text')})::INT AS n_tokens, len(list_filter({_TOKENS.format(x='text')}, lambda w: NOT list_contains({_STOP}, w)))::INT AS n_content FROM documents")
def token_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(X.tokens(F.col("text"))).alias("n_tokens"), F.size(X.content_tokens(F.col("text"))).alias("n_content"))


@query(f"""
WITH a AS (SELECT doc_id, {_TOKENS.format(x='text')} AS ta, len(ta) AS na FROM documents), b AS (SELECT item_id, {_TOKENS.format(x='text')} AS tb, len(tb) AS nb FROM benchmark),
s AS (SELECT doc_id, item_id, na, nb, count(*) AS c FROM (SELECT doc_id, na, unnest(ta) AS w FROM a) JOIN (SELECT item_id, nb, unnest(tb) AS w FROM b) USING (w) GROUP BY 1, 2, 3, 4)
SELECT doc_id, item_id, round(c / (na + nb - c), 6) AS jaccard FROM s WHERE c / (na + nb - c) >= 0.4
""")
def jaccard_join(t: Tables) -> DataFrame:
    texts = lambda df, key: df.select(key, X.tokens(F.col("text")).alias("tokens"))
    return rounded(J.jaccard_pairs(texts(t.documents, "doc_id"), texts(t.benchmark, "item_id"), "doc_id", "item_id", 0.4), "jaccard")


@query(f"""
WITH a AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS n, {_TOKENS.format(x='text')} AS ta, list_filter(ta, lambda w: NOT list_contains({_STOP}, w)) AS ca FROM documents),
b AS (SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS n, {_TOKENS.format(x='text')} AS tb, list_filter(tb, lambda w: NOT list_contains({_STOP}, w)) AS cb FROM benchmark),
p AS (SELECT doc_id, item_id, a.n = b.n AND a.n <> '' AS same, len(list_intersect(ta, tb)) AS c, len(ta) + len(tb) AS s, len(list_intersect(ca, cb)) AS cc, len(ca) + len(cb) AS cs FROM a, b)
SELECT doc_id, item_id, CASE WHEN same THEN 'exact' ELSE 'open' END AS rule, round(CASE WHEN same THEN 1 ELSE c / (s - c) END, 6) AS jaccard, round(CASE WHEN same THEN 1 ELSE cc / (cs - cc) END, 6) AS content_jaccard
FROM p WHERE same OR (c > 0 AND c / (s - c) >= 0.45 AND cc / nullif(cs - cc, 0) >= 0.3)
""")
def contamination_audit(t: Tables) -> DataFrame:
    return rounded(J.audit(t.documents, t.benchmark, open_j=0.45, open_content=0.3), "jaccard", "content_jaccard")


@query(f"""
WITH a AS (SELECT doc_id, {_TOKENS.format(x='text')} AS ta, len(ta) AS na FROM documents), b AS (SELECT item_id, {_TOKENS.format(x='text')} AS tb, len(tb) AS nb FROM benchmark),
s AS (SELECT doc_id, item_id, na, nb, count(*) AS c FROM (SELECT doc_id, na, unnest(ta) AS w FROM a) JOIN (SELECT item_id, nb, unnest(tb) AS w FROM b) USING (w) GROUP BY 1, 2, 3, 4)
SELECT doc_id, item_id, round(c / (na + nb - c), 6) AS jaccard FROM s ORDER BY c / (na + nb - c) DESC, doc_id, item_id LIMIT 1
""")
def most_similar_pair(t: Tables) -> DataFrame:
    texts = lambda df, key: df.select(key, X.tokens(F.col("text")).alias("tokens"))
    return rounded(J.best_pair(texts(t.documents, "doc_id"), texts(t.benchmark, "item_id"), "doc_id", "item_id"), "jaccard")


@query(f"SELECT doc_id, len({_NUMS.format(x='text')})::INT AS n, list_max({_NUMS.format(x='text')}) AS most, ({_NUMS.format(x='text')})[1] AS first, ({_NUMS.format(x='text')})[-1] AS last FROM documents WHERE len({_NUMS.format(x='text')}) > 0")
def number_extraction(t: Tables) -> DataFrame:
    ns = t.documents.select("doc_id", X.numbers(F.col("text")).alias("ns")).where(F.size("ns") > 0)
    out = ns.select("doc_id", F.size("ns").alias("n"), F.array_max("ns").alias("most"), F.element_at("ns", 1).alias("first"), F.element_at("ns", -1).alias("last"))
    return out


@query(r"SELECT doc_id, (list_filter(list_transform(regexp_extract_all(text, '\d+'), lambda x: try_cast(x AS INTEGER)), lambda x: x BETWEEN 0 AND 100))[-1] AS confidence FROM documents")
def bounded_confidence(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.bounded_int(F.col("text")).alias("confidence"))


@query(r"SELECT event_id, CASE WHEN len(regexp_extract_all(props, '-?\d[\d,]*(?:\.\d+)?')) = 1 THEN regexp_extract(props, '-?\d[\d,]*(?:\.\d+)?')::DECIMAL(38, 10)::DOUBLE END AS value FROM events")
def canonical_scalar(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.canonical_decimal(F.col("props")).cast("double").alias("value"))


@query("SELECT p_partkey, list_aggregate(list_filter(regexp_extract_all(lower('The ' || p_name), '[a-z0-9]+'), lambda w: w NOT IN ('a', 'an', 'the')), 'string_agg', ' ') || ' 12 2 20 0' AS raw FROM part")
def article_strip(t: Tables) -> DataFrame:
    """Number words become digits and articles go."""
    words = X.digitize(F.concat(F.lit("The "), F.col("p_name"), F.lit(" twelve a two twenty an zero")))
    return t.part.select("p_partkey", F.array_join(words, " ").alias("raw"))


@query("SELECT p_partkey, contains(' ' || p_name || ' ', ' ring ') AS ring, contains(' ' || p_name || ' ', ' small bolt ') AS small_bolt FROM part")
def token_run_match(t: Tables) -> DataFrame:
    words = F.split("p_name", " ")
    return t.part.select("p_partkey", X.contains_run(words, F.array(F.lit("ring"))).alias("ring"), X.contains_run(words, F.array(F.lit("small"), F.lit("bolt"))).alias("small_bolt"))


@query("SELECT conv_id, turn, contains(lower(text), 'i cannot') OR contains(lower(text), 'i can''t') OR contains(lower(text), 'unable to') OR contains(lower(text), 'not possible to determine') AS narrow FROM conversations")
def keyword_refusal(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.refusal(F.col("text")).alias("narrow"))


@query(f"""
WITH b AS (SELECT item_id, {_TOKENS.format(x='text')} AS tb, {_NUMS.format(x='text')} AS nb FROM benchmark), d AS (SELECT doc_id, {_TOKENS.format(x='text')} AS td, {_NUMS.format(x='text')} AS nd FROM documents)
SELECT doc_id, item_id, list_has_any(nb, nd) OR len(list_intersect(list_filter(tb, lambda w: NOT list_contains({_STOP}, w)), list_filter(td, lambda w: NOT list_contains({_STOP}, w)))) >= 2 AS present
FROM d JOIN b ON doc_id % (SELECT max(item_id) + 1 FROM benchmark) = item_id
""")
def presence_proxy(t: Tables) -> DataFrame:
    """Each document against the benchmark item it is dealt to, as a fixture of item and output pairs."""
    d = t.documents.select("doc_id", F.col("text").alias("t")).crossJoin(F.broadcast(t.benchmark.agg((F.max("item_id") + 1).alias("_n"))))
    pairs = d.join(t.benchmark, F.col("doc_id") % F.col("_n") == F.col("item_id"))
    return pairs.select("doc_id", "item_id", X.presence_proxy(F.col("text"), F.col("t")).alias("present"))


@query("""
SELECT conv_id, string_agg('[' || i::VARCHAR || '] ' || text, chr(10) ORDER BY i) AS prompt, count(*)::INT AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS i FROM conversations) GROUP BY 1
""")
def numbered_prompt(t: Tables) -> DataFrame:
    sources = t.conversations.groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").alias("id"), "text")).alias("s"))
    return sources.select("conv_id", R.numbered(R.ordered_texts(F.col("s"))).alias("prompt"), F.size("s").alias("n"))


@query("""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS i FROM conversations)
SELECT conv_id, md5(string_agg(CASE WHEN i = 1 THEN 'not A' ELSE text END, '|' ORDER BY i) || '|evidence') AS h FROM c GROUP BY 1
""")
def state_substitution(t: Tables) -> DataFrame:
    sources = t.conversations.groupBy("conv_id").agg(R.ordered_texts(F.collect_list(F.struct(F.col("turn").alias("id"), "text"))).alias("s"))
    changed = R.with_evidence(R.substitute(F.col("s"), F.lit(1), F.lit("not A")), F.lit("evidence"))
    return sources.select("conv_id", F.md5(F.array_join(changed, "|")).alias("h"))


@query("SELECT e.event_id, e.user_id % 4 AS n, t.t::INT AS turn, (1 + t.t)::INT AS n_documents FROM events e, range(4) t(t) WHERE t.t <= e.user_id % 4")
def turn_plan(t: Tables) -> DataFrame:
    """k corrections give k + 1 turns, each with the sources and the corrections so far."""
    n = (F.col("user_id") % 4).cast("int")
    corrections = F.transform(F.slice(F.array(*map(F.lit, "abc")), 1, n), lambda x: x)
    rows = t.events.select("event_id", (F.col("user_id") % 4).alias("n"), F.posexplode(R.turns(F.array(F.lit("s")), corrections)).alias("turn", "docs"))
    return rows.select("event_id", "n", "turn", F.size("docs").alias("n_documents"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_discount * 10, 9) >= 0.7 AND round_even(l_tax * 10 - l_discount * 10, 9) < 0.3 AS contaminated FROM lineitem")
def contamination_predicate(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R.contaminated(F.col("l_discount") * 10, F.col("l_tax") * 10).alias("contaminated"))


@query("""
SELECT l_orderkey, count(*) FILTER (keep) AS kept, count(*) AS claims, CASE WHEN count(*) FILTER (keep) = 0 THEN 'No conclusion.' ELSE string_agg(CASE WHEN keep THEN 'part ' || l_partkey::VARCHAR END, '; ' ORDER BY l_linenumber, l_partkey) || '.' END AS conclusion
FROM (SELECT *, NOT (l_suppkey % 3 = 0 OR l_discount >= 0.07) AS keep FROM lineitem) GROUP BY 1
""")
def contracted_conclusion(t: Tables) -> DataFrame:
    """Claims (lines of an order) without decorative or contaminated ones, and the conclusion they leave."""
    sources = F.when(F.col("l_suppkey") % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array("l_suppkey"))
    claim = F.struct(F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("k"), F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(".")).alias("text"), R.flagged(sources, F.col("l_discount") >= 0.07).alias("flagged"))
    orders = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(claim)).alias("claims"))
    left = orders.select("l_orderkey", R.contract(F.col("claims")).alias("left"), F.size("claims").cast("long").alias("claims"))
    return left.select("l_orderkey", F.size("left").cast("long").alias("kept"), "claims", X.conclusion(F.transform("left", lambda c: c["text"])).alias("conclusion"))


@query("""
WITH s AS (SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) ELSE 0 END)::BIGINT AS a,
  sum(CASE WHEN role <> 'assistant' THEN len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) ELSE 0 END)::BIGINT AS d FROM conversations GROUP BY 1)
SELECT conv_id, a, d, CASE WHEN d > 0 THEN a / d BETWEEN 0.5 AND 2.0 ELSE false END AS in_band FROM s
""".replace("\\\\", "\\"))
def compression_band(t: Tables) -> DataFrame:
    n = X.words_count(F.col("text"))
    rows = t.conversations.groupBy("conv_id").agg(F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).alias("a"), F.sum(F.when(F.col("role") != "assistant", n).otherwise(0)).alias("d"))
    return rows.withColumn("in_band", R.in_band(F.col("a"), F.col("d"), 0.5, 2.0))


@query("SELECT event_id, round(value + user_id, 6) AS a, round((value + user_id) * value, 6) AS b, round((value + user_id) * value - user_id, 6) AS c FROM events")
def derivation_values(t: Tables) -> DataFrame:
    op = lambda o, a, b: F.struct(F.lit(o).alias("op"), F.lit(a).alias("left"), F.lit(b).alias("right"))
    v = R.evaluate(F.array("value", F.col("user_id").cast("double")), F.array(op("+", 0, 1), op("*", 2, 0), op("-", 3, 1)))
    out = t.events.select("event_id", v.alias("v")).select("event_id", F.col("v")[2].alias("a"), F.col("v")[3].alias("b"), F.col("v")[4].alias("c"))
    return rounded(out, "a", "b", "c")


@query("SELECT sum(floor(length(text) / 3.5))::BIGINT AS tokens, count(*) AS n, lang FROM documents GROUP BY lang")
def cost_estimate(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.sum(R.cost_tokens(F.col("text"))).alias("tokens"), F.count("*").alias("n"))


@query("SELECT page_id, contains(lower(html), 'footer') AS has_footer, contains(lower(html), 'iframe') AS has_iframe FROM pages WHERE contains(lower(html), 'footer') OR contains(lower(html), 'iframe')")
def keyword_leak_guard(t: Tables) -> DataFrame:
    found = t.pages.select("page_id", R.leaks_token(F.col("html"), ["footer", "iframe"]).alias("f")).where(F.size("f") > 0)
    return found.select("page_id", F.array_contains("f", "footer").alias("has_footer"), F.array_contains("f", "iframe").alias("has_iframe"))


@query("SELECT conv_id, sha256('{\"n\":' || count(*)::VARCHAR || ',\"turns\":' || max(turn)::VARCHAR || '}') AS h FROM conversations GROUP BY 1")
def canonical_row_hash(t: Tables) -> DataFrame:
    from lakequill.sources.writers import row_hash

    return t.conversations.groupBy("conv_id").agg(F.max("turn").alias("turns"), F.count("*").alias("n")).select("conv_id", row_hash("turns", "n").alias("h"))
