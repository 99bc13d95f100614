"""Logs by the place of their lines, side-car vectors, folding and spellings, over rows made from the given tables."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.functions import echo
from lakequill.functions import records as R
from lakequill.functions import text as X
from lakequill.operators import latest as L
from lakequill.plans.catalog import Tables, query, rounded
from lakequill.sources import readers, side_cars

_SHARDS = 16


def _shards(t: Tables, name: str) -> str:
    """events as a log in files by shard, in order of event_id; lines carry no number. Line 20 of each even shard is broken at its first byte."""
    path = t.scratch(name)
    shard = F.format_string("%02d", F.col("event_id") % _SHARDS)
    whole = F.to_json(F.struct("user_id", "event_type", "value"))
    torn = (F.col("event_id") % 2 == 0) & (F.floor(F.col("event_id") / _SHARDS) == 20)
    rows = t.events.select(shard.alias("shard"), "event_id", F.when(torn, F.substring(whole, 2, 12)).otherwise(whole).alias("value"))
    rows.repartition(_SHARDS, "shard").sortWithinPartitions("shard", "event_id").drop("event_id").write.partitionBy("shard").text(path)
    return path


_BEFORE = "SELECT *, event_id % 16 AS shard FROM events WHERE event_id % 2 = 1 OR event_id // 16 < 20"


@query(f"SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY shard DESC, event_id DESC) AS k FROM ({_BEFORE})) WHERE k = 1")
def last_row_by_position(t: Tables) -> DataFrame:
    """Up to the broken line of a file its rows count, and the last one of a key wins by file and place."""
    rows = readers.read_log_until_torn(t.spark, _shards(t, "by-place"), "user_id long, event_type string, value double")
    return L.last_wins(rows.withColumn("_place", F.struct("_file", "_at")), ["user_id", "event_type"], "_place").select("user_id", "event_type", "value")


@query("SELECT event_id % 16 AS shard, event_id // 16 - min(event_id // 16) OVER (PARTITION BY event_id % 16) AS line, user_id FROM events WHERE event_id % 2 = 1 OR event_id // 16 <> 20")
def numbered_lines(t: Tables) -> DataFrame:
    """Each line's number in its file, broken lines counted and left out."""
    lines = readers.number_lines(readers.read_positions(t.spark, _shards(t, "numbered")))
    shard = F.regexp_extract("_file", r"shard=(\d+)", 1).cast("long")
    return lines.select(shard.alias("shard"), F.col("_line").alias("line"), F.get_json_object("value", "$.user_id").cast("long").alias("user_id")).where("user_id IS NOT NULL")


@query("""
WITH v AS (SELECT vec_id, vec_id // 64 AS g, embedding FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 6) AS length2, NULL AS file, NULL AS reason FROM v WHERE g NOT IN (1, 2)
UNION ALL SELECT NULL, NULL, format('{:012d}.npz', g), CASE g WHEN 1 THEN 'BadZipFile' ELSE 'ValueError' END FROM (SELECT DISTINCT g FROM v WHERE g IN (1, 2))
""")
def side_car_vectors(t: Tables) -> DataFrame:
    """Vectors as archives of 64 each, one of which is cut short and one of another width; both are reported."""
    path = t.scratch("side-cars")
    cut = F.when(F.floor(F.col("vec_id") / 64) == 2, F.slice("embedding", 1, 60)).otherwise(F.col("embedding")).cast("array<double>")
    side_cars.write_side_cars(t.embeddings.select("vec_id", cut.alias("vector")), path, "vec_id", ["vector"]).write.format("noop").mode("overwrite").save()
    system, root = fs.FileSystem.from_uri(path)
    with system.open_input_file(f"{root}/{1:012d}.npz") as f:  # one archive of 64 vectors
        half = f.read_at(f.size() // 2, 0)
    with system.open_output_stream(f"{root}/{1:012d}.npz", compression=None) as f:
        f.write(half)
    rows = side_cars.read_side_cars(t.spark, path, "vec_id", vector=(64,))
    squares = F.aggregate(F.transform("vector", lambda x: x * x), F.lit(0.0), lambda a, x: a + x)
    bad = F.col("reason").isNotNull()
    return rounded(rows.select("vec_id", squares.alias("length2"), F.when(bad, F.col("file")).alias("file"), F.substring_index("reason", ":", 1).alias("reason")), "length2")


@query("SELECT p_partkey, replace(replace(replace(strip_accents(lower(x)), 'đ', 'd'), 'ı', 'i'), 'ł', 'l') || '|' || strip_accents(lower(y)) || '|1⁄2 fi' AS folded FROM (SELECT p_partkey, p_name || ' đıł' AS x, p_name || chr((7680 + p_partkey % 150)::INT) || chr((7840 + p_partkey % 90)::INT) AS y FROM part)")
def folded_code_points(t: Tables) -> DataFrame:
    """Latin letters with marks, a code point or two for each part, against the other engine's own table."""
    point = lambda low, n: F.decode(F.unhex(F.concat(F.hex(F.shiftright(F.lit(low) + F.col("p_partkey") % n, 8).cast("int")), F.lpad(F.hex((F.lit(low) + F.col("p_partkey") % n) % 256), 2, "0"))), "UTF-16BE")
    return t.part.select("p_partkey", X.fold(F.concat("p_name", F.lit(" đıł|"), "p_name", point(7680, 150), point(7840, 90), F.lit("|½ ﬁ"))).alias("folded"))


@query("SELECT o_orderkey, regexp_replace(lower(o_orderpriority || '; Nº ' || o_orderstatus), '[^a-z0-9]', '', 'g') AS gold FROM orders")
def gold_keys(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", X.gold_key(F.concat("o_orderpriority", F.lit("; Nº "), "o_orderstatus")).alias("gold"))


@query("""
WITH f AS (SELECT o_orderkey, (o_orderkey % 2000 + 1)::DOUBLE + (o_orderkey % 4) / 4 AS v FROM orders),
g AS (SELECT o_orderkey, CASE WHEN v = floor(v) THEN [v::BIGINT::VARCHAR, format('{:,}', v::BIGINT)]
  ELSE list_concat([rtrim(printf('%.4f', v), '0'), printf('%.2f', v), format('{:,.2f}', v)], CASE WHEN round(v, 1) = v THEN [printf('%.1f', v)] ELSE [] END) END AS s FROM f)
SELECT o_orderkey, list_aggregate(list_sort(list_distinct(list_concat(s, list_transform(s, lambda x: '$' || x)))), 'string_agg', '|') AS forms FROM g
""")
def rewrite_spellings(t: Tables) -> DataFrame:
    v = F.col("o_orderkey") % 2000 + 1 + (F.col("o_orderkey") % 4) / 4
    return t.orders.select("o_orderkey", F.array_join(F.array_sort(X.spellings(v)), "|").alias("forms"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber % 4 <> 3 AND (l_linenumber % 4 <> 2) AND l_returnflag <> 'N' AS stale_only FROM lineitem
""")
def stale_only_retracted(t: Tables) -> DataFrame:
    """The old price stands in premises under one of three spellings; with N no marker goes with it, in line 2 of four a live premise has it too, in line 3 none has it."""
    n, price = F.col("l_linenumber") % 4, F.floor("l_extendedprice") + 100000
    said = F.when(n == 0, F.format_number(price, 0)).when(n == 1, F.concat(F.lit("$"), price.cast("string"))).otherwise(price.cast("string"))
    marker = F.when(F.col("l_returnflag") == "N", "The price is ").when(F.col("l_returnflag") == "A", "Replaced; it WAS ").otherwise("No longer ")
    first = F.when(n == 3, "Nothing was said").otherwise(F.concat(marker, said))
    second = F.when(n == 2, F.concat(F.lit("Pay $"), F.format_number(price, 0))).otherwise("Other things were corrected")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.stale_only_in_retraction(F.array(first, second), price, echo.SUPERSESSION).alias("stale_only"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(l_discount, l_tax, 0.04::DOUBLE) - CASE l_linenumber % 3 WHEN 0 THEN greatest(l_tax, 0.04::DOUBLE) WHEN 1 THEN 0.04::DOUBLE ELSE l_tax END, 6) AS contrast FROM lineitem
""")
def leave_set_out_contrast(t: Tables) -> DataFrame:
    """What the first source gives, alone or together with another."""
    scores = F.array("l_discount", "l_tax", F.lit(0.04))
    dropped = F.array(F.lit(0), (F.col("l_linenumber") % 3).cast("int"))
    return rounded(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R.leave_set_out(scores, dropped).alias("contrast")), "contrast")


@query("""
SELECT conv_id, turn, role, regexp_matches(coalesce(lower(text), ''), 'cannot compute|not provided|no meter|no values|cannot calculate|not specified|declarations page|unable to') AS few,
  regexp_matches(coalesce(lower(text), ''), 'cannot compute|not provided|no meter|no values|cannot calculate|not specified|declarations page|unable to|missing|not given|need the|were provided|without the|don''t have|do not have|please provide|isn''t sufficient|is not sufficient|provide the|provide those') AS many
FROM (SELECT conv_id, turn, role, CASE turn % 5 WHEN 0 THEN text WHEN 1 THEN 'I do NOT have it' WHEN 2 THEN 'Values were not Provided' WHEN 3 THEN NULL ELSE text || ' need the sum' END AS text FROM conversations)
""")
def refusal_predictors(t: Tables) -> DataFrame:
    """Both keyword lists, as predictors that a label checks."""
    k = F.col("turn") % 5
    said = F.when(k == 0, F.col("text")).when(k == 1, "I do NOT have it").when(k == 2, "Values were not Provided").when(k == 4, F.concat("text", F.lit(" need the sum")))
    return t.conversations.select("conv_id", "turn", "role", X.declines(said).alias("few"), X.declines(said, True).alias("many"))
