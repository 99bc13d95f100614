"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders, so that a question with other numbers and names still has the template
of the one it was made from. Benchmark items are cut into windows of five template words; the documents' windows are hash-
joined with them. Pairs come from an item's rarest windows, of which a document with `coverage` of all has to hold one, so
that windows which many items share (rows of numbers) make no pairs. Where a document holds `coverage` of an item's distinct windows, the values that fill the placeholders are
aligned: on each alignment (a constant distance of word positions) one value of the item has to stand for one value of the
document and the other way round. A pair leaks if its slots agree over all alignments, if alignments that agree each for
itself leave `coverage` of the windows, or if the document holds `coverage` of the windows with equal values. Others, whose
slots contradict each other on every alignment that would cover the item, aren't leaks.

Defined results: items with a null or empty text or with fewer than five template words have no windows and match nothing,
as do such documents; rows that repeat a doc_id or item_id count together; a document without doc_id can't be named and
isn't judged; empty tables give no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lakequill.llm.common import Store, table

WINDOW, COVERAGE, CONSISTENT = 5, 0.8, 0.8
#: Rows of benchmark windows (16 bytes each), and bytes of their slots, that may be broadcast; beyond that both sides are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20
UNITS = (
    "km|cm|mm|nm|m|kg|mg|g|lb|lbs|oz|ml|l|s|ms|sec|secs|second|seconds|min|mins|minute|minutes|h|hr|hrs|hour|hours|day|days|week|weeks|month|months|"
    "year|years|meter|meters|metre|metres|mile|miles|inch|inches|foot|feet|yard|yards|gram|grams|kilogram|kilograms|pound|pounds|liter|liters|litre|litres|"
    "dollar|dollars|euro|euros|cent|cents|percent|degree|degrees|volt|volts|watt|watts|joule|joules|newton|newtons|hz|khz|mhz|ghz|kb|mb|gb|tb|mph|kmh|usd|eur"
)
_NAME = r"(?<=[^.!?\s]\s)(\p{Lu}[\p{L}'’-]*)"
_UNIT = rf"(?<=>\s?)(%|°c|°f|°|€|\$|£|(?:{UNITS})(?![\p{{L}}\p{{N}}]))"
_NUMBER = r"(?<![\p{L}\p{N}<])(\d+(?:[.,:/]\d+)*)"
_TOKEN = r"<(?:num|name|unit)(?::[^>]*)?>|[\p{L}\p{N}]+"


def template_tokens(text: Column, names: bool = True, values: bool = False) -> Column:
    """Lower-case words with placeholders <num>, <name> (if asked for), <unit>; with `values` they are <num:12> and so on."""
    mark = lambda kind: f"<{kind}:$1>" if values else f"<{kind}>"
    out = F.coalesce(text, F.lit(""))
    out = F.lower(F.regexp_replace(out, F.lit(_NAME), F.lit(mark("name"))) if names else out)
    out = F.regexp_replace(F.regexp_replace(out, F.lit(_NUMBER), F.lit(mark("num"))), F.lit(_UNIT), F.lit(mark("unit")))
    return F.regexp_extract_all(out, F.lit(_TOKEN), F.lit(0))


def _hashed(df: DataFrame, key: str, window: int) -> DataFrame:
    """(key, names, h): the windows of both forms, with placeholders for names and with the names themselves; one form without names.

    The second form finds passages in texts that are capitalised throughout, or whose first word now stands inside a sentence.
    """
    form = lambda names: F.struct(F.lit(names).alias("names"), template_tokens(F.col("text"), names).alias("t"))
    forms = F.when(F.col("text").rlike(_NAME), F.array(form(True), form(False))).otherwise(F.array(form(False)))
    forms = df.select(key, F.explode(forms).alias("f")).select(key, "f.names", "f.t").where(F.size("t") >= window)
    hashes = F.transform(F.sequence(F.lit(1), F.size("t") - window + 1), lambda i: F.xxhash64(F.slice("t", i, window), F.col("names")))
    return forms.select(key, "names", F.explode(hashes).alias("h"))


def _verbatim(df: DataFrame, key: str, window: int) -> DataFrame:
    """(key, h): the windows of words with their names, numbers and units as they are."""
    held = df.select(key, template_tokens(F.col("text"), names=False, values=True).alias("t")).where(F.size("t") >= window)
    hashes = F.transform(F.sequence(F.lit(1), F.size("t") - window + 1), lambda i: F.xxhash64(F.slice("t", i, window)))
    return held.select(key, F.explode(hashes).alias("h")).distinct()


def _slot_windows(df: DataFrame, key: str, window: int) -> DataFrame:
    """(key, h, pos, slots) of the windows that hold a placeholder; slots: (position in the window, kind, value)."""
    held = df.select(key, template_tokens(F.col("text"), values=True).alias("raw"))
    bare = F.transform("raw", lambda t: F.when(t.startswith("<"), F.concat(F.substring_index(t, ":", 1), F.lit(">"))).otherwise(t))
    held = held.select(key, "raw", bare.alias("tokens")).where(F.size("tokens") >= window)
    held = held.select(key, "raw", "tokens", F.explode(F.sequence(F.lit(1), F.size("tokens") - window + 1)).alias("pos"))
    part = F.slice("raw", F.col("pos"), window)
    slots = F.filter(F.transform(part, lambda t, i: F.struct(i.alias("at"), F.substring_index(t, ":", 1).alias("kind"), t.alias("value"))), lambda s: s["value"].startswith("<"))
    return held.select(key, F.xxhash64(F.slice("tokens", F.col("pos"), window), F.lit(True)).alias("h"), "pos", slots.alias("slots")).where(F.size("slots") > 0)


def leaks(docs: DataFrame, benchmark: DataFrame, store: Store, window: int = WINDOW, coverage: float = COVERAGE, consistent: float = CONSISTENT) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, coverage, n_slots, n_consistent) of the documents that hold an item."""
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    benchmark = benchmark.where("item_id IS NOT NULL").select("item_id", "text")
    items = store.save(_hashed(benchmark, "item_id", window).distinct().coalesce(8), "items")
    sized = F.broadcast if items.count() <= BROADCAST_ROWS else lambda df: df
    sizes = items.groupBy("item_id", "names").agg(F.count("*").alias("n_windows"))
    # the windows of which a document with `coverage` of the item holds one at least, those in the fewest items
    spread = items.join(items.groupBy("h").agg(F.count("*").alias("n_items")), "h").join(sizes, ["item_id", "names"])
    rank = F.row_number().over(W.partitionBy("item_id", "names").orderBy("n_items", "h"))
    rare = spread.withColumn("rank", rank).where(F.col("rank") <= F.col("n_windows") - F.ceil(F.lit(coverage) * F.col("n_windows") - 1e-9) + 1)
    rare = store.save(rare.select("h", "item_id", "names"), "rare")
    hits = store.save(_hashed(docs, "doc_id", window).select("doc_id", "h").join(sized(items.select("h").distinct()), "h", "left_semi").distinct(), "hits")
    asked = hits.join(sized(rare), "h").select("doc_id", "item_id", "names").distinct()
    forms = asked.join(sized(items), ["item_id", "names"]).join(hits, ["doc_id", "h"])
    forms = forms.groupBy("doc_id", "item_id", "names").agg(F.count("*").alias("n_matched")).join(sized(sizes), ["item_id", "names"])
    best = F.max(F.struct((F.col("n_matched") / F.col("n_windows")).alias("coverage"), "n_matched", "n_windows")).alias("best")
    pairs = forms.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*").where(F.col("coverage") >= coverage)
    pairs = store.save(pairs, "pairs")
    slot_items = store.save(_slot_windows(benchmark, "item_id", window).select("item_id", "h", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots")), "slot-items")
    slot_bytes = slot_items.agg(F.coalesce(F.sum(F.length(F.to_json("item_slots")) + 24), F.lit(0))).first()[0]
    slot_sized = F.broadcast if slot_bytes <= BROADCAST_BYTES else lambda df: df
    # written, as the filters on tokens would else be pushed below the join and tokenise every document again
    held = store.save(docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi"), "held")
    both = _slot_windows(held, "doc_id", window).join(slot_sized(slot_items), "h").join(pairs.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_semi")
    both = both.select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"), "h", F.explode(F.arrays_zip("item_slots", "slots")).alias("s"))
    slot = F.struct(F.col("s.slots.kind").alias("kind"), F.col("s.item_slots.value").alias("mine"), F.col("s.slots.value").alias("theirs"))
    aligned = both.groupBy("doc_id", "item_id", "shift").agg(F.collect_set(slot).alias("pairs"), F.collect_set("h").alias("hs"))  # no more than an item has slots and windows
    clash = lambda p, q: (q["kind"] == p["kind"]) & ((q["mine"] == p["mine"]) != (q["theirs"] == p["theirs"]))
    good = F.filter("pairs", lambda p: ~F.exists("pairs", lambda q: clash(p, q)))
    aligned = aligned.select("doc_id", "item_id", "hs", F.size("pairs").alias("n"), F.size(good).alias("good")).withColumn("agrees", F.col("good") >= F.lit(consistent) * F.col("n"))
    aligned = store.save(aligned, "aligned")
    agreed = lambda c: F.sum(F.when(F.col("agrees"), F.col(c)).otherwise(0))
    slots = aligned.groupBy("doc_id", "item_id").agg(F.sum("n").alias("n_all"), F.sum("good").alias("good_all"), agreed("n").alias("n_agreed"), agreed("good").alias("good_agreed"))
    windows = aligned.select("doc_id", "item_id", "agrees", F.explode("hs").alias("h")).groupBy("doc_id", "item_id", "h").agg(F.max("agrees").alias("agrees"))
    lost = windows.groupBy("doc_id", "item_id").agg(F.count_if(~F.col("agrees")).alias("lost"))  # windows that only contradicting alignments hold
    plain_items = store.save(_verbatim(benchmark, "item_id", window), "plain-items")
    plain_sizes = plain_items.groupBy("item_id").agg(F.count("*").alias("n_plain"))
    plain = _verbatim(held, "doc_id", window).join(sized(plain_items), "h").join(pairs.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_semi").groupBy("doc_id", "item_id").agg(F.count("*").alias("n_equal"))
    plain = plain.join(sized(plain_sizes), "item_id").where(F.col("n_equal") >= F.lit(coverage) * F.col("n_plain")).select("doc_id", "item_id", F.lit(True).alias("equal"))
    judged = pairs.join(slots, ["doc_id", "item_id"], "left").join(lost, ["doc_id", "item_id"], "left").join(plain, ["doc_id", "item_id"], "left")
    whole = F.coalesce(F.col("good_all") >= F.lit(consistent) * F.col("n_all"), F.lit(True))
    parts = F.col("n_matched") - F.col("lost") >= F.lit(coverage) * F.col("n_windows")
    return judged.where(whole | parts | F.col("equal")).select(
        "doc_id", "item_id", "n_windows", "n_matched", "coverage",
        F.coalesce(F.when(whole, F.col("n_all")).otherwise(F.col("n_agreed")), F.lit(0)).alias("n_slots"),
        F.coalesce(F.when(whole, F.col("good_all")).otherwise(F.col("good_agreed")), F.lit(0)).alias("n_consistent"),
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item; the pairs that leak."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Store(spark, "leaks"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = leaks(docs, table(spark, sf_dir, "benchmark"), Store(spark, "leaks-stage")).select(F.col("doc_id").alias("__leaks")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("__leaks"), "left_anti")
