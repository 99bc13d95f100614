"""Seating puzzles as a table, all solved at once, and a deterministic generator by integer arithmetic.

A puzzle seats n names (0 to n-1) on seats 1 to n under clues (op, a, b). at: a sits at seat b; imm: directly before b; lt:
somewhere before b; adj: beside b; nat: not at seat b. A seating is one number, four bits a name. There are few possible clues
(360) and at most 8! seatings, so a small table tells once, as a bitmap over the seatings, where each clue holds. A set of clues
is then the conjunction of bitmaps: solutions, the shortest prefix that is enough and pruning are found for a batch of puzzles at
once, clue by clue, with no shuffle of puzzles and no job per clue.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

#: 8! seatings are 40,320 numbers, or 630 words of a bitmap.
SEATS = 8
OPS = ("at", "nat", "imm", "lt", "adj")
#: Words of bitmaps that a task holds at once.
WORDS = 1 << 22


def seat(seating: Column, name: Column) -> Column:
    return F.call_function("shiftright", seating, (name * 4).cast("int")).bitwiseAND(F.lit(15)).cast("int")


def holds(seating: Column, op: Column, a: Column, b: Column) -> Column:
    x, y = seat(seating, a), seat(seating, b)
    return F.when(op == "at", x == b).when(op == "nat", x != b).when(op == "imm", x + 1 == y).when(op == "lt", x < y).when(op == "adj", F.abs(x - y) == 1)


def seatings(spark: SparkSession, most: int = SEATS) -> DataFrame:
    """(n, seatings) for n from 1 to most: names sit down one after another, each on a seat that is free."""
    if not 1 <= most <= SEATS:
        raise ValueError(f"one to {SEATS} seats")
    n = spark.range(1, most + 1).select(F.col("id").cast("int").alias("n"))

    def sit(held: Column, name: Column) -> Column:
        seats = F.sequence(F.lit(1), F.col("n"))
        taken = lambda s, k: F.exists(F.sequence(F.lit(0), F.col("n") - 1), lambda o: (o < name) & (seat(s, o) == k))
        put = lambda s: F.transform(F.filter(seats, lambda k: ~taken(s, k)), lambda k: s + F.call_function("shiftleft", k.cast("long"), (name * 4).cast("int")))
        return F.flatten(F.transform(held, put))

    return n.select("n", F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.array(F.lit(0).cast("long")), sit).alias("seatings"))


def _place(op: Column, a: Column, b: Column) -> Column:
    """Where a clue stands among the 360."""
    return ((F.array_position(F.array(*(F.lit(o) for o in OPS)), op) - 1) * 8 + a) * 9 + b


def clue_table(spark: SparkSession, most: int = SEATS) -> DataFrame:
    """(n, seatings, bits, all): where each clue holds, as bitmaps over the seatings; a row for each n, 2 MB for eight seats."""
    table = seatings(spark, most)
    codes = spark.range(len(OPS) * 72).select(F.array(*(F.lit(o) for o in OPS))[(F.col("id") / 72).cast("int")].alias("op"), (F.col("id") / 9 % 8).cast("int").alias("a"), (F.col("id") % 9).cast("int").alias("b"))
    rows = table.select("n", F.posexplode("seatings").alias("i", "p")).join(F.broadcast(codes), F.lit(True))
    bit = F.when(holds(F.col("p"), F.col("op"), F.col("a"), F.col("b")), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("i") % 64).cast("int"))).otherwise(0)
    words = rows.groupBy("n", _place(F.col("op"), F.col("a"), F.col("b")).alias("c"), F.floor(F.col("i") / 64).alias("w")).agg(F.bit_or(bit).alias("x"))
    each = words.groupBy("n", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "x"))), lambda s: s["x"]).alias("x"))
    bits = each.groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "x"))), lambda s: s["x"]).alias("bits"))
    # each seating has or has not a name 0 at seat 1
    whole = F.zip_with(F.get("bits", F.lit(1)), F.get("bits", F.lit(73)), lambda x, y: x.bitwiseOR(y))
    return table.join(bits, "n").withColumn("all", whole)


def _solve(whole: np.ndarray, held: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of puzzles with one number of seats: the bitmaps of what is left, how many seatings that is, the length of the prefix, and which
    clues are kept. whole: bitmap of all seatings; held: (puzzle, clue, word), all seatings behind a puzzle's last clue."""
    count = lambda x: np.bitwise_count(x).sum(-1, dtype=np.int64)
    puzzles, most = held.shape[:2]
    after = np.empty((puzzles, most + 1, len(whole)), np.uint64)  # after[i]: what the clues from i on leave together
    after[:, most] = whole
    for i in reversed(range(most)):
        np.bitwise_and(after[:, i + 1], held[:, i], out=after[:, i])
    left, prefix = np.broadcast_to(whole, after[:, 0].shape), np.zeros(puzzles, np.int64)
    for i in range(most):
        prefix += count(left) > 1
        left = left & held[:, i]
    kept, own = np.zeros((puzzles, most), bool), np.broadcast_to(whole, left.shape)
    for i in range(most):
        needless = (kept.any(1) | (i < sizes - 1)) & (count(own & after[:, i + 1]) == 1)
        kept[:, i] = ~needless & (i < sizes)
        own = np.where(needless[:, None], own, own & held[:, i])
    return after[:, 0], count(after[:, 0]), prefix, kept


def solved(puzzles: DataFrame, n: Column, clues: str, most: int = SEATS) -> DataFrame:
    """puzzles with solutions (seatings as numbers, ascending), reason (null where there is just one; "seats", "clues" for a puzzle
    that is not of this kind, "none", "several"), prefix (the fewest clues from the left that leave one) and minimal (the clues left
    after dropping, from the left, each without which one solution is left; at least one stays). The last two are null beside a
    reason, solutions beside the first two reasons."""
    table = {  # 2 MB at most
        r["n"]: (np.array(r["seatings"]), np.array(r["bits"], np.int64).view(np.uint64), np.array(r["all"], np.int64).view(np.uint64))
        for r in clue_table(puzzles.sparkSession, most).collect()
    }

    def told(b: pa.RecordBatch, rows: np.ndarray, solutions: pa.Array, prefix: np.ndarray | None = None, kept: np.ndarray | None = None) -> pa.RecordBatch:
        """kept has a row for each puzzle, without a clue where there is no prefix."""
        b = b.take(pa.array(rows)).drop_columns(["_n", "_clues"])
        nothing = pa.nulls(len(rows), pa.int32())
        which = pa.nulls(len(rows), pa.list_(pa.int32()))
        if prefix is not None:
            nothing = pa.array(prefix.astype(np.int32), mask=prefix < 0)
            offsets = np.concatenate([[0], np.cumsum(kept.sum(1))]).astype(np.int32)
            which = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(kept)[1].astype(np.int32)), mask=pa.array(prefix < 0))
        return pa.RecordBatch.from_arrays([*b.columns, solutions, nothing, which], names=[*b.schema.names, "solutions", "prefix", "_kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seats = b.column("_n").fill_null(0).to_numpy()
            every, sizes = b.column("_clues"), b.column("_clues").value_lengths().fill_null(0).to_numpy()
            begin, parts = np.cumsum(sizes) - sizes, every.flatten()
            # a null clue has null fields
            op, x, y = (c.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in (pc.index_in(parts.field("op"), pa.array(OPS)), *(pc.struct_field(parts, k) for k in "ab")))
            own = np.repeat(seats, sizes)
            fits = (op >= 0) & (x >= 0) & (x < own) & (y >= 0) & (y <= np.where(op >= 2, own - 1, SEATS))
            unfit = np.zeros(len(seats), bool)
            unfit[np.repeat(np.arange(len(seats)), sizes)[~fits]] = True
            place = (op * 8 + x) * 9 + y
            known = np.isin(seats, list(table)) & ~unfit & every.is_valid().to_numpy(zero_copy_only=False)
            if not known.all():
                rows = np.nonzero(~known)[0]
                yield told(b, rows, pa.nulls(len(rows), pa.list_(pa.int64())))
            for size, (numbers, bits, whole) in table.items():
                rows, order = np.nonzero(known & (seats == size))[0], np.argsort(numbers)
                step = max(1, WORDS // (len(whole) * max(64, int(sizes[rows].max(initial=0)))))
                for at in range(0, len(rows), step):
                    part = rows[at : at + step]
                    k = sizes[part]
                    filled = np.arange(k.max()) < k[:, None]
                    held = np.broadcast_to(whole, (*filled.shape, len(whole))).copy()
                    held[filled] = bits[place[(begin[part][:, None] + np.arange(k.max()))[filled]]]
                    left, count, prefix, kept = _solve(whole, held, k)
                    fine = (count == 1) & (k > 0)
                    kept[~fine] = False
                    found = np.unpackbits(left.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, order]
                    offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                    solutions = pa.ListArray.from_arrays(pa.array(offsets), pa.array(numbers[order][np.nonzero(found)[1]]))
                    yield told(b, part, solutions, np.where(fine, prefix, -1), kept)

    bare = F.transform(clues, lambda c: F.struct(c["op"].alias("op"), c["a"].cast("long").alias("a"), c["b"].cast("long").alias("b")))
    d = puzzles.withColumns({"_n": n.cast("int"), "_clues": bare})
    schema = StructType([*puzzles.schema.fields]).add("solutions", ArrayType(LongType())).add("prefix", IntegerType()).add("_kept", ArrayType(IntegerType()))
    d = d.mapInArrow(run, schema)
    size = F.size("solutions")
    reason = F.when(F.col("solutions").isNull(), F.when(F.coalesce(n.between(1, most), F.lit(False)), "clues").otherwise("seats")).when(size == 0, "none").when(size > 1, "several")
    minimal = F.transform("_kept", lambda i: F.get(clues, i))
    return d.select(*puzzles.columns, "solutions", reason.alias("reason"), "prefix", minimal.alias("minimal"))


def hashed_puzzles(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """df with clues: a seating by the hash of (seed, key, name) and all that is true of it (pairs, seats taken, seats not taken), in the
    order of a hash. Any row can be made alone."""
    d = df.withColumn("_k", F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.col(key).cast("string"), F.lit(":")), F.lit(""))))
    digest = lambda *x: F.md5(F.concat("_k", *x))
    d = d.withColumn("_p", F.array(*(digest(F.lit(str(a))) for a in range(n))))
    at = lambda a: F.col("_seat")[a]
    # no lambdas, so that code is generated for all of it
    d = d.withColumn("_seat", F.array(*(sum((F.when(F.col("_p")[b] <= F.col("_p")[a], 1).otherwise(0) for b in range(n)), F.lit(0)) for a in range(n))))

    def clue(op: Column, a: Column, b: Column, said: Column) -> Column:
        return F.struct(digest(op, said).alias("h"), F.struct(op.alias("op"), a.cast("int").alias("a"), b.cast("int").alias("b")).alias("c"))

    all_ = [clue(F.when(at(a) == s, "at").otherwise("nat"), F.lit(a), F.lit(s), F.lit(f":{a}:{s}")) for a in range(n) for s in range(1, n + 1)]
    for a in range(n):
        for b in range(a + 1, n):
            before = at(a) < at(b)
            op = F.when(F.abs(at(a) - at(b)) == 1, "imm").otherwise("lt")
            all_.append(clue(op, F.when(before, a).otherwise(b), F.when(before, b).otherwise(a), F.when(before, f":{a}:{b}").otherwise(f":{b}:{a}")))
    return d.withColumn("clues", F.sort_array(F.array(*all_))["c"]).drop("_k", "_p", "_seat")


def _draw(family: Column, k: Column, per_family: int, seed: int, low: int, high: int) -> Column:
    """A linear congruential step from family, k and seed, so that any draw can be made alone."""
    at = F.pmod(family.cast("long") * per_family + k + seed, F.lit(1 << 31))
    state = F.pmod(at * F.lit(1103515245) + F.lit(12345), F.lit(1 << 31))
    return (low + F.pmod(F.floor(state / 65536), F.lit(high - low + 1))).cast("long")


def draws(keys: DataFrame, family: str, per_family: int, seed: int, low: int, high: int) -> DataFrame:
    """(family, k, value): per_family draws for each row of keys, without a shuffle."""
    rows = keys.select(F.col(family).cast("long").alias("family"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(per_family - 1).cast("long"))).alias("k"))
    return rows.withColumn("value", _draw(F.col("family"), F.col("k"), per_family, seed, low, high))


def families(keys: DataFrame, family: str, seed: int, corrections: int) -> DataFrame:
    """(family, base, corrections, totals, reason) for each row of keys: a base quantity, corrections in turn and the total after
    each; families whose corrections leave the total unchanged or negative get a reason and are meant to be left out."""
    drawn = F.transform(F.sequence(F.lit(0), F.lit(corrections)), lambda k: _draw(F.col("family"), k, corrections + 1, seed, -20, 60))
    by = keys.select(F.col(family).cast("long").alias("family")).withColumn("v", drawn)
    by = by.select("family", (F.col("v")[0] + 100).alias("base"), F.slice("v", 2, corrections).alias("corrections"))
    totals = F.transform(F.sequence(F.lit(0), F.size("corrections")), lambda t: F.col("base") + F.aggregate(F.when(t > 0, F.slice("corrections", 1, F.greatest(t, F.lit(1)))).otherwise(F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, x: a + x))
    by = by.withColumn("totals", totals)
    reason = F.when(F.exists("corrections", lambda x: x == 0), "no change").when(F.exists("totals", lambda x: x < 0), "negative").when(F.size(F.array_distinct("totals")) < F.size("totals"), "repeated total")
    return by.withColumn("reason", reason)
