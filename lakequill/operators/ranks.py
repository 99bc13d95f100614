"""Positions and running sums in a global order, without a window that holds all rows.

Rows are cut into buckets by the whole order: cuts are places in the sorted rows of least hash, so they are the same wherever
they are computed, and a column that is one value in all rows, or texts with a common beginning, are cut by what comes
after. Sums by bucket are partial aggregates and meet in a window of a few dozen rows a key; windows over rows see one
bucket only, and add what came before it. So a hot key, or a table without any, is dealt out like any other; only rows that
are equal in all columns can't be parted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets, in so many groups of so many; rows of least hash that the cuts are taken from.
BUCKETS, GROUP, SAMPLE = 64, 8, 2048


def bucketed(df: DataFrame, order: str | list[str], buckets: int = BUCKETS) -> DataFrame:
    """df with _b, which rises with the order (nulls first). The cuts are one row of at most `buckets` values."""
    order = [order] if isinstance(order, str) else order
    hashed = [f"`{c}`" for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    place = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)))
    few = df.select(place.alias("_o"), F.xxhash64(*hashed).alias("_hash")).orderBy("_hash").limit(SAMPLE)
    n = F.size("_s")
    cuts = few.agg(F.sort_array(F.collect_list("_o")).alias("_s")).select(F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)), lambda i: F.get("_s", F.floor(i * n / buckets).cast("int"))).alias("_cuts"))
    below = lambda c: F.coalesce(c < place, F.lit(False))
    coarse = F.size(F.filter("_cuts", lambda c, i: ((i + 1) % GROUP == 0) & below(c)))  # a group's last cut first, then those of one group
    fine = F.size(F.filter(F.slice("_cuts", F.col("_g") * GROUP + 1, F.lit(GROUP - 1)), below))
    return df.crossJoin(F.broadcast(cuts)).withColumn("_g", coarse).withColumn("_b", F.col("_g") * GROUP + fine).drop("_cuts", "_g")


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, total: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """df with the sum of value over the rows of the same keys up to each row, in the order, and over all of them as `total`.

    The order has to tell rows apart, or equal rows are numbered in any order.
    """
    d = df.withColumn("_v", value)
    d = bucketed(d.withColumn("_tie", F.xxhash64(*(f"`{c}`" for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind))), [*order, "_tie"], buckets)
    order = [*order, "_tie"]
    sums = d.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    w = Window.partitionBy(*keys)
    before = F.sum("_s").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_b").alias("_kb"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_s").over(w).alias("_total"))
    same = reduce(lambda p, q: p & q, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), F.col("_b") == F.col("_kb"))
    inside = F.sum("_v").over(Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # numbered before the join, so that equal orders get one numbering
    out = d.withColumn("_in", inside).join(sums, same)
    return out.select(*df.columns, (F.col("_before") + F.coalesce("_in", F.lit(0))).alias(name), *([F.col("_total").alias(total)] if total else []))


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str, total: str | None = None) -> DataFrame:
    """df with the number of each row, from 1, among the rows of the same keys."""
    return running(df, keys, order, F.lit(1).cast("long"), name, total)
