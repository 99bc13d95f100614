"""Bootstraps with exact draws of m rows with replacement, of which no row is ever copied.

Rows of a class are numbered and cut into blocks of equal size. The draws of a replicate go down a binary tree over the
blocks: at each node a binomial number goes left, inverted from a uniform number that is a hash of seed, replicate and
node. Node sizes follow from the number of rows alone, so that a block finds its own share from the root without asking
any other, and deals it out over its rows by further hashes. A row then carries one count for each replicate.

How many of a replicate's draws are of the positive class is drawn first, again and again by the number of the attempt
until both classes occur; this has the distribution of drawing whole replicates until both occur, and needs no row.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakequill.operators import ranks

#: Rows of a block; attempts until both classes are drawn; numbers held at once while a binomial is inverted.
LEAF, ATTEMPTS, CELLS = 4096, 1000, 1 << 22
_MASK = (1 << 32) - 1


def mixed(*parts) -> np.ndarray:
    """A 32-bit hash of whole numbers below 2^32, or arrays of them."""
    h = np.uint64(0)
    for p in parts:
        h = np.asarray(h ^ np.asarray(p, np.uint64))
        h = ((h ^ (h >> np.uint64(16))) * np.uint64(0x7FEB352D)) & np.uint64(_MASK)
        h = ((h ^ (h >> np.uint64(15))) * np.uint64(0x2C1B3C6D)) & np.uint64(_MASK)
        h = h ^ (h >> np.uint64(16))
    return h


def uniform(*parts) -> np.ndarray:
    return (mixed(*parts).astype(float) + 0.5) / float(1 << 32)


def binomial(m: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """The least k whose distribution function under (m, p) is above u, for each m and u. Twelve standard deviations and 30 on
    either side of the mean are summed: what lies beyond has less weight than the last place of a double."""
    m = np.asarray(m, np.int64)
    if p <= 0 or p >= 1 or not len(m):
        return np.where(p >= 1, m, 0)
    reach = int(12 * np.sqrt(m.max() * p * (1 - p))) + 30
    step = max(1, CELLS // (2 * reach + 1))
    out = np.empty(len(m), np.int64)
    for i in range(0, len(m), step):
        own = m[i : i + step, None]
        low = np.maximum((own * p).astype(np.int64) - reach, 0)
        k = low + np.arange(2 * reach + 1)
        with np.errstate(divide="ignore"):
            up = np.log(np.maximum(own - k, 0) / (k + 1) * (p / (1 - p)))
        logs = np.concatenate([np.zeros_like(low, float), np.cumsum(up[:, :-1], axis=1)], axis=1)
        weight = np.exp(logs - logs.max(1, keepdims=True))
        below = np.cumsum(weight, axis=1) / weight.sum(1, keepdims=True)
        out[i : i + step] = np.minimum(low[:, 0] + (below <= u[i : i + step, None]).sum(1), own[:, 0])
    return out


def class_sizes(n_pos: int, n_neg: int, replicates: int, seed: int) -> list[int]:
    """The number of positives in each replicate; never none, never all."""
    if not n_pos or not n_neg:
        raise ValueError("AUROC needs both classes")
    n, out = n_pos + n_neg, np.zeros(replicates, np.int64)
    for attempt in range(ATTEMPTS):
        open_ = np.flatnonzero((out == 0) | (out == n))
        if not len(open_):
            return out.tolist()
        out[open_] = binomial(np.full(len(open_), n), n_pos / n, uniform(seed, open_ + 1, 2, attempt))
    if ((out == 0) | (out == n)).any():
        raise RuntimeError("labels are too imbalanced to be redrawn")
    return out.tolist()


def block_draws(draws: tuple[int, ...], rows: int, leaf: int, cls: int, block: int, seed: int) -> np.ndarray:
    """How many of each replicate's draws from `rows` rows fall into a block: the way from the root down to it."""
    level, node = max(-(-rows // leaf) - 1, 0).bit_length(), 0
    m, depth = np.array(draws, np.int64), level
    for d in range(depth):
        left = _left(draws, rows, leaf, cls, depth, d, node, seed, m.tobytes())
        node = 2 * node + ((block >> (depth - d - 1)) & 1)
        m = m - left if node & 1 else left
    return m


@lru_cache(maxsize=4096)
def _left(draws: tuple[int, ...], rows: int, leaf: int, cls: int, depth: int, level: int, node: int, seed: int, m: bytes) -> np.ndarray:
    width = leaf << (depth - level - 1)
    at = 2 * node * width
    own = [max(0, min(width, rows - start)) for start in (at, at + width)]
    u = uniform(seed, np.arange(1, len(draws) + 1), cls, level, node)
    return binomial(np.frombuffer(m, np.int64), own[0] / max(sum(own), 1), u)


def counts(df: DataFrame, label: str, n: dict[int, int], draws: dict[int, list[int]], key: str, seed: int, leaf: int = LEAF) -> DataFrame:
    """df with _w: the row's count in each replicate, as 32-bit numbers in a binary; `draws` of each class from its `n` rows."""
    cls = F.when(F.col(label) == 1, 1).otherwise(0)
    numbered = ranks.row_numbers(df.withColumn("_c", cls), ["_c"], [key], "_i")
    numbered = numbered.withColumn("_i", F.col("_i") - 1).withColumn("_block", F.floor(F.col("_i") / leaf))
    fixed = {c: tuple(int(x) for x in draws[c]) for c in draws}

    def deal(own: pd.DataFrame) -> pd.DataFrame:
        c, block = int(own["_c"].iloc[0]), int(own["_block"].iloc[0])
        m = block_draws(fixed[c], n[c], leaf, c, block, seed)
        size = min(leaf, n[c] - block * leaf)
        r = np.repeat(np.arange(len(m)), m)
        d = np.arange(len(r)) - np.repeat(np.cumsum(m) - m, m)
        place = ((mixed(seed, r + 1, c, 100, block, d) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)
        dealt = np.bincount(r * size + place, minlength=len(m) * size).reshape(len(m), size).T.astype("<u4")
        return own.assign(_w=[dealt[i].tobytes() for i in own["_i"] - block * leaf]).drop(columns=["_c", "_i", "_block"])

    schema = df.schema.add("_w", "binary")
    return numbered.groupBy("_c", "_block").applyInPandas(deal, schema)


def weighted_auroc(df: DataFrame, score: str, label: str, replicates: int) -> DataFrame:
    """(r, auroc) from rows with _w. Partitions are ranges of the score, and of a hash within it, so that one score in all rows is
    dealt out too; each gives its sums, with the scores at either end by themselves, as the next partition may go on with them."""

    def parts(batches):  # noqa: ANN001, ANN202
        first = held = None
        lo, pos, neg, u = None, *np.zeros((3, replicates))
        for b in batches:
            if not b.num_rows:
                continue
            s = b.column(0).to_numpy(zero_copy_only=False)
            y = b.column(1).to_numpy(zero_copy_only=False).astype(float)[:, None]
            w = np.frombuffer(b"".join(b.column(2).to_pylist()), "<u4").reshape(len(s), replicates).astype(float)
            starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            s, p, q = s[starts], np.add.reduceat(w * y, starts), np.add.reduceat(w * (1 - y), starts)
            if held and held[0] == s[0]:
                p[0] += held[1]
                q[0] += held[2]
            elif held:
                s, p, q = np.r_[held[0], s], np.vstack([held[1], p]), np.vstack([held[2], q])
            held = (s[-1], p[-1], q[-1])
            s, p, q = s[:-1], p[:-1], q[:-1]
            if first is None and len(s):
                first, s, p, q = (s[0], p[0], q[0]), s[1:], p[1:], q[1:]
            if len(s):
                lo = s[0] if lo is None else lo
                u = u + (p * (neg + np.cumsum(q, axis=0) - q / 2)).sum(0)
                pos, neg = pos + p.sum(0), neg + q.sum(0)
        ends = [(*e, np.zeros(replicates), True) for e in (first, held) if e is not None]
        out = ends + ([(lo, pos, neg, u, False)] if lo is not None else [])
        lists = [pa.array([x[i].tolist() for x in out], pa.list_(pa.float64())) for i in (1, 2, 3)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.float64()), *lists, pa.array([x[4] for x in out], pa.bool_())], names=["lo", "p", "q", "u", "one"])

    rows = df.select(F.col(score).cast("double").alias("s"), (F.col(label) == 1).cast("int").alias("y"), "_w")
    spread = rows.repartitionByRange("s", F.xxhash64("_w", "y")).sortWithinPartitions("s")
    sums = spread.mapInArrow(parts, "lo double, p array<double>, q array<double>, u array<double>, one boolean")
    flat = sums.select("lo", "one", F.posexplode(F.arrays_zip("p", "q", "u")).alias("r", "z"))
    merged = flat.groupBy("r", "lo").agg(F.sum("z.p").alias("p"), F.sum("z.q").alias("q"), F.sum("z.u").alias("u"), F.max("one").alias("one"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy("r").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    u = F.when(F.col("one"), F.col("p") * F.col("q") / 2).otherwise(F.col("u")) + F.col("p") * F.col("_below")
    return merged.withColumn("_below", below).groupBy("r").agg(F.try_divide(F.sum(u), F.sum("p") * F.sum("q")).alias("auroc"))


def interval(by_replicate: DataFrame, x: str, level: float) -> list[Column]:
    at = lambda q: F.percentile(F.col(x), F.lit(q))
    return [at((1 - level) / 2).alias("low"), at((1 + level) / 2).alias("high")]


def keyed(df: DataFrame, key: str | None, *columns: str) -> DataFrame:
    """Rows that have all the columns (a score that is not a number counts as none), with _key: the key's text, or the row's."""
    known = df.where(~F.isnull(F.col(columns[-1])))
    for c in columns[:-1]:
        known = known.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return known.select((F.col(key).cast("string") if key else F.to_json(F.struct(*df.columns))).alias("_key"), *dict.fromkeys(columns))


def class_counts(known: DataFrame, label: str) -> dict[int, int]:
    r = known.agg(F.count_if(F.col(label) == 1).alias("p"), F.count("*").alias("n")).first()
    return {1: r["p"], 0: r["n"] - r["p"]}


def bootstrap_auroc(df: DataFrame, score: str, label: str, replicates: int = 200, seed: int = 0, key: str | None = None, level: float = 0.95, leaf: int = LEAF) -> DataFrame:
    """(observed, low, high) of one score's AUROC."""
    return bootstrap_auroc_difference(df, score, None, label, replicates, seed, key, level, leaf).drop("excludes_zero")


def bootstrap_auroc_difference(df: DataFrame, a: str, b: str | None, label: str, replicates: int = 200, seed: int = 0, key: str | None = None, level: float = 0.95, leaf: int = LEAF) -> DataFrame:
    """(observed, low, high, excludes_zero): AUROC(a) - AUROC(b), or AUROC(a) where there is no b, over paired replicates of as many
    draws with replacement as there are rows. Raises where a class is absent."""
    from lakequill.operators.stats import auroc

    known = keyed(df, key, a, *([b] if b else []), label)
    n = class_counts(known, label)
    pos = class_sizes(n[1], n[0], replicates, seed)
    drawn = counts(known, label, n, {1: pos, 0: [n[0] + n[1] - p for p in pos]}, "_key", seed, leaf)
    x, seen = weighted_auroc(drawn, a, label, replicates), auroc(known, [], a, label).select(F.col("auroc").alias("observed"))
    if b:
        other = weighted_auroc(drawn, b, label, replicates).withColumnRenamed("auroc", "other")
        x = x.join(other, "r").select("r", (F.col("auroc") - F.col("other")).alias("auroc"))
        seen = seen.join(auroc(known, [], b, label).select(F.col("auroc").alias("other")), F.lit(True)).select((F.col("observed") - F.col("other")).alias("observed"))
    out = seen.join(x.agg(*interval(x, "auroc", level)), F.lit(True))
    return out.withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))


def mixture(df: DataFrame, score: str, label: str, target: int, negative_rate: float, replicates: int = 2000, seed: int = 0, key: str | None = None, level: float = 0.95, leaf: int = LEAF) -> DataFrame:
    """(low, high, width, median, n_pos, n_neg): the AUROC's interval at a size and share of negatives not observed: each replicate
    draws so many positives from the positives, so many negatives from the negatives. Raises where a class is absent."""
    known = keyed(df, key, score, label)
    n = class_counts(known, label)
    negatives = round(target * negative_rate)
    if not n[0] or not n[1] or not 0 < negatives < target:
        raise ValueError("AUROC needs both classes")
    drawn = counts(known, label, n, {1: [target - negatives] * replicates, 0: [negatives] * replicates}, "_key", seed, leaf)
    x = weighted_auroc(drawn, score, label, replicates)
    out = x.agg(*interval(x, "auroc", level), F.percentile("auroc", F.lit(0.5)).alias("median"))
    return out.select("low", "high", (F.col("high") - F.col("low")).alias("width"), "median", F.lit(n[1]).alias("n_pos"), F.lit(n[0]).alias("n_neg"))
