"""Exact bootstraps: binomials against enumeration, counts that add up, redraws, AUROC against a plain computation."""

import math

import numpy as np
import pytest

from lakequill.operators import resample as B


def plain_auroc(s, y, w):
    pos = [(a, c) for a, b, c in zip(s, y, w) if b == 1]
    neg = [(a, c) for a, b, c in zip(s, y, w) if b != 1]
    u = sum(c * d * ((a > b) + (a == b) / 2) for a, c in pos for b, d in neg)
    return u / (sum(c for _, c in pos) * sum(d for _, d in neg))


@pytest.mark.parametrize(("m", "p"), [(0, 0.5), (1, 0.3), (7, 0.5), (40, 0.9), (500, 0.01), (3000, 0.5)])
def test_binomial_is_the_inverse(m, p):
    f = np.cumsum([math.comb(m, k) * p**k * (1 - p) ** (m - k) for k in range(m + 1)]) if m < 900 else np.cumsum([math.exp(math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1) + k * math.log(p) + (m - k) * math.log(1 - p)) for k in range(m + 1)])
    u = B.uniform(3, np.arange(400))
    assert B.binomial(np.full(400, m), p, u).tolist() == np.minimum(np.searchsorted(f, u, "right"), m).tolist()


def test_binomial_far_from_home():
    got = B.binomial(np.full(200, 10**9), 0.5, B.uniform(1, np.arange(200)))
    z = (got - 5e8) / math.sqrt(2.5e8)
    assert abs(z.mean()) < 0.3 and 0.85 < z.std() < 1.15
    assert B.binomial(np.array([5, 9]), 1.0, np.array([0.1, 0.9])).tolist() == [5, 9]
    assert B.binomial(np.array([5, 9]), 0.0, np.array([0.1, 0.9])).tolist() == [0, 0]


def test_one_positive_in_twenty_is_redrawn():
    """A replicate of twenty has no positive with probability 0.36, so hundreds need more than one attempt."""
    once = B.binomial(np.full(600, 20), 1 / 20, B.uniform(4, np.arange(1, 601), 2, 0))
    sizes = np.array(B.class_sizes(1, 19, 600, 4))
    assert 150 < (once == 0).sum() < 280 and sizes.min() == 1 and sizes.max() < 20
    assert (sizes[once > 0] == once[once > 0]).all()
    p = [math.comb(20, k) * 0.05**k * 0.95 ** (20 - k) for k in range(1, 20)]
    assert abs(sizes.mean() - sum(k * q for k, q in enumerate(p, 1)) / sum(p)) < 0.12
    with pytest.raises(ValueError):
        B.class_sizes(0, 5, 10, 0)


@pytest.mark.parametrize(("rows", "leaf"), [(1, 4), (4, 4), (5, 4), (37, 4), (1000, 16)])
def test_blocks_share_all_draws(rows, leaf):
    draws = tuple(range(0, 3000, 150))
    blocks = -(-rows // leaf)
    total = sum(B.block_draws(draws, rows, leaf, 1, b, 9) for b in range(blocks))
    assert total.tolist() == list(draws)


def rows_of(spark, n=300, seed=0, positive=0.2, values=40):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < positive).astype(int)
    y[0], y[1] = 1, 0
    return spark.createDataFrame([(f"k{i}", float(rng.integers(values) + y[i] * 4), int(y[i]), float(rng.random())) for i in range(n)], "id string, s double, y int, t double")


def test_counts_and_auroc(spark):
    df = rows_of(spark).withColumnRenamed("id", "_key")
    n = B.class_counts(df, "y")
    pos = B.class_sizes(n[1], n[0], 30, 5)
    drawn = B.counts(df, "y", n, {1: pos, 0: [300 - p for p in pos]}, "_key", 5, leaf=16)
    rows = drawn.collect()
    w = np.array([np.frombuffer(r["_w"], "<u4") for r in rows])
    assert w.shape == (300, 30) and (w.sum(0) == 300).all()
    assert w[[r.y == 1 for r in rows]].sum(0).tolist() == pos
    got = {r.r: r.auroc for r in B.weighted_auroc(drawn, "s", "y", 30).collect()}
    assert all(got[r] == pytest.approx(plain_auroc([x.s for x in rows], [x.y for x in rows], w[:, r])) for r in range(30))
    other = B.counts(df.repartition(7), "y", n, {1: pos, 0: [300 - p for p in pos]}, "_key", 5, leaf=16)
    assert {r["_key"]: bytes(r["_w"]) for r in other.collect()} == {r["_key"]: bytes(r["_w"]) for r in rows}


def test_counts_are_like_draws_with_replacement(spark):
    """Each row's count has mean and variance of binomial(n, 1/n); counts of two rows are negatively related, as they share n."""
    df = rows_of(spark, 64).withColumnRenamed("id", "_key").withColumn("one", B.F.lit(0))
    w = np.array([np.frombuffer(r["_w"], "<u4") for r in B.counts(df, "one", {1: 0, 0: 64}, {1: [0] * 4000, 0: [64] * 4000}, "_key", 2, leaf=8).collect()], float)
    assert abs(w.mean() - 1) < 1e-9 and abs(w.var(axis=1).mean() - (1 - 1 / 64)) < 0.03
    c = np.cov(w)
    assert abs((c.sum() - np.trace(c)) / (64 * 63) + 1 / 64) < 0.002


def test_one_value_in_all_rows(spark):
    df = rows_of(spark, values=1).withColumn("s", B.F.lit(7.0))
    got = B.bootstrap_auroc(df, "s", "y", 20, leaf=16).first()
    assert (got.observed, got.low, got.high) == (0.5, 0.5, 0.5)


def test_intervals(spark):
    df = rows_of(spark)
    one = B.bootstrap_auroc(df, "s", "y", 60, key="id").first()
    assert one.low < one.observed < one.high and one.high - one.low < 0.4
    same = B.bootstrap_auroc_difference(df, "s", "s", "y", 20, key="id").first()
    assert (same.observed, same.low, same.high, same.excludes_zero) == (0.0, 0.0, 0.0, False)
    far = B.bootstrap_auroc_difference(df.withColumn("sure", B.F.col("y") + B.F.col("t") / 2), "sure", "t", "y", 60, key="id").first()
    assert far.excludes_zero and far.low > 0.2
    small, large = (B.mixture(df, "s", "y", n, 0.25, 100, key="id").first() for n in (20, 400))
    assert large.width < small.width and small.low < small.median < small.high


def test_no_class_no_rows_and_missing_values(spark):
    df = rows_of(spark, 40)
    for bad in (df.where("y = 1"), df.limit(0), df.where("y = 0")):
        with pytest.raises(ValueError):
            B.bootstrap_auroc(bad, "s", "y", 5)
    holes = df.union(spark.createDataFrame([("n1", None, 1, 0.0), ("n2", 3.0, None, 0.0), ("n3", float("nan"), 0, 0.0)], df.schema))
    assert B.bootstrap_auroc(holes, "s", "y", 10, key="id").first() == B.bootstrap_auroc(df, "s", "y", 10, key="id").first()
