"""Published values and properties of the statistics."""

import math

import numpy as np
import pytest

from lakequill.operators import probes, stats


class TestTails:
    def test_upper_tail(self):
        assert stats.binomial_upper_tail(5, 20, 0.10) == pytest.approx(0.0431745, abs=1e-7)
        assert stats.binomial_upper_tail(0, 9, 0.5) == 1.0 and stats.binomial_upper_tail(10, 9, 0.5) == 0.0

    @pytest.mark.parametrize(("n", "p", "k"), [(138, 0.05, 14), (260, 0.10, 38)])
    def test_critical_counts(self, n, p, k):
        assert stats.critical_count(n, p, 0.05 / 3 if p == 0.10 else 0.05 / 3) == k

    def test_sixty(self):
        assert stats.critical_count(60, 0.05, 0.05 / 3) == 8

    def test_upper_bound(self):
        assert stats.upper_95(0, 10) == pytest.approx(1 - 0.05 ** (1 / 10), abs=1e-9)
        assert stats.upper_95(10, 10) == 1.0
        assert 1 - stats.binomial_upper_tail(4, 40, stats.upper_95(3, 40)) == pytest.approx(0.05, abs=1e-9)

    def test_column_agrees(self, spark):
        df = spark.createDataFrame([(0, 20), (5, 20), (20, 20), (21, 20), (38, 260)], "k int, n int")
        got = df.select("k", "n", stats.binomial_tail_column(stats.F.col("k"), stats.F.col("n"), 0.1).alias("t")).collect()
        assert [r.t for r in got] == pytest.approx([stats.binomial_upper_tail(r.k, r.n, 0.1) for r in got], abs=1e-12)


class TestProportions:
    def test_published_arms(self, spark):
        rates = spark.createDataFrame([("A", 3, 107), ("B", 1, 107), ("C", 11, 107)], "arm string, successes long, trials long")
        got = {(r.arm_a, r.arm_b): r for r in stats.corrected(stats.pairwise_z(rates, "arm"), 3).collect()}
        assert got["B", "C"].z == pytest.approx(-2.9713, abs=1e-4) and got["B", "C"].p == pytest.approx(0.002966, abs=1e-6)
        assert got["B", "C"].p_corrected == pytest.approx(0.008897, abs=2e-6)
        assert got["A", "B"].z == pytest.approx(1.0095, abs=1e-4) and got["A", "C"].p == pytest.approx(0.026990, abs=1e-6)

    def test_no_variance(self, spark):
        rates = spark.createDataFrame([("A", 0, 5), ("B", 0, 9)], "arm string, successes long, trials long")
        r = stats.corrected(stats.pairwise_z(rates, "arm"), 3).first()
        assert (r.z, r.p, r.p_corrected) == (0.0, 1.0, 1.0)

    def test_detectable_effect(self):
        # base rate 1.2 % at 107 items a group
        assert stats.minimum_detectable_effect(0.5, 100) == pytest.approx((1.959964 + 0.841621) * math.sqrt(0.5 / 100), abs=1e-6)

    @pytest.mark.parametrize(("counts", "z"), [((2, 5, 9), 2.2454), ((9, 5, 2), -2.2454)])
    def test_trend(self, spark, counts, z):
        df = spark.createDataFrame([(i, c, 60) for i, c in enumerate(counts)], "dose int, x int, n int")
        assert stats.cochran_armitage(df, "dose", "x", "n").first().z == pytest.approx(z, abs=1e-4)
        assert stats.monotone(df, "dose", "x", "n").first().passes == (z > 0)

    def test_flat_then_jump_fails(self, spark):
        df = spark.createDataFrame([(0, 0, 150), (1, 0, 150), (2, 18, 150)], "dose int, x int, n int")
        r = stats.monotone(df, "dose", "x", "n").first()
        assert r.z == pytest.approx(5.303, abs=1e-3) and not r.passes

    def test_published_axes(self, spark):
        for counts, z in (([(157, 300), (145, 150), (130, 138)], 10.5089), ([(13, 260), (12, 260), (14, 260)], 0.2012), ([(40, 150), (77, 262), (83, 344)], -0.8952)):
            df = spark.createDataFrame([(i, x, n) for i, (x, n) in enumerate(counts)], "dose int, x int, n int")
            assert stats.cochran_armitage(df, "dose", "x", "n").first().z == pytest.approx(z, abs=1e-4)

    def test_margin_is_inclusive(self, spark):
        df = spark.createDataFrame([(t, a, v) for t in range(10) for a, v in (("B", 0.9), ("C", 0.8))] + [(99, "B", 0.0)], "task int, arm string, v double")
        r = stats.non_inferior(df, "task", "arm", "v", "B", "C", 0.1).first()
        assert r.n == 10 and r.non_inferior


class TestRanks:
    def test_auroc_and_spearman(self, spark):
        rng = np.random.default_rng(0)
        x, y = rng.integers(0, 12, 200), rng.integers(0, 2, 200)
        df = spark.createDataFrame([(int(a), int(b), float(a * 2 + c)) for a, b, c in zip(x, y, rng.normal(size=200), strict=True)], "x int, y int, w double")
        pos, neg = x[y == 1], x[y == 0]
        brute = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
        assert stats.auroc(df, [], "x", "y").first().auroc == pytest.approx(brute)
        assert stats.auroc(df.where("y = 1"), [], "x", "y").first().auroc is None
        import pandas as pd

        p = df.toPandas()
        assert stats.spearman(df, [], "x", "w").first().spearman == pytest.approx(pd.Series(p.x).rank().corr(p.w.rank()))
        assert stats.spearman(df.withColumn("x", stats.F.lit(1)), [], "x", "w").first().spearman is None

    def test_two_column_residuals(self, spark):
        rng = np.random.default_rng(1)
        a, b = rng.normal(size=(2, 50))
        y = 3 + 2 * a - b + rng.normal(size=50)
        df = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, a, b, strict=True)], "y double, a double, b double")
        got = np.array([r.e for r in stats.residuals(df, "y", ["a", "b"], "e").orderBy("y").collect()])
        m = np.c_[a, b, np.ones(50)]
        expected = (y - m @ np.linalg.lstsq(m, y, rcond=None)[0])[np.argsort(y)]
        assert np.allclose(got, expected)


class TestProbes:
    def table(self, spark, n=120, d=5):
        rng = np.random.default_rng(2)
        x = rng.normal(size=(n, d)) * [1, 2, 3, 1, 0]
        y = x @ [1.0, -0.5, 0.2, 0, 0] + 4 + 0.1 * rng.normal(size=n)
        return x, y, spark.createDataFrame([(i, v.tolist(), float(t), int(t > 4), i % 3) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id long, v array<double>, y double, c int, g int")

    def test_ridge_closed_form(self, spark):
        x, y, df = self.table(spark)
        w, b, alpha = probes.ridge(df, "v", "y", "id", alphas=(0.5,))
        sd = x.std(0)
        sd[sd == 0] = 1
        z = (x - x.mean(0)) / sd
        expected = np.linalg.solve(z.T @ z + 0.5 * np.eye(5), z.T @ (y - y.mean())) / sd
        assert alpha == 0.5 and np.allclose(w, expected) and b == pytest.approx(y.mean() - x.mean(0) @ expected)

    def test_out_of_fold_is_accurate(self, spark):
        _, _, df = self.table(spark)
        out = probes.out_of_fold(df, "v", "y", "id")
        assert out.count() == 120 and stats.r_squared(out, [], "y", "predicted").first().r2 > 0.95

    def test_logistic_gradient_vanishes(self, spark):
        x, _, df = self.table(spark)
        w, b = probes.logistic(df, "v", "c")
        c = np.array([r.c for r in df.orderBy("id").collect()])
        p = 1 / (1 + np.exp(-(x @ w + b)))
        assert np.abs(np.append(x.T @ (p - c) + w, (p - c).sum())).max() < 1e-6

    def test_volume(self, spark):
        x, _, df = self.table(spark, 40)
        got = {r.g: r.volume for r in probes.semantic_volume(df, "g", "v").collect()}
        for g in range(3):
            z = x[np.arange(40) % 3 == g]
            z = z - z.mean(0)
            z /= np.linalg.norm(z, axis=1, keepdims=True)
            assert got[g] == pytest.approx(np.linalg.slogdet(z @ z.T + 1e-3 * np.eye(len(z)))[1], rel=1e-6)


class TestPositions:
    def test_row_numbers_and_sums(self, spark):
        import random

        from lakequill.operators import ranks

        rng = random.Random(3)
        rows = [(rng.choice(["a", "a", "a", None]), rng.choice([None, *range(400)]), f"{rng.random():.9f}", i) for i in range(3000)]
        df = spark.createDataFrame(rows, "k string, x int, h string, id int")
        for keys, order in ((["k"], ["x", "id"]), ([], ["x", "id"]), (["k"], ["h", "id"]), ([], ["id"])):
            at = {"k": 0, "x": 1, "h": 2, "id": 3}
            sort = lambda r: [(r[at[o]] is not None, r[at[o]] if r[at[o]] is not None else 0) for o in order]  # noqa: B023, E731
            expected, seen, sums = {}, {}, {}
            for r in sorted(rows, key=sort):
                k = tuple(r[at[c]] for c in keys)
                seen[k], sums[k] = seen.get(k, 0) + 1, sums.get(k, 0) + r[3]
                expected[r[3]] = (seen[k], sums[k])
            numbered = ranks.running(ranks.row_numbers(df, keys, order, "n", "total"), keys, order, stats.F.col("id"), "s").collect()
            assert {r.id: (r.n, r.s) for r in numbered} == expected
            assert all(r.total == seen[tuple(getattr(r, c) for c in keys)] for r in numbered)

    def test_empty(self, spark):
        from lakequill.operators import ranks

        assert ranks.row_numbers(spark.createDataFrame([], "k string, x int"), ["k"], ["x"], "n").count() == 0
