"""Vector operators: semantic volume, ridge and logistic probes. Numpy works inside Arrow batches, sums merge in Spark."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.operators.sampling import folds

ALPHAS = tuple(10.0**k for k in np.linspace(-3, 3, 13))


def semantic_volume(df: DataFrame, key: str, vector: str, epsilon: float = 1e-3) -> DataFrame:
    """(key, n, volume): log-determinant of the Gram matrix of centred unit vectors plus epsilon.

    det(X X' + eI) over n rows equals e^(n-d) det(X' X + eI) over d dimensions, so each key is reduced to a d x d matrix of
    moments before the shuffle and no group is ever gathered. Raw vectors enter twice: once for the mean, once centred.
    """
    known = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    field = known.schema["k"].dataType
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[field.simpleString()]

    def sums(batches):
        held: dict = {}
        for b in batches:
            keys, x = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), float)
            for k in set(keys):
                own = x[[i for i, y in enumerate(keys) if y == k]]
                n, s = held.get(k, (0, 0.0))
                held[k] = (n + len(own), s + own.sum(0))
        ks = list(held)
        yield pa.RecordBatch.from_arrays([pa.array(ks, kind), pa.array([held[k][0] for k in ks], pa.int64()), pa.array([held[k][1].tobytes() for k in ks], pa.binary())], names=["k", "n", "s"])

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": pdf.k[:1], "mean": [sum(np.frombuffer(x) for x in pdf.s) / pdf.n.sum()]})

    means = known.mapInArrow(sums, f"k {field.simpleString()}, n long, s binary").groupBy("k").applyInPandas(mean, f"k {field.simpleString()}, mean array<double>")

    def gram(batches):
        sums: dict = {}
        for b in batches:
            keys = b.column(0).to_pylist()
            x = np.array([np.subtract(v, m) for v, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)])
            if not len(x):
                continue
            norm = np.sqrt((x * x).sum(1, keepdims=True))
            x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-12)
            for k in set(keys):
                own = x[[i for i, y in enumerate(keys) if y == k]]
                n, g = sums.get(k, (0, 0.0))
                sums[k] = (n + len(own), g + own.T @ own)
        ks = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(ks, kind), pa.array([sums[k][0] for k in ks], pa.int64()), pa.array([sums[k][1].tobytes() for k in ks], pa.binary())], names=["k", "n", "g"])

    def volume(pdf: pd.DataFrame) -> pd.DataFrame:
        g = sum(np.frombuffer(x) for x in pdf.g)
        d, n = int(np.sqrt(len(g))), int(pdf.n.sum())
        logdet = np.linalg.slogdet(g.reshape(d, d) + epsilon * np.eye(d))[1] + (n - d) * np.log(epsilon)
        return pd.DataFrame({key: pdf.k[:1], "n": [n], "volume": [logdet]})

    parts = known.join(means, "k").select("k", "v", "mean").mapInArrow(gram, f"k {field.simpleString()}, n long, g binary")
    return parts.groupBy("k").applyInPandas(volume, f"{key} {field.simpleString()}, n long, volume double")


def moments(df: DataFrame, vector: str, y: str, group: str | None = None) -> dict[int, tuple[float, np.ndarray, np.ndarray, float, float]]:
    """By group: n, sums and cross-products of (x, y). The driver gets d x d numbers a group, never rows."""
    key = F.col(group).cast("int") if group else F.lit(0)

    def part(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            g, x = np.array(b.column(0).to_pylist()), np.array(b.column(1).to_pylist(), float)
            z = np.c_[x, np.array(b.column(2).to_pylist(), float), np.ones(len(x))]
            for k in np.unique(g):
                own = z[g == k]
                sums[int(k)] = sums.get(int(k), 0.0) + own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["g", "s"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": pdf.g[:1], "s": [sum(np.frombuffer(x) for x in pdf.s).tobytes()]})

    rows = df.where(F.col(vector).isNotNull() & F.col(y).isNotNull()).select(key, vector, F.col(y).cast("double"))
    out = {}
    for r in rows.mapInArrow(part, "g int, s binary").groupBy("g").applyInPandas(merge, "g int, s binary").collect():
        s = np.frombuffer(r["s"])
        out[r["g"]] = s.reshape(int(np.sqrt(len(s))), -1)
    return out


def _solve(s: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Ridge on standardised columns (a constant column keeps scale 1), in terms of the raw columns."""
    d, n = len(s) - 2, s[-1, -1]
    mean = s[-1, :d] / n
    cov = s[:d, :d] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov) / n, 0))
    scale[scale < 1e-12] = 1.0
    my = s[-1, d] / n
    xy = s[:d, d] - n * mean * my
    w = np.linalg.solve(cov / np.outer(scale, scale) + alpha * np.eye(d), xy / scale) / scale
    return w, float(my - w @ mean)


def _loss(s: np.ndarray, w: np.ndarray, b: float) -> float:
    """Sum of squared errors from the moments."""
    v = np.append(w, [-1.0, b])
    return float(v @ s @ v)


def ridge(df: DataFrame, vector: str, y: str, key: str, k: int = 5, seed: int = 0, alphas: tuple[float, ...] = ALPHAS) -> tuple[np.ndarray, float, float]:
    """Weights, intercept and alpha; alpha has the least cross-validated error, the first one on ties. One pass over the data."""
    parts = moments(folds(df, key, k, seed), vector, y, "fold")
    whole = sum(parts.values())
    best, chosen = np.inf, alphas[0]
    for a in alphas:
        loss = sum(_loss(s, *_solve(whole - s, a)) for s in parts.values())
        if loss < best - 1e-12:
            best, chosen = loss, a
    return *_solve(whole, chosen), chosen


def predict(df: DataFrame, vector: str, w: np.ndarray, b: float, name: str = "predicted") -> DataFrame:
    """A dot product in the engine."""
    weights = F.array(*(F.lit(float(x)) for x in w))
    return df.withColumn(name, F.aggregate(F.zip_with(vector, weights, lambda x, y: x * y), F.lit(float(b)), lambda a, x: a + x))


def out_of_fold(df: DataFrame, vector: str, y: str, key: str, k: int = 5, seed: int = 0, alpha: float = 1.0) -> DataFrame:
    """df with fold and predicted; each row is predicted by the fit on the other folds."""
    dealt = folds(df, key, k, seed)
    parts = moments(dealt, vector, y, "fold")
    whole, out = sum(parts.values()), None
    for f in range(k):
        own = predict(dealt.where(F.col("fold") == f), vector, *_solve(whole - parts.get(f, 0.0), alpha))
        out = own if out is None else out.unionByName(own)
    return out


def logistic(df: DataFrame, vector: str, label: str, c: float = 1.0, steps: int = 25) -> tuple[np.ndarray, float]:
    """Newton steps for the L2-penalised logistic loss; each step is one aggregate of gradients and curvature."""
    d = len(df.select(vector).where(F.col(vector).isNotNull()).first()[0])
    theta = np.zeros(d + 1)
    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(vector, F.col(label).cast("double"))
    for _ in range(steps):
        now = theta.copy()

        def part(batches, now=now):
            g, h = np.zeros(d + 1), np.zeros((d + 1, d + 1))
            for b in batches:
                if b.num_rows:
                    x = np.c_[np.array(b.column(0).to_pylist(), float), np.ones(b.num_rows)]
                    y = np.array(b.column(1).to_pylist(), float)
                    p = 1 / (1 + np.exp(-np.clip(x @ now, -40, 40)))
                    g += x.T @ (p - y)
                    h += (x * (p * (1 - p))[:, None]).T @ x
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([g.tobytes()], pa.binary()), pa.array([h.tobytes()], pa.binary())], names=["k", "g", "h"])

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            add = lambda c: sum(np.frombuffer(x) for x in c).tobytes()
            return pd.DataFrame({"k": [0], "g": [add(pdf.g)], "h": [add(pdf.h)]})

        r = rows.mapInArrow(part, "k int, g binary, h binary").groupBy("k").applyInPandas(merge, "k int, g binary, h binary").first()
        penalty = np.append(np.ones(d), 0.0) / c
        g, h = np.frombuffer(r["g"]) + penalty * theta, np.frombuffer(r["h"]).reshape(d + 1, d + 1) + np.diag(penalty + 1e-9)
        move = np.linalg.solve(h, g)
        theta = theta - move
        if np.abs(move).max() < 1e-8:
            break
    return theta[:-1], float(theta[-1])
