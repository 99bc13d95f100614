"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated, rounded to a grid and split into blocks of few dimensions. Two vectors of cosine c lie at squared
distance 2 - 2c at most (on the grid a little more, which is added), so that in some block they lie within its share of it, a
budget in proportion to the block's dimensions: joining every block within its budget finds every pair. Each block has an
index of its own, a k-d tree over that block's dimensions; its leaves are files of the shared folder, cut into tiles of
bounded size. Two leaves of a block meet only if the boxes around their members come within the budget, and a tile pair is
range-joined by their distances in that block. A candidate that is within the distance over all blocks belongs to the block
where it is nearest for its dimensions, and is verified there, and only there, by the cosine in double precision; distances
on the grid are whole numbers, so that every task sees the same. Equal vectors form one class, a row with its count. A tile
pair returns sums of links and a spanning forest, never all pairs of a group.

Trees are fitted on `sample` classes of a length at most, taken in the order of their hash, and on SAMPLE_BYTES; all vectors are
placed. A tree has MAX_LEAVES leaves at most, so the driver holds boxes of MAX_LEAVES leaves in each block, whatever the size
of the table; lengths that fewer than `tile` classes have need no tree.

Defined results: vectors that are null, empty, zero, or hold nulls or non-finite components link with nothing; vectors of
other lengths aren't compared; rows that repeat a vec_id are vectors of their own; a vector without vec_id takes part and is
not kept; an empty table gives no rows. Labels and other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.llm.common import FileWriter, RangeReader, Store, table
from lakequill.llm.components import connected_components, least_members
from lakequill.llm.simhash import _Forest

COSINE, BLOCKS, TILE, SAMPLE, MAX_LEAVES, SEED = 0.9, 8, 2048, 20_000, 4096, 11
#: Bytes of vectors that a tree is fitted on, and that a task keeps.
SAMPLE_BYTES, CACHE = 64 << 20, 64 << 20
#: Steps of the grid on either side of zero; coordinates beyond it are clipped, which brings vectors no further apart.
STEPS = 127


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision, without overflow."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED).normal(size=(dim, dim)))[0]


def block_edges(dim: int, blocks: int) -> np.ndarray:
    return np.linspace(0, dim, min(blocks, dim) + 1).astype(int)


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, key, dim, x): x is the vector in its own type, key its digest; null for vectors that link with nothing."""
    single = rows.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, dims, raw = [], [], []
            for v in b.column(1):
                x = None
                if v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(kind)
                    x = x if np.isfinite(x).all() and x.any() else None
                keys.append(None if x is None else hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                dims.append(None if x is None else len(x))
                raw.append(None if x is None else x.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], names=["vec_id", "key", "dim", "x"])

    embedding = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    return rows.select(F.col("vec_id").cast("long"), embedding).mapInArrow(run, "vec_id long, key binary, dim int, x binary")


def grid_step(dim: int) -> float:
    """Four deviations of a random unit vector's coordinate are on the grid."""
    return min(1.0, 4 / dim**0.5) / STEPS


def on_grid(x: np.ndarray) -> np.ndarray:
    """Unit vectors rotated and rounded to whole steps."""
    return np.clip(np.rint(x @ rotation(x.shape[1]) / grid_step(x.shape[1])), -STEPS, STEPS).astype(np.int8)


def most_apart(dim: int, cosine: float) -> float:
    """Squared distance in steps within which vectors of this cosine lie on the grid: rounding moves either by half a step in each dimension."""
    return ((max(0.0, 2 - 2 * cosine) ** 0.5 + 1e-9) / grid_step(dim) + dim**0.5) ** 2


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a and b, exact whole numbers."""
    kind = np.float32 if a.shape[1] * 4 * STEPS * STEPS < 1 << 24 else np.float64
    a, b = a.astype(kind), b.astype(kind)
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)


class Tree:
    """k-d tree over the dimensions of a block: inner nodes as (dimension, cut), leaves numbered from the left.

    It cuts the widest dimensions only, so few of them that each is cut into five or more: leaves that are cut once in every
    dimension are all wider than the budget, and none would be skipped.
    """

    def __init__(self, sample: np.ndarray, leaves: int):
        self.depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        self.dims, self.cuts = np.zeros((1 << self.depth) - 1, int), np.zeros((1 << self.depth) - 1)
        self.used = np.argsort(-sample.var(0), kind="stable")[: max(1, int(self.depth / np.log2(5)))]
        self._split(0, sample)

    def _split(self, node: int, x: np.ndarray) -> None:
        if node >= len(self.dims):
            return
        d = int(self.used[x[:, self.used].var(0).argmax()]) if len(x) else 0
        cut = float(np.median(x[:, d])) if len(x) else 0.0
        self.dims[node], self.cuts[node] = d, cut
        self._split(2 * node + 1, x[x[:, d] <= cut])
        self._split(2 * node + 2, x[x[:, d] > cut])

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.dims[node]] > self.cuts[node])
        return node - len(self.dims)


def near_boxes(low: np.ndarray, high: np.ndarray, all_low: np.ndarray, all_high: np.ndarray, budget: float) -> np.ndarray:
    """Which boxes come within the budget of one box."""
    gap = np.maximum(0, np.maximum(all_low - high, low - all_high))
    return (gap * gap).sum(1) <= budget


class _Vectors:
    """Records of classes by (file, offset): key, count and unit vector; the last CACHE bytes of them are kept."""

    def __init__(self, folder: str, kind: type):
        self.reader, self.kind, self.held, self.bytes = RangeReader(folder, "vectors"), kind, {}, 0

    def rows(self, refs: np.ndarray, dim: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        size, out = 24 + dim * np.dtype(self.kind).itemsize, []
        for ref in map(tuple, refs.tolist()):
            got = self.held.pop(ref, None)
            if got is None:
                got = self.reader.read(*ref, size)
                self.bytes += size
            self.held[ref] = got
            out.append(got)
        while self.bytes > CACHE:
            self.bytes -= len(self.held.pop(next(iter(self.held))))
        n = np.frombuffer(b"".join(x[16:24] for x in out), "<i8")
        return [x[:16] for x in out], n, unit(np.frombuffer(b"".join(x[24:] for x in out), self.kind).reshape(-1, dim))


class _TilePair:
    """The links of two tiles (of one with itself if b is None) that belong to a block."""

    def __init__(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray] | None, block: int, blocks: int, cosine: float, vectors: _Vectors):
        (self.a, self.refs_a), (self.b, self.refs_b) = a, b or a
        self.same, self.block, self.cosine, self.vectors, self.dim = b is None, block, cosine, vectors, self.a.shape[1]
        self.edges = block_edges(self.dim, blocks)
        self.most = most_apart(self.dim, cosine)
        self.budget = self.most * (self.edges[block + 1] - self.edges[block]) / self.dim
        self.sums: dict[bytes, int] = {}
        self.found: list[tuple[bytes, bytes]] = []
        self.candidates = 0

    def _own_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether row by row a and b belong to this block: within the distance over all blocks, and nearest here."""
        d = np.add.reduceat(np.square(a.astype(np.int32) - b), self.edges[:-1], axis=1, dtype=np.float64)
        return (d.sum(1) <= self.most) & ((d / np.diff(self.edges)).argmin(1) == self.block)

    def _by_block(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all rows of a with all of b: distances over all blocks, and the block in which a pair is nearest for its dimensions."""
        total, best, at = 0.0, None, None
        for k, (lo, hi) in enumerate(zip(self.edges, self.edges[1:], strict=False)):
            d = distances(a[:, lo:hi], b[:, lo:hi]).astype(np.float64)
            total, d = total + d, d / (hi - lo)
            if best is None:
                best, at = d, np.zeros(d.shape, np.int32)
            else:
                at[d < best] = k
                best = np.minimum(best, d)
        return total, at

    def run(self, step: int = 256) -> None:
        lo, hi = self.edges[self.block], self.edges[self.block + 1]
        right = np.ascontiguousarray(self.b[:, lo:hi])
        n_a = len(self.a)
        forest, shift = _Forest(n_a if self.same else n_a + len(self.b)), 0 if self.same else n_a
        keys: dict[int, bytes] = {}
        for i in range(0, n_a, step):
            near = distances(self.a[i : i + step, lo:hi], right) <= self.budget
            if self.same:
                near &= np.arange(len(self.b))[None, :] > i + np.arange(len(near))[:, None]
            found = int(np.count_nonzero(near))
            self.candidates += found
            if 16 * found < near.size:
                x, y = np.nonzero(near)
                near[x, y] = self._own_pairs(self.a[i + x], self.b[y])
            else:
                total, block = self._by_block(self.a[i : i + step], self.b)
                near &= (block == self.block) & (total <= self.most)
            rows, cols = np.nonzero(near.any(1))[0], np.nonzero(near.any(0))[0]
            if not len(rows):
                continue
            (key_a, n_of_a, x), (key_b, n_of_b, y) = self.vectors.rows(self.refs_a[i + rows], self.dim), self.vectors.rows(self.refs_b[cols], self.dim)
            hit = near[np.ix_(rows, cols)] & (x @ y.T >= self.cosine)
            for k, n in zip(key_a + key_b, np.concatenate([hit @ n_of_b, n_of_a @ hit]).tolist(), strict=True):
                if n:
                    self.sums[k] = self.sums.get(k, 0) + n
            left, other = i + rows, cols + shift
            keys |= dict(zip(left.tolist(), key_a, strict=True)) | dict(zip(other.tolist(), key_b, strict=True))
            for k, h in zip(left.tolist(), hit, strict=True):
                if h.any():
                    forest.link(k, other[h])
        self.found = [(keys[i], keys[j]) for i, j in forest.edges]


_TILE = "dim int, block int, leaf int, part int, file long, n int, low binary, high binary"


def links(classes: DataFrame, store: Store, single: bool, cosine: float, blocks: int, tile: int, sample: int) -> DataFrame:
    """(key, other, links): sums of linked weights (other is null), and spanning links between classes."""
    kind = np.float32 if single else np.float64
    trees: dict[int, list[Tree]] = {}
    for dim, n in classes.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") > tile).collect():
        rows = max(1, min(sample, SAMPLE_BYTES // (8 * dim)))
        picked = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("key"), "key").limit(rows).select("x").collect()
        grid = on_grid(unit(np.frombuffer(b"".join(r["x"] for r in picked), kind).reshape(-1, dim))).astype(np.float32)
        edges = block_edges(dim, blocks)
        trees[dim] = [Tree(grid[:, lo:hi], min(MAX_LEAVES, -(-n // tile))) for lo, hi in zip(edges, edges[1:], strict=False)]
    folder = store.path("tiles")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = FileWriter(folder, "vectors")
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                t = b.filter(pa.array(dims == dim))
                xs, n, edges = t.column(3).to_pylist(), t.num_rows, block_edges(dim, blocks)
                raw = b"".join(k + w + x for k, w, x in zip(t.column(0).to_pylist(), np.split(t.column(2).to_numpy().astype("<i8"), n), xs, strict=True) for w in (w.tobytes(),))
                file, start, _ = out.write(raw)
                grid = on_grid(unit(np.frombuffer(b"".join(xs), kind).reshape(n, dim)))
                at = pa.array(start + np.arange(n) * (len(raw) // n))
                whole = pa.array([g.tobytes() for g in grid], pa.binary())
                for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                    leaf = trees[dim][k].leaf(grid[:, lo:hi].astype(np.float32)) if dim in trees else np.zeros(n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(leaf.astype(np.int32)), t.column(0), whole, pa.array(np.full(n, file)), at], names=["dim", "block", "leaf", "key", "grid", "file", "at"])
        out.close()

    placed = classes.select("key", "dim", "n", "x").mapInArrow(place, "dim int, block int, leaf int, key binary, grid binary, file long, at long")
    placed = store.save(placed, "placed")
    # as many rows as there are leaves, and lengths without a tree
    parts = placed.groupBy("dim", "block", "leaf").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    placed = placed.join(parts, ["dim", "block", "leaf"]).withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        one = {c: t.column(c).slice(0, 1).combine_chunks() for c in ("dim", "block", "leaf", "part")}
        dim, block = one["dim"][0].as_py(), one["block"][0].as_py()
        t = t.sort_by("key")
        grid = np.frombuffer(b"".join(t.column("grid").to_pylist()), np.int8).reshape(-1, dim)
        out, (lo, hi) = FileWriter(folder, "tile"), block_edges(dim, blocks)[block : block + 2]
        file, _, _ = out.write(grid.tobytes() + np.stack([t.column(c).to_numpy() for c in ("file", "at")], 1).astype("<i8").tobytes())
        out.close()
        box = [pa.array([f(grid[:, lo:hi], 0).tobytes()], pa.binary()) for f in (np.min, np.max)]
        return pa.table(one | {"file": pa.array([file]), "n": pa.array([t.num_rows], pa.int32()), "low": box[0], "high": box[1]})

    tiles = store.save(placed.groupBy("dim", "block", "leaf", "part").applyInArrow(pack, _TILE), "tiles")
    # boxes of the leaves of trees: MAX_LEAVES rows of each block at most
    boxes: dict[tuple[int, int], dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for r in tiles.where(F.col("dim").isin(list(trees))).select("dim", "block", "leaf", "low", "high").toLocalIterator() if trees else ():
        low, high = (np.frombuffer(r[c], np.int8).astype(np.int32) for c in ("low", "high"))
        held = boxes.setdefault((r["dim"], r["block"]), {})
        was = held.get(r["leaf"])
        held[r["leaf"]] = (low, high) if was is None else (np.minimum(was[0], low), np.maximum(was[1], high))
    index = {k: (np.array(sorted(v)), np.stack([v[x][0] for x in sorted(v)]), np.stack([v[x][1] for x in sorted(v)])) for k, v in boxes.items()}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each tile the leaves of its block, from its own on, that come within the budget of its box."""
        for b in batches:
            at, other = [], []
            for i, r in enumerate(b.to_pylist()):
                near, edges = np.array([r["leaf"]]), block_edges(r["dim"], blocks)
                if (r["dim"], r["block"]) in index:
                    leaves, low, high = index[r["dim"], r["block"]]
                    own = (np.frombuffer(r[c], np.int8).astype(np.int32) for c in ("low", "high"))
                    budget = most_apart(r["dim"], cosine) * (edges[r["block"] + 1] - edges[r["block"]]) / r["dim"]
                    near = leaves[near_boxes(*own, low, high, budget) & (leaves >= r["leaf"])]
                at += [i] * len(near)
                other += near.tolist()
            t = b.select(["dim", "block", "leaf", "part", "file", "n"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(other, pa.int32())], names=[*t.schema.names, "other"])

    met = tiles.mapInArrow(meet, "dim int, block int, leaf int, part int, file long, n int, other int")
    right = tiles.select("dim", "block", F.col("leaf").alias("other"), F.col("part").alias("other_part"), F.col("file").alias("file_b"), F.col("n").alias("n_b"))
    pairs = met.join(right, ["dim", "block", "other"]).where("leaf < other OR part <= other_part")
    pairs = store.save(pairs.select("dim", "block", "file", "n", "file_b", "n_b"), "pairs")
    work = pairs.agg(F.coalesce(F.sum(F.col("n").cast("double") * F.col("n_b")), F.lit(0.0))).first()[0]
    tasks = int(max(1, min(pairs.count(), max(4 * store.spark.sparkContext.defaultParallelism, work / (64 * TILE * TILE)))))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, vectors, at, held = RangeReader(folder, "tile"), _Vectors(folder, kind), None, None

        def read(file: int, n: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
            raw = reader.whole(file)
            return np.frombuffer(raw[: n * dim], np.int8).reshape(n, dim), np.frombuffer(raw[n * dim :], "<i8").reshape(n, 2)

        for b in batches:
            for r in b.to_pylist():
                if at != r["file"]:
                    at, held = r["file"], read(r["file"], r["n"], r["dim"])
                pair = _TilePair(held, None if r["file"] == r["file_b"] else read(r["file_b"], r["n_b"], r["dim"]), r["block"], blocks, cosine, vectors)
                pair.run()
                columns = [[*pair.sums, *(x for x, _ in pair.found)], [*([None] * len(pair.sums)), *(y for _, y in pair.found)], [*pair.sums.values(), *([0] * len(pair.found))]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["key", "other", "links"])

    dealt = pairs.repartitionByRange(tasks, "file", "file_b").sortWithinPartitions("file", "file_b")
    return dealt.mapInArrow(compare, "key binary, other binary, links long")


def group(rows: DataFrame, store: Store, cosine: float = COSINE, blocks: int = BLOCKS, tile: int = TILE, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of a table with vec_id and embedding."""
    single = rows.schema["embedding"].dataType.simpleString() == "array<float>"
    every = store.save(vectors(rows), "vectors")
    classes = store.save(every.where("key IS NOT NULL").groupBy("key", "dim").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("x").alias("x")), "classes")
    found = store.save(links(classes, store, single, cosine, blocks, tile, sample), "links")
    roots = connected_components(found.where("other IS NOT NULL").select(F.col("key").alias("a"), F.col("other").alias("b")), store)
    sums = found.where("other IS NULL").groupBy("key").agg(F.sum("links").alias("links"))
    linked = classes.select(F.col("key").alias("node"), F.col("least").alias("value")).join(roots, "node")
    joint = store.save(least_members(linked), "grouped").select(F.col("node").alias("key"), F.col("least").alias("joint"))
    by_class = classes.select("key", "n", "least").join(sums, "key", "left").join(joint, "key", "left")
    component = F.when(F.col("joint").isNull(), F.col("least")).otherwise(F.col("joint"))
    by_class = by_class.select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), component.alias("component_id"))
    out = every.select("vec_id", "key").join(by_class, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors at cosine 0.9 or more."""
    return group(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), Store(spark, "vectors"))
