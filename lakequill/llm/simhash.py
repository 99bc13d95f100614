"""SimHash near-duplicates: tiled exact comparison of fingerprints with numpy exclusive-or and bit counts.

Texts become fingerprints of `bits` bits; equal fingerprints form one class (a partial aggregate, so that a group of exact
copies costs one row). Classes are laid out in tiles by population count. Every tile meets the tiles whose population counts
lie within the radius; other tile pairs are skipped, as each differing bit changes the population count by one at most. Each tile
is first compared with itself and its groups are noted, so that a pair of tiles only has to tell which of their groups are
linked: it yields a spanning forest of those links, not all pairs of a group, and components of all forests are the groups.

Where a similarity of texts is asked for rather than a radius, fingerprints are those of shingle sets, and only equal sets
form a class. The sets lie in files of the shared folder, and a tile task verifies its candidates on them, nearest first, by
range reads: a link counts once the sets have the similarity, and candidates are passed over only if verified links join them
already. Memory is that of two tiles and a bounded cache of sets, whatever the size of a group.

Defined results: null and empty texts, and texts of white space only, have the fingerprint zero and link like any other;
repeated rows share fingerprint and component; a null doc_id gets a fingerprint, and its component is the smallest doc_id
that is there (null if none is); an empty table gives no rows. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.llm.common import FileWriter, RangeReader, Store, table
from lakequill.llm.components import connected_components, least_members

_LOW = np.uint64(0x0101010101010101)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
#: Classes in a tile; a tile pair is the unit of work.
TILE = 8192
#: Bytes of shingle sets that a task keeps, and shingles that it checks at once.
CACHE, AT_ONCE = 64 << 20, 1 << 20


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of `words` words, A-Z lower-cased; fewer words: the whole sequence; none: empty."""
    found = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not found:
        return np.empty(0, np.uint64)
    joined, digest = memoryview(b" ".join(found)), xxhash.xxh64_intdigest
    ends = list(accumulate(map(len, found), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    return np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[words - 1 :] or ends[-1:], strict=False)], np.uint64)


def _lane(h: np.ndarray, lane: int) -> np.ndarray:
    """Lane 0 is the hash itself; later lanes mix it anew."""
    if not lane:
        return h
    x = h + np.uint64(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority_bits(hashes: list[np.ndarray], lanes: int) -> np.ndarray:
    """(documents, lanes) fingerprints: a bit is 1 if set in over half of a document's hashes.

    Bits are counted eight at a time in the bytes of 64-bit words, over at most 255 hashes before they are unpacked.
    """
    out = np.zeros((len(hashes), lanes), np.uint64)
    full = [i for i, h in enumerate(hashes) if len(h)]
    if not full:
        return out
    sizes = np.array([len(hashes[i]) for i in full])
    all_h, begin = np.concatenate([hashes[i] for i in full]), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    parts = (sizes + 254) // 255
    first = np.concatenate([[0], np.cumsum(parts)[:-1]])
    starts = np.repeat(begin, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    for lane in range(lanes):
        h, value = _lane(all_h, lane), np.zeros(len(full), np.uint64)
        for k in range(8):
            bytes_ = np.add.reduceat((h >> np.uint64(k)) & _LOW, starts).view(np.uint8).reshape(-1, 8)
            counts = np.add.reduceat(bytes_.astype(np.int64), first, axis=0)
            for j in range(8):
                value |= (2 * counts[:, j] > sizes).astype(np.uint64) << np.uint64(8 * j + k)
        out[full, lane] = value
    return out


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a sorted set of shingle hashes."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


_PRINTS = "doc_id long, fp binary, ones int, key binary, file long, at long, n long"


def fingerprints(docs: DataFrame, words: int, bits: int, id_col: str = "doc_id", text_col: str = "text", sets: str | None = None) -> DataFrame:
    """(doc_id, fp, ones, key, file, at, n): fp is big-endian by 64-bit lanes, ones its population count.

    The key is what makes a class: the fingerprint, or with a folder for `sets` the digest of the shingle set, whose members
    then count once and are written to the folder (file and byte offset of the n hashes).
    """
    lanes = bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = FileWriter(sets, "sets") if sets else None
        for b in batches:
            ids, texts, i = b.column(0), b.column(1), 0
            while i < b.num_rows:  # about a million hashes at a time
                held, n, j = [], 0, i
                while j < b.num_rows and n < 1 << 20:
                    h = shingle_hashes(texts[j].as_py(), words)
                    held.append(np.unique(h) if sets else h)
                    n, j = n + len(held[-1]), j + 1
                fps = majority_bits(held, lanes)
                ones = np.bitwise_count(fps).sum(1, dtype=np.int32)
                raw = fps.astype(">u8").tobytes()
                fp = pa.array([raw[k : k + 8 * lanes] for k in range(0, len(raw), 8 * lanes)], pa.binary())
                sizes = np.array([len(h) for h in held], np.int64)
                if out:
                    key = pa.array([set_digest(h) for h in held], pa.binary())
                    file, start, _ = out.write(np.concatenate(held).astype("<u8").tobytes())
                    at = start + 8 * (np.cumsum(sizes) - sizes)
                else:
                    key, file, at = fp, 0, np.zeros(len(held), np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), fp, pa.array(ones, pa.int32()), key, pa.array(np.full(len(held), file)), pa.array(at), pa.array(sizes)], names=[x.split()[0] for x in _PRINTS.split(", ")])
                i = j
        if out:
            out.close()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _PRINTS)


class _Forest:
    """Labels of the members of a tile or a tile pair, and the links that joined them."""

    def __init__(self, label: np.ndarray | int):
        self.label, self.edges = np.arange(label) if isinstance(label, int) else label, []

    def _join(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        if a != b:
            self.edges.append((i, j))
            self.label[self.label == max(a, b)] = min(a, b)

    def link(self, i: int, others: np.ndarray, accept: Callable[[int, np.ndarray], np.ndarray] | None = None, step: int = 4) -> None:
        """Join i with those of others that it is not joined with; with `accept`, only where that is true, asked for the
        first `step` of others and then for ever more of those still apart."""
        while len(others := others[self.label[others] != self.label[i]]):
            if accept is None:
                for k in np.unique(self.label[others], return_index=True)[1]:
                    self._join(i, int(others[k]))
                return
            asked, others = others[:step], others[step:]
            for j in asked[accept(i, asked)]:
                self._join(i, int(j))
            step *= 4


def _dense(lanes: int, radius: int) -> int:
    """So many lanes that unrelated fingerprints, which differ in half their bits, hardly ever come within the radius on them."""
    return next((m for m in range(1, lanes) if 32 * m - 16 * m**0.5 > radius), lanes)


def _walk(forest: _Forest, a: np.ndarray, b: np.ndarray, radius: int, same: bool, screen: tuple[int, int] | None = None, accept: Callable[[int, np.ndarray], np.ndarray] | None = None, more: int = 4) -> list[tuple[int, int]]:
    """Links of the rows of a with those of b within the radius, as far as the forest has not joined them. Rows of b come
    after those of a unless both are one tile; both are sorted by population count. `screen`: lanes that are compared in
    full, and the differing bits allowed on them."""
    shift, step = 0 if same else len(a), 16
    ones_a, ones_b = np.bitwise_count(a).sum(1, dtype=np.int32), np.bitwise_count(b).sum(1, dtype=np.int32)
    dense, limit = screen or (_dense(a.shape[1], radius), radius)
    columns = [np.ascontiguousarray(b[:, k]) for k in range(dense)]
    for i in range(0, len(a), step):
        rows = a[i : i + step]
        lo = int(np.searchsorted(ones_b, ones_a[i] - radius, "left"))
        hi = int(np.searchsorted(ones_b, ones_a[min(i + step, len(a)) - 1] + radius, "right"))
        lo = max(lo, i + 1) if same else lo
        if lo >= hi:
            continue
        far = np.bitwise_count(rows[:, :1] ^ columns[0][None, lo:hi])
        for k in range(1, dense):  # a byte wraps beyond 255 only, which the exact comparison below finds out
            far += np.bitwise_count(rows[:, k : k + 1] ^ columns[k][None, lo:hi])
        x, y = np.nonzero(far <= min(limit, 255))
        if not len(x):
            continue
        y += lo
        keep = forest.label[i + x] != forest.label[y + shift]
        if same:
            keep &= y > x + i
        x, y = x[keep], y[keep]
        if a.shape[1] > 1:
            d = np.bitwise_count(rows[x] ^ b[y]).sum(1, dtype=np.int32)
            x, y, d = x[d <= radius], y[d <= radius], d[d <= radius]
            order = np.lexsort((d, x))
            x, y = x[order], y[order]
        cut = np.searchsorted(x, np.arange(len(rows) + 1))
        for k in range(len(rows)):
            if cut[k] < cut[k + 1]:
                forest.link(i + k, y[cut[k] : cut[k + 1]] + shift, accept, more)
    return forest.edges


def tile_links(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """Spanning links between the rows of a and b (members of one tile if `same`); both are sorted by population count."""
    return _walk(_Forest(len(a) if same else len(a) + len(b)), a, b, radius, same)


class _Sets:
    """Shingle sets by (file, offset, number), the last CACHE bytes of them kept."""

    def __init__(self, folder: str):
        self.reader, self.held, self.bytes = RangeReader(folder, "sets"), {}, 0

    def __getitem__(self, ref: tuple[int, int, int]) -> np.ndarray:
        got = self.held.pop(ref, None)
        if got is None:
            file, at, n = ref
            got = np.frombuffer(self.reader.read(file, at, 8 * n), "<u8")
            self.bytes += got.nbytes
        self.held[ref] = got
        while self.bytes > CACHE and len(self.held) > 1:
            self.bytes -= self.held.pop(next(iter(self.held))).nbytes
        return got

    def similar(self, refs: np.ndarray, i: int, others: np.ndarray, similarity: float) -> np.ndarray:
        """Which of others (row numbers of refs) have the Jaccard similarity with row i."""
        out, mine = np.zeros(len(others), bool), self[tuple(refs[i].tolist())]
        n = refs[others, 2]
        fits = np.nonzero(np.minimum(n, len(mine)) >= similarity * np.maximum(n, len(mine)))[0]
        fits = fits[n[fits] > 0]
        room = np.cumsum(n[fits]) // AT_ONCE
        for part in np.unique(room):
            rows = fits[room == part]
            sets = [self[tuple(refs[j].tolist())] for j in others[rows]]
            every = np.concatenate(sets)
            held = mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every
            common = np.add.reduceat(held, np.cumsum(n[rows]) - n[rows], dtype=np.int64)
            out[rows] = common >= similarity * (n[rows] + len(mine) - common)
        return out


class _Tile:
    """Members of a tile, in the order of their population counts."""

    def __init__(self, raw: bytes, n: int, lanes: int, key_size: int):
        cuts = np.cumsum([0, 8 * lanes * n, key_size * n, 24 * n, 4 * n])
        part = [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        self.fp = np.frombuffer(part[0], "<u8").reshape(n, lanes).astype(np.uint64)
        self.keys = [part[1][k : k + key_size] for k in range(0, key_size * n, key_size)]
        self.refs = np.frombuffer(part[2], "<i8").reshape(n, 3)
        self.label = np.frombuffer(part[3], "<i4").astype(np.int64) if part[3] else None


_TILE = "tile int, file long, n int, hi int"


def tile_numbers(counts: dict[int, int], bits: int, tile: int) -> tuple[list[int], list[int]]:
    """First tile of each population count, and the number of tiles over which its members are dealt out."""
    first, split, at, room = [0] * (bits + 1), [1] * (bits + 1), -1, 0
    for ones in range(bits + 1):
        n = counts.get(ones, 0)
        if n > room or at < 0:  # a new tile, or several for a frequent count
            split[ones] = max(1, -(-n // tile))
            first[ones], at = at + 1, at + split[ones]
            room = tile - n if split[ones] == 1 else 0
        else:
            first[ones], room = at, room - n
    return first, split


def similar_classes(classes: DataFrame, store: Store, bits: int, radius: int, tile: int = TILE, similarity: float | None = None, sets: str | None = None, more: int = 4) -> DataFrame:
    """Edges (a, b) of keys that span the groups of classes whose fingerprints differ in `radius` bits at most, and whose
    shingle sets have the similarity, if one is given.

    classes: (key, fp, ones, file, at, n), distinct keys of one length. The driver gets a histogram of `ones` only, which has
    bits + 1 rows at most. Tiles are files of the shared folder; tasks get pairs of file names, in as many partitions as the
    number of pairs asks for.
    """
    lanes, key_size = bits // 64, 16 if similarity else bits // 8
    counts = {r["ones"]: r["n"] for r in classes.groupBy("ones").agg(F.count("*").alias("n")).collect()}
    first, split = tile_numbers(counts, bits, tile)
    look = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at + 1)
    last = [first[o] + split[o] - 1 for o in (min(bits, hi + radius) for hi in range(bits + 1))]
    share = F.pmod(F.xxhash64("key"), look(split, F.col("ones"))).cast("int")
    placed = classes.select((look(first, F.col("ones")) + share).alias("tile"), "key", "fp", "ones", "file", "at", "n")
    folder, screen = store.path("tiles"), None
    if similarity and lanes > 2:
        screen = 2, radius_for(similarity, 128)

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("ones", "ascending"), ("key", "ascending")])
        fps = np.frombuffer(b"".join(t.column("fp").to_pylist()), ">u8").astype("<u8")
        refs = np.stack([t.column(c).to_numpy() for c in ("file", "at", "n")], 1).astype("<i8")
        out = FileWriter(folder, "tile")
        file, _, _ = out.write(fps.tobytes() + b"".join(t.column("key").to_pylist()) + refs.tobytes())
        out.close()
        return pa.table({"tile": t.column("tile").slice(0, 1).combine_chunks(), "file": pa.array([file]), "n": pa.array([t.num_rows], pa.int32()), "hi": t.column("ones").slice(t.num_rows - 1).combine_chunks()})

    tiles = store.save(placed.groupBy("tile").applyInArrow(pack, _TILE), "tiles")
    n_tiles, n_pairs = tiles.agg(F.count("*"), F.coalesce(F.sum(look(last, F.col("hi")) - F.col("tile")), F.lit(0))).first()

    def accept(refs: np.ndarray, held: _Sets) -> Callable[[int, np.ndarray], np.ndarray] | None:
        return (lambda i, others: held.similar(refs, i, others, similarity)) if similarity else None

    def links(keys: list[bytes], edges: list[tuple[int, int]], *first_row: object) -> pa.RecordBatch:
        columns = [[x] + [None] * len(edges) for x in first_row]
        a, b = [keys[i] for i, _ in edges], [keys[j] for _, j in edges]
        gap = [None] if first_row else []
        arrays = [pa.array(gap + a, pa.binary()), pa.array(gap + b, pa.binary())]
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=False)), *arrays], names=[*(x.split()[0] for x in _TILE.split(", "))][: len(columns)] + ["a", "b"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, out, held = RangeReader(folder, "tile"), FileWriter(folder, "tile"), _Sets(sets) if sets else None
        for batch in batches:
            for row in batch.to_pylist():
                raw = reader.whole(row["file"])
                t = _Tile(raw, row["n"], lanes, key_size)
                forest = _Forest(len(t.keys))
                _walk(forest, t.fp, t.fp, radius, True, screen, accept(t.refs, held), more)
                out.close()  # a file for each tile
                file, _, _ = out.write(raw + forest.label.astype("<i4").tobytes())
                yield links(t.keys, forest.edges, row["tile"], file, row["n"], row["hi"])
        out.close()

    own = store.save(tiles.repartitionByRange(max(1, n_tiles), "tile").mapInArrow(within, f"{_TILE}, a binary, b binary"), "within")
    grouped = own.where("file IS NOT NULL").select("tile", "file", "n", "hi")
    beyond = grouped.withColumn("last", look(last, F.col("hi"))).where("last > tile")
    left = beyond.select("tile", F.col("file").alias("file_a"), F.col("n").alias("n_a"), F.explode(F.sequence(F.col("tile") + 1, F.col("last"))).alias("other"))
    pairs = left.join(grouped.select(F.col("tile").alias("other"), F.col("file").alias("file_b"), F.col("n").alias("n_b")), "other")
    parts = max(1, min(n_pairs, max(4 * store.spark.sparkContext.defaultParallelism, n_pairs // 16)))

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, a_file, a = RangeReader(folder, "tile"), _Sets(sets) if sets else None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["file_a"] != a_file:
                    a_file, a = row["file_a"], _Tile(reader.whole(row["file_a"]), row["n_a"], lanes, key_size)
                b = _Tile(reader.whole(row["file_b"]), row["n_b"], lanes, key_size)
                forest = _Forest(np.concatenate([a.label, b.label + len(a.label)]))
                _walk(forest, a.fp, b.fp, radius, False, screen, accept(np.concatenate([a.refs, b.refs]), held), more)
                yield links(a.keys + b.keys, forest.edges)

    across = pairs.select("tile", "other", "file_a", "n_a", "file_b", "n_b").repartitionByRange(parts, "tile", "other").sortWithinPartitions("tile", "other")
    return own.where("a IS NOT NULL").select("a", "b").union(across.mapInArrow(between, "a binary, b binary"))


def disagreement(common: int, own_a: int, own_b: int) -> float:
    """Probability that a bit differs between majorities over sets with so many common and own random hashes."""
    chance = lambda n: [math.comb(n, k) / 2**n for k in range(n + 1)]
    over = lambda k, own: sum(p for j, p in enumerate(chance(own)) if 2 * (k + j) > common + own)
    either = [(p, over(k, own_a), over(k, own_b)) for k, p in enumerate(chance(common))]
    return sum(p * (x * (1 - y) + y * (1 - x)) for p, x, y in either)


def radius_for(similarity: float, bits: int, deviations: float = 5) -> int:
    """Differing bits within which pairs of sets of this Jaccard similarity lie, but for about one in a million at any size.

    Large sets follow the angle of cosine 2s / (1 + s); small sets differ in more bits, so those are counted out.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for common in range(1, 49):
        own = int(common / similarity - common + 1e-9)
        share = max([share, *(disagreement(common, k, own - k) for k in range(own // 2 + 1))])
    return min(bits, math.ceil(bits * share + deviations * math.sqrt(bits * share * (1 - share))))


def group(docs: DataFrame, store: Store, words: int = 5, bits: int = 512, radius: int | None = None, similarity: float = 0.8, tile: int = TILE, more: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    With a radius, fingerprints link at that many differing bits. Without, the radius follows from the similarity, and links
    are verified on the shingle sets: of each row first the `more` nearest candidates, then the others it is not yet joined with.
    """
    verify, radius = radius is None, radius_for(similarity, bits) if radius is None else radius
    sets = store.path("sets") if verify else None
    prints = store.save(fingerprints(docs, words, bits, id_col, text_col, sets), "prints")
    where = F.min(F.struct("file", "at", "n")).alias("set")
    classes = prints.groupBy("key", "fp", "ones").agg(F.min("doc_id").alias("least"), where).select("key", "fp", "ones", "least", "set.*")
    classes = store.save(classes, "classes")
    links = similar_classes(classes.drop("least"), store, bits, radius, tile, similarity if verify else None, sets, more)
    roots = connected_components(links, store)
    linked = classes.select(F.col("key").alias("node"), F.col("least").alias("value")).join(roots, "node")
    grouped = store.save(least_members(linked), "grouped")
    by_class = classes.select("key", "least").join(grouped.select(F.col("node").alias("key"), F.col("least").alias("joint")), "key", "left")
    by_class = by_class.select("key", F.when(F.col("joint").isNull(), F.col("least")).otherwise(F.col("joint")).alias("component_id"))
    return prints.select("doc_id", "fp", "key").join(by_class, "key").select("doc_id", "fp", "component_id")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-word shingles, 64 bits, links at 4 or fewer differing bits."""
    found = group(table(spark, sf_dir, "documents"), Store(spark, "simhash"), words=4, bits=64, radius=4)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops all but the smallest doc_id of each group of texts whose five-word shingles are 0.8 similar or more.

    Rows without a doc_id stay; rows that repeat a doc_id share its fate.
    """
    drop = group(docs, Store(spark, "simhash-stage"), words=5).where("doc_id <> component_id").select(F.col("doc_id").alias("__drop"))
    return docs.join(drop, F.col("doc_id") == F.col("__drop"), "left_anti")
