"""Suffix-array dedup of byte strings by column-wise multi-document construction.

A collection's Burrows-Wheeler transform is built one column at a time: each round inserts one symbol of every member, found
by the last-to-first mapping of the transform so far, and updates the common prefixes of the rows it touches; once the columns
outgrow `spill_bytes`, each is read from and written to a sequential file of the shared folder, one at a time. Rows that share
`length` bytes with the row before are repeats; the earliest place of such a group stays, the others are removed.

To work on many machines, the collection is dealt out by content: every window of `length` bytes goes by the least hash of
the `anchor`-byte strings in it, so equal windows meet whatever document they come from. Neighbouring windows with one anchor
travel as one piece; equal pieces are settled by their hash (the first stays, later ones repeat all of it), and only pieces
that share an anchor with a different piece enter the construction. An anchor with more than `hot` pieces is dealt out anew,
window by window, and a task settles equal windows among its own before it deals them out: a passage that very many texts hold
between other neighbours comes to its bucket once for each batch of windows. So a bucket has `bucket` bytes and the pieces of
one anchor at most. Texts that are wholly equal to an earlier one are settled before all this.

Pieces are taken for equal by 108 bits of their hashes; windows that meet in a construction are compared byte by byte.

Defined results: null and empty texts have no bytes; texts shorter than `length` lose nothing; a null doc_id comes after all
others; rows that repeat doc_id and text are one document and share its result, other texts under one doc_id are ordered by
checksum; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.llm.common import Store, table

LENGTH, ANCHOR, BUCKET, SPILL = 100, 32, 1 << 19, 256 << 20
#: Pieces of one anchor that go to a bucket together: as many as fill one, at 168 bytes.
HOT = BUCKET // 168
#: Shares in which the copies of one text look up their first.
SALTS = 16
#: Windows of hot anchors that a task settles among themselves before they are dealt out.
WINDOWS = 50_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Positions inside a slice of text fit the low bits of a packed hash.
_LOW_BITS = 20
_SLICE = 1 << 19
#: Bytes of short texts that are hashed together; with a slice they fit the low bits.
_TOGETHER = 1 << 16


def _double(h: np.ndarray, step: int) -> np.ndarray:
    """Hashes of strings twice as long."""
    x = h[:-step] * _M1 + h[step:]
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def _spread(h: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over every `width` neighbours."""
    step, out = 1, h
    while 2 * step <= width:
        out = f(out[:-step], out[step:])
        step *= 2
    return f(out[: len(out) - (width - step)], out[width - step :]) if width > step else out


def runs(data: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring windows with one anchor: anchor hash, piece hash, first window, number of windows. data: uint8, of texts of these
    sizes one behind another (one text if none are given), none of whose windows reach into the next."""
    sizes = np.array([len(data)]) if sizes is None else sizes
    windows = np.maximum(sizes - length + 1, 0)
    if not windows.sum():
        return (np.empty(0, np.int64),) * 4
    h, step = (data.astype(np.uint64) + np.uint64(1)) * _M2, 1
    while step < anchor:
        h, step = _double(h, step), 2 * step
    wide = _double(h, anchor)  # twice the anchor's length, for the piece hash
    low = np.uint64((1 << _LOW_BITS) - 1)
    packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    least = _spread(packed, length - anchor + 1, np.minimum)
    inside = np.arange(windows.sum()) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(windows) - windows), windows)
    own = least[inside]
    head = np.nonzero(np.concatenate([[True], own[1:] != own[:-1]]))[0]
    first, count = inside[head], np.diff(np.append(head, len(own)))
    end = first + count + length - 1 - 2 * anchor
    piece = wide[first] * _M1 + wide[np.minimum(first + 52, end)]
    piece = (piece ^ (piece >> np.uint64(31))) * _M2 + wide[end] + count.astype(np.uint64)
    piece = (piece ^ (piece >> np.uint64(30))) * _M1
    return (least[first] >> np.uint64(_LOW_BITS)).astype(np.int64), piece.view(np.int64), first, count


def _ranks(data: np.ndarray, gram: int) -> tuple[np.ndarray, int]:
    """The rank of the `gram` bytes that begin at each byte, among all there are, and how many differ; 1, 4 or 20 bytes, zeros behind the end."""
    wide = np.concatenate([data, np.zeros(gram, np.uint8)]).astype(np.uint64)

    def packed(k: int) -> np.ndarray:
        x = wide
        for step in (1, 2, 4):
            if step < k:
                x = x[:-step] << np.uint64(8 * step) | x[step:]
        return x

    def ranked(x: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
        """Of values below 2 ** bits."""
        own = np.uint64(max(len(x) - 1, 1).bit_length())
        if bits + int(own) <= 64:  # sorted with their places, which is faster by far
            y = np.sort(x << own | np.arange(len(x), dtype=np.uint64))
            order, y = (y & ((np.uint64(1) << own) - np.uint64(1))).astype(np.int64), y >> own
        else:
            order = np.argsort(x)
            y = x[order]
        number = np.cumsum(np.concatenate([np.zeros(min(len(y), 1), bool), y[1:] != y[:-1]]))
        out = np.empty(len(x), np.uint64)
        out[order] = number
        return out, int(number[-1]) + 1 if len(y) else 0

    if gram < 20:
        return ranked(packed(gram)[: len(data)], 8 * gram)
    # ranks of 4, 8, 16, then 20 bytes: pairs of ranks of shorter strings, which are in the order of the longer
    four = ranked(packed(4), 32)[0]
    wide_rank = len(four).bit_length()
    pair = lambda x, y: ranked(x[: len(y)] << np.uint64(wide_rank) | y, 2 * wide_rank)
    eight = pair(four, four[4:])[0]
    sixteen = pair(eight, eight[8:])[0]
    return pair(sixteen, four[16 : 16 + len(data)])


def _stable_order(a: np.ndarray) -> np.ndarray:
    """As a stable argsort; wide values are sorted with their places, which is faster by far."""
    if a.dtype.itemsize < 4 or len(a) >= 1 << 32:
        return np.argsort(a, kind="stable")
    return (np.sort(a.astype(np.uint64) << np.uint64(32) | np.arange(len(a), dtype=np.uint64)) & np.uint64((1 << 32) - 1)).astype(np.int64)


class Construction:
    """Transform and common prefixes of a collection, built column by column from the right.

    A symbol is `gram` bytes, given by its rank among those of the collection; each piece takes part once for each of its
    `gram` phases, so that every byte position starts one suffix and the rounds are fewer by that factor.
    """

    def __init__(self, pieces: list[bytes], length: int = LENGTH, spill_bytes: int = SPILL, folder: str | None = None):
        """folder: one that all executors share, for the columns' files; a temporary one of this machine if none is given."""
        with tempfile.TemporaryDirectory(prefix="columns-") if folder is None else _Folder(folder) as own:
            self._columns = _Columns(own, spill_bytes)
            self._build(pieces, length)

    def _build(self, pieces: list[bytes], length: int) -> None:
        gram = 20 if length % 20 == 0 and length > 20 else 4 if length % 4 == 0 else 1
        whole_symbols = length // gram
        lengths = np.array([len(p) for p in pieces])
        text, symbols = _ranks(np.frombuffer(b"".join(pieces), np.uint8), gram)
        kind = np.uint8 if symbols < 255 else np.uint16 if symbols < 65535 else np.uint32
        text = (text + 1).astype(kind)  # 0 ends a member
        piece, phase = np.repeat(np.arange(len(pieces)), gram), np.tile(np.arange(gram), len(pieces))
        sizes = np.maximum(0, (lengths[piece] - phase) // gram)
        begin, n = np.concatenate([[0], np.cumsum(lengths)[:-1]])[piece] + phase, len(piece)
        at_symbol = lambda rows, k: text[begin[rows] + gram * k]
        keep, read = self._columns.keep, self._columns.read
        symbol, active = np.zeros(n, kind), np.nonzero(sizes > 0)[0]
        symbol[active] = at_symbol(active, sizes[active] - 1)
        at, column = active, 0
        for name, a in (("symbol", symbol), ("lcp", np.zeros(n, np.uint8)), ("member", np.arange(n, dtype=np.int32)), ("depth", np.zeros(n, np.uint8))):
            keep(name, a, column)
        while len(active):
            column += 1
            symbol = read("symbol")
            order = _stable_order(symbol)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            mine, c = rank[at], symbol[at]
            new = mine + (n - int(np.count_nonzero(symbol == 0)))
            old_rows = np.ones(len(symbol) + len(at), bool)
            old_rows[new] = False
            more = sizes[active] > column
            ahead = np.zeros(len(active), kind)
            ahead[more] = at_symbol(active[more], sizes[active[more]] - column - 1)
            # common prefixes with the rows before and behind that start with the same symbol
            before, behind = order[np.maximum(mine - 1, 0)], order[np.minimum(mine + 1, len(order) - 1)]
            has_before, has_behind = (mine > 0) & (symbol[before] == c), (mine + 1 < len(order)) & (symbol[behind] == c)
            del order, rank

            def grown(was: np.ndarray, now: np.ndarray, old_rows: np.ndarray = old_rows, new: np.ndarray = new) -> np.ndarray:
                out = np.empty(len(old_rows), was.dtype)
                out[old_rows] = was
                out[new] = now
                return out

            keep("symbol", grown(symbol, ahead), column)
            lcp = read("lcp")
            least = _RangeMin(lcp)
            from_before = np.zeros(len(at), np.uint8)
            from_before[has_before] = np.minimum(least(before[has_before] + 1, at[has_before]).astype(np.int16) + 1, whole_symbols)
            to_behind = np.minimum(least(at[has_behind] + 1, behind[has_behind]).astype(np.int16) + 1, whole_symbols)
            lcp = grown(lcp, from_before)
            lcp[new[has_behind] + 1] = to_behind
            keep("lcp", lcp, column)
            keep("member", grown(read("member"), active.astype(np.int32)), column)
            keep("depth", grown(read("depth"), np.full(len(at), column, np.uint8)), column)
            active, at = active[more], new[more]
        depth = read("depth")
        whole = depth >= whole_symbols
        own = read("member")[whole]
        self.group = np.cumsum(read("lcp") < whole_symbols)[whole]
        self.member, self.offset = piece[own], phase[own] + gram * (sizes[own] - depth[whole].astype(np.int64))


class _Folder:
    """A folder of its own below a shared one, removed at the end."""

    def __init__(self, shared: str):
        self.uri = f"{shared}/{uuid.uuid4().hex}"

    def __enter__(self) -> str:
        return self.uri

    def __exit__(self, *_: object) -> None:
        files, path = fs.FileSystem.from_uri(self.uri)
        if files.get_file_info(path).type == fs.FileType.Directory:
            files.delete_dir(path)


class _Columns:
    """The columns of a construction: in memory, or beyond `spill` bytes in files that are written and read from end to end."""

    def __init__(self, folder: str, spill: int):
        self.folder, self.spill, self.held = folder if "://" in folder else f"file://{folder}", spill, {}

    def keep(self, name: str, a: np.ndarray, column: int) -> None:
        if a.nbytes * 7 > self.spill * a.itemsize:  # four columns take seven bytes a row
            files, path = fs.FileSystem.from_uri(self.folder)
            files.create_dir(path, recursive=True)
            file = f"{path}/{name}-{column % 2}"
            with files.open_output_stream(file, compression=None) as out:
                out.write(np.ascontiguousarray(a))
            self.held[name] = files, file, a.dtype
        else:
            self.held[name] = a

    def read(self, name: str) -> np.ndarray:
        a = self.held[name]
        if isinstance(a, np.ndarray):
            return a
        files, file, kind = a
        with files.open_input_stream(file, compression=None) as stream:
            return np.frombuffer(stream.read(), kind)


class _RangeMin:
    """Minima over ranges of rows, by tables of doubled width made as they are asked for."""

    def __init__(self, values: np.ndarray):
        self.levels = [np.asarray(values)]

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least value of rows low..high, both included; no range is empty."""
        k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.zeros(len(low), np.uint8)
        for level in range(int(k.max()) + 1 if len(k) else 0):
            if level >= len(self.levels):
                last, half = self.levels[-1], 1 << (level - 1)
                self.levels.append(np.minimum(last[:-half], last[half:]))
            own = np.nonzero(k == level)[0]
            if len(own):
                t = self.levels[level]
                out[own] = np.minimum(t[low[own]], t[high[own] - (1 << level) + 1])
        return out


def _columns(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [b.column(c).to_numpy(zero_copy_only=False) for c in names]


def _combine(t: pa.Table) -> pa.Table:
    """Rows whose piece stands earlier among these rows are marked done, and dealt out by a hash of their place instead of their anchor."""
    m, piece, absent, doc, alt, place = (t.column(c).to_numpy() for c in ("m", "piece", "absent", "doc_id", "alt", "place"))
    order = np.argsort(piece)
    same = piece[order[1:]] == piece[order[:-1]]
    shared = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    shared = shared[np.lexsort((place[shared], alt[shared], doc[shared], absent[shared], m[shared], piece[shared]))]
    late = shared[1:][(piece[shared[1:]] == piece[shared[:-1]]) & (m[shared[1:]] == m[shared[:-1]])]
    done, m = np.zeros(len(m), np.int32), m.copy()
    done[late] = 1
    mixed = ((place[late] ^ doc[late]).view(np.uint64) * _M1 ^ piece[late].view(np.uint64)) * _M2
    m[late] = (mixed >> np.uint64(_LOW_BITS)).astype(np.int64)
    return t.set_column(0, "m", pa.array(m)).append_column("done", pa.array(done))


def anchored(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """(m, piece, absent, doc_id, alt, place, done): place is 128 * first window + number of windows - 1; absent marks a null
    doc_id; done marks repeats of a piece that the same task has earlier, so that hot pieces shrink before they are dealt out."""
    names = ["m", "piece", "absent", "doc_id", "alt", "place"]

    def told(held: list[tuple]) -> pa.RecordBatch:
        """held: (absent, doc_id, alt, place of the slice, slice)."""
        sizes = np.array([len(r[4]) for r in held])
        m, piece, first, count = runs(np.frombuffer(b"".join(r[4] for r in held), np.uint8), length, anchor, sizes)
        begin = np.cumsum(sizes) - sizes
        own = np.searchsorted(begin, first, "right") - 1
        absent, doc, alt, at = (np.array([r[k] for r in held], np.int64) for k in range(4))
        place = (first - begin[own] + at[own]) * 128 + count - 1
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (m, piece, absent[own].astype(np.int32), doc[own], alt[own], place)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for absent, doc, alt, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for at in range(0, max(0, len(data) - length + 1), _SLICE):
                    held.append((absent, doc, alt, at, data[at : at + _SLICE + length - 1]))
                    size += len(held[-1][4])
                    if size >= _TOGETHER:
                        yield told(held)
                        held, size = [], 0
        if held:
            yield told(held)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n > 200_000:
                yield from _combine(pa.Table.from_batches(held).combine_chunks()).combine_chunks().to_batches(50_000)
                held, n = [], 0
        if held:
            yield from _combine(pa.Table.from_batches(held).combine_chunks()).combine_chunks().to_batches(50_000)

    return docs.select("absent", "doc_id", "alt", "data").mapInArrow(joined, "m long, piece long, absent int, doc_id long, alt long, place long, done int")


_PLACE = "absent int, doc_id long, alt long, place long"


def settled(rows: DataFrame, hot: int) -> DataFrame:
    """From anchored rows: (absent, doc_id, alt, place, m, pieces). pieces is 0 for a repeat of an earlier equal piece, and else
    the number of different pieces of its anchor, if that is over 1 (hot + 1 where there are more); all other rows go."""

    def told(t: pa.Table, pieces: np.ndarray) -> list[pa.RecordBatch]:
        return t.select(["absent", "doc_id", "alt", "place", "m"]).append_column("pieces", pa.array(pieces.astype(np.int64))).combine_chunks().to_batches()

    def flush(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        """First pieces of whole anchors."""
        t = pa.Table.from_batches(held)
        _, group, n = np.unique(t.column("m").to_numpy(), return_inverse=True, return_counts=True)
        several = n[group] > 1
        return told(t.filter(pa.array(several)), n[group][several])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # first pieces of the last anchor, as long as they are no more than `hot`
        n, over, anchor, last = 0, False, None, None
        for b in batches:
            if not b.num_rows:
                continue
            m, piece, done = _columns(b, "m", "piece", "done")
            new = np.concatenate([[(m[0], piece[0]) != last], (m[1:] != m[:-1]) | (piece[1:] != piece[:-1])])
            first, last = new & (done == 0), (m[-1], piece[-1])
            yield from told(pa.Table.from_batches([b.filter(pa.array(~first))]), np.zeros(int((~first).sum())))
            b, m = b.filter(pa.array(first)), m[first]
            if not len(m):
                continue
            if m[0] != anchor:
                if held:
                    yield from flush(held)
                held, n, over = [], 0, False
            same = int(np.searchsorted(m, anchor, "right")) if over else 0
            if same:
                yield from told(pa.Table.from_batches([b.slice(0, same)]), np.full(same, hot + 1))
                b, m = b.slice(same), m[same:]
            if not len(m):
                continue
            tail = int(np.searchsorted(m, m[-1], "left"))
            if tail:
                yield from flush([*held, b.slice(0, tail)])
                held, n, over = [], 0, False
            elif over:
                over = False
            held.append(b.slice(tail))
            n, anchor = n + len(m) - tail, m[-1]
            if n > hot:
                yield from told(pa.Table.from_batches(held), np.full(n, hot + 1))
                held, n, over = [], 0, True
        if held:
            yield from flush(held)

    dealt = rows.repartition("m").sortWithinPartitions("m", "piece", "done", "absent", "doc_id", "alt", "place")
    return dealt.mapInArrow(run, f"{_PLACE}, m long, pieces long")


def constructed(docs: DataFrame, chosen: DataFrame, folder: str, length: int, hot: int, bucket: int, spill_bytes: int) -> DataFrame:
    """(absent, doc_id, alt, place) of the windows that another, earlier piece holds too. folder: for the files of columns."""
    wanted = chosen.groupBy("absent", "doc_id", "alt").agg(F.collect_list(F.struct("place", "m", "pieces")).alias("cut"))

    def dealt(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["route", "absent", "doc_id", "alt", "place", "data"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: dict[bytes, tuple] = {}  # the earliest place of each window of hot anchors
        for b in batches:
            parts = b.column("cut").flatten()
            all_parts = list(zip(*(parts.field(c).to_pylist() for c in ("place", "m", "pieces")), strict=True))
            sizes, end, out = b.column("cut").value_lengths().to_pylist(), 0, []
            for absent, doc, alt, data, k in zip(*(b.column(c).to_pylist() for c in ("absent", "doc_id", "alt", "data")), sizes, strict=True):
                begin, end = end, end + k
                for whole, m, pieces in all_parts[begin:end]:
                    at, n = whole >> 7, (whole & 127) + 1
                    if pieces <= hot:
                        out.append((m, absent, doc, alt, whole, data[at : at + n + length - 1]))
                        continue
                    for i in range(at, at + n):
                        place, held = (absent, doc, alt, i << 7), windows.get(x := data[i : i + length])
                        if held is None or place < held:
                            windows[x] = place
                        if held is not None:  # the later of both is a repeat, and goes its way without bytes
                            late = max(place, held)
                            out.append((hash_window(repr(late).encode()), *late, None))
                if len(out) >= 10_000:
                    yield dealt(out)
                    out = []
                if len(windows) >= WINDOWS:
                    yield dealt([(hash_window(x), *place, x) for x, place in windows.items()])
                    windows.clear()
            yield dealt(out)
        if windows:
            yield dealt([(hash_window(x), *place, x) for x, place in windows.items()])

    pieces = docs.join(wanted, ["absent", "doc_id", "alt"]).select("absent", "doc_id", "alt", "data", "cut").mapInArrow(cut, f"route long, {_PLACE}, data binary")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, route = 0, None
        for b in batches:
            late = b.column("data").is_null()
            yield b.filter(late).select(["absent", "doc_id", "alt", "place"])
            for row in zip(*(c.to_pylist() for c in b.filter(pc.invert(late)).columns), strict=True):
                if size >= bucket and row[0] != route:
                    yield later_windows(held, length, spill_bytes, folder)
                    held, size = [], 0
                route = row[0]
                held.append(row)
                size += len(row[5])
        if held:
            yield later_windows(held, length, spill_bytes, folder)

    return pieces.repartition("route").sortWithinPartitions("route").mapInArrow(build, _PLACE)


def hash_window(x: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(x) - (1 << 63)


def later_windows(rows: list[tuple], length: int, spill_bytes: int, folder: str | None = None) -> pa.RecordBatch:
    """rows: (route, absent, doc_id, alt, place, bytes). Windows that aren't the earliest of their group, as runs."""
    c = Construction([r[5] for r in rows], length, spill_bytes, folder)
    absent, doc, alt, place = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3, 4))
    at = (place[c.member] >> 7) + c.offset
    order = np.lexsort((at, alt[c.member], doc[c.member], absent[c.member], c.group))
    g = c.group[order]
    late = order[np.concatenate([[False], g[1:] == g[:-1]])] if len(order) else order
    member, at = c.member[late], at[late]
    o = np.lexsort((at, member))
    member, at = member[o], at[o]
    head = np.concatenate([[True], (member[1:] != member[:-1]) | (at[1:] != at[:-1] + 1)]) if len(o) else np.zeros(0, bool)
    first = np.nonzero(head)[0]
    count = np.diff(np.append(first, len(o)))
    m, a = member[first], at[first]
    return pa.RecordBatch.from_arrays([pa.array(absent[m].astype(np.int32)), pa.array(doc[m]), pa.array(alt[m]), pa.array(a * 128 + count - 1)], names=["absent", "doc_id", "alt", "place"])


def covered(n: int, places: list[int], length: int) -> np.ndarray:
    """Mask of the bytes of a text of n bytes that the windows at these places cover."""
    edge = np.zeros(n + 1, np.int32)
    p = np.array(places, np.int64)
    np.add.at(edge, p >> 7, 1)
    np.add.at(edge, (p >> 7) + (p & 127) + length, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, store: Store, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, bucket: int = BUCKET, spill_bytes: int = SPILL) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept is what is left of the text's bytes."""
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    base = docs.select(F.col("doc_id").isNull().cast("int").alias("absent"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), data.alias("data"))
    base = base.withColumn("sum", F.crc32("data"))
    keys = store.save(base.select("absent", "doc_id", "sum", F.md5("data").alias("digest"), F.length("data").alias("n")), "keys")
    who = F.struct("absent", "doc_id", "sum")
    firsts = keys.groupBy("digest").agg(F.min(who).alias("first"), F.max(who).alias("last")).where("first <> last").select("digest", "first")
    # a text with very many copies takes the place of its first in SALTS shares
    salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = keys.withColumn("salt", F.pmod(F.xxhash64("absent", "doc_id", "sum"), F.lit(SALTS)).cast("int"))
    copies = dealt.join(salted, ["digest", "salt"]).where(who != F.col("first")).select("absent", "doc_id", "sum").distinct().withColumn("copy", F.lit(True))
    shared = keys.groupBy("absent", "doc_id").agg(F.min("sum").alias("a"), F.max("sum").alias("b")).where("a <> b").select("absent", "doc_id")
    shared = keys.join(shared, ["absent", "doc_id"]).select("absent", "doc_id", "sum").distinct().withColumn("shared", F.lit(True))
    marks = copies.join(shared, ["absent", "doc_id", "sum"], "full")
    marks = store.save(marks.select("absent", "doc_id", "sum", F.coalesce("copy", F.lit(False)).alias("copy"), F.coalesce("shared", F.lit(False)).alias("shared")), "marks")
    marked = base.join(marks, ["absent", "doc_id", "sum"], "left")
    marked = marked.select("absent", "doc_id", F.when(F.col("shared"), F.col("sum")).otherwise(0).alias("alt"), "data", F.coalesce("copy", F.lit(False)).alias("copy"))
    single = marked.where("NOT copy").drop("copy")
    places = store.save(settled(anchored(single, length, anchor), hot), "places")
    store.free_shuffles()
    late = store.save(constructed(single, places.where("pieces > 1"), store.path("columns"), length, hot, bucket, spill_bytes), "late")
    store.free_shuffles()
    by_doc = places.where("pieces = 0").select("absent", "doc_id", "alt", "place").union(late).groupBy("absent", "doc_id", "alt").agg(F.collect_list("place").alias("places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for absent, doc, data, copy, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, gone, spans = len(data), 0, 0
                if copy and n >= length:
                    data, gone, spans = b"", n, 1
                elif places and not copy:
                    mask = covered(n, places, length)
                    gone, spans = int(mask.sum()), int(np.count_nonzero(np.diff(np.concatenate([[0], mask.astype(np.int8)])) == 1))
                    data = np.frombuffer(data, np.uint8)[~mask].tobytes()
                out.append((None if absent else doc, n, gone, spans, data))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    last = marked.join(by_doc, ["absent", "doc_id", "alt"], "left").select("absent", "doc_id", "data", "copy", "places")
    return last.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100-byte strings over all of documents."""
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), Store(spark, "suffixes"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
