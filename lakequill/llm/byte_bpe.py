"""Byte-level BPE: texts to token ids and back, by the rank file of a public tokenizer.

A text is split by the tokenizer's pattern; a match that is itself in the vocabulary is one token, any other is merged from
its bytes. Matches of about one length are the rows of a padded matrix: each round every row merges its leftmost pair of
least rank, pairs are looked up in a hash table over (left id, right id), and the matrix is compacted, by the column that
each row lost and by the rows that are done. A match too long for the matrix (a run of letters of 300 bytes and more) is
merged alone: all places of the least rank in one round, as far as no merge makes a pair that would come before the next
place, so that the order of merges is the same. Tasks keep the ids of matches they have seen, within a bound.

Ids go out as binary, little-endian unsigned 32-bit integers, which is four bytes a token whatever the text's length;
as_array() turns them into an array.

Defined results: a null or empty text has no ids (empty binary); null ids decode to null, empty ones to empty binary; ids
outside the vocabulary and a number of bytes that is no multiple of four raise. All other columns pass through, but those
named like the new column (in any case of letters), which it replaces; repeated rows stay; an empty table gives no rows.
Texts are encoded whole, in blocks of matches, so a task holds a block of matches and one text's ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakequill.llm.common import Store, slices, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: No pair: greater than any rank.
NONE = np.int32(2**31 - 1)
#: Longest row of a matrix, cells of a matrix, matches of a block, places in a block of the long path.
WIDEST, CELLS, MATCHES, PLACES = 300, 1 << 20, 100_000, 512
#: Matches and their bytes that a task remembers.
KEPT, KEPT_BYTES = 200_000, 8 << 20


class Pairs:
    """(left id, right id) to the id of both together: open addressing in two arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        keys, made = np.array(left, np.int64) << 32 | np.array(right, np.int64), np.array(made, np.int32)
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        at, left_over = self.place(keys), np.arange(len(keys))
        while len(left_over):  # of keys that want one empty slot the last takes it, the others move on
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left_over[free]]
            done = self.keys[at] == keys[left_over]
            self.made[at[done]] = made[left_over[done]]
            at, left_over = (at[~done] + 1) & (len(self.keys) - 1), left_over[~done]

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the merged pairs, NONE where there is none; a negative id has no pair."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self.place(keys)
        out, found = self.made[at], self.keys[at]
        rest = np.flatnonzero((found != keys) & (found >= 0))
        out[found != keys] = NONE
        at = at[rest]
        while len(rest):
            at = (at + 1) & (len(self.keys) - 1)
            found = self.keys[at]
            hit = found == keys[rest]
            out[rest[hit]] = self.made[at[hit]]
            go_on = ~hit & (found >= 0)
            rest, at = rest[go_on], at[go_on]
        out[(left < 0) | (right < 0)] = NONE
        return out


class Vocabulary:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"bytes without a rank: {missing}")
        self.pattern, self.pairs = regex.compile(pattern), Pairs(self.ranks)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.length = np.array([len(x) for x in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.forget()

    # encoding

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each match, in order."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        buckets: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            known = self.ranks.get(w)
            if known is not None:
                out[i] = np.array([known], np.int32)
            elif len(w) > WIDEST:
                out[i] = self.merge_long(self.single[np.frombuffer(w, np.uint8)])
            else:
                buckets.setdefault(-(-len(w) // 4) * 4, []).append(i)
        for width, rows in buckets.items():
            step = max(1, CELLS // width)
            for k in range(0, len(rows), step):
                self.merge_rows(words, rows[k : k + step], width, out)
        return out

    def merge_rows(self, words: list[bytes], rows: list[int], width: int, out: list[np.ndarray]) -> None:
        size = np.array([len(words[i]) for i in rows])
        inside = np.arange(width) < size[:, None]
        ids = np.full((len(rows), width), -1, np.int32)
        ids[inside] = self.single[np.frombuffer(b"".join(words[i] for i in rows), np.uint8)]
        rank = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        row = np.array(rows)
        while len(row):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(row)), at]
            done = best == NONE
            if done.any():
                for i, r, n in zip(row[done].tolist(), ids[done], size[done].tolist(), strict=True):
                    out[i] = r[:n].copy()
                live = ~done
                ids, rank, row, size, at, best = ids[live], rank[live], row[live], size[live], at[live], best[live]
                if not len(row):
                    return
            n, width, every = len(row), ids.shape[1], np.arange(len(row))
            ids[every, at] = best
            ids = ids[np.arange(width) != at[:, None] + 1].reshape(n, width - 1)
            rank = rank[np.arange(width - 1) != at[:, None]].reshape(n, width - 2)
            size -= 1
            for place in (at - 1, at):  # the new pairs on either side
                r = np.flatnonzero((place >= 0) & (place < width - 2))
                rank[r, place[r]] = self.pairs(ids[r, place[r]], ids[r, place[r] + 1])
            if width == 2:
                for i, x in zip(row.tolist(), ids, strict=True):
                    out[i] = x.copy()
                return

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long match, as a list linked both ways with the least rank of each block of places."""
        n = len(ids)
        ids = np.append(ids, np.int32(-1))  # place n stands for either end
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[n] = before[0] = n
        rank = np.full(-(-n // PLACES) * PLACES, NONE, np.int32)
        rank[: n - 1] = self.pairs(ids[: n - 1], ids[1:n])
        blocks = rank.reshape(-1, PLACES)
        least = blocks.min(axis=1)
        alive = np.ones(n, bool)
        while (best := least.min()) != NONE:
            held = np.flatnonzero(least == best)
            b, k = np.nonzero(blocks[held] == best)
            at = held[b] * PLACES + k
            if len(at) > 1:  # of places that overlap in a row, every other one
                head = np.append(True, after[at[:-1]] != at[1:])
                first = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            gone = after[at]
            right, left = ids[after[gone]], ids[before[at]]
            left = np.where(np.append(False, after[gone[:-1]] == at[1:]), best, left)  # the place before has merged by then
            new = np.full(len(at), best, np.int32)
            sooner = np.flatnonzero(np.minimum(self.pairs(left, new), self.pairs(new, right)) <= best)
            if len(sooner):
                at, gone = at[: sooner[0] + 1], gone[: sooner[0] + 1]
            ids[at] = best
            alive[gone] = False
            rank[gone] = NONE
            far = after[gone]
            after[at] = far
            before[far[far < n]] = at[far < n]
            last = after[at] == n
            rank[at] = np.where(last, NONE, self.pairs(ids[at], ids[after[at]]))
            prior = before[at]
            prior = prior[prior < n]
            rank[prior] = self.pairs(ids[prior], ids[after[prior]])
            touched = np.unique(np.concatenate([at, gone, prior]) // PLACES)
            least[touched] = blocks[touched].min(axis=1)
        return ids[:n][alive]

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.flat, self.used, self.weight = np.empty(1 << 16, np.int32), 0, 0
        self.at, self.size = np.empty(KEPT * 2, np.int64), np.empty(KEPT * 2, np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        """Ids of successive matches in one array, and the ends of each in the other."""
        if len(self.seen) > KEPT or self.weight > KEPT_BYTES:
            self.forget()
        seen = self.seen
        new = [w for w in dict.fromkeys(words) if w not in seen]
        coded = [w.encode("utf-8") for w in new]
        for w, raw, ids in zip(new, coded, self.merge(coded), strict=True):
            k, n = len(seen), len(ids)
            if self.used + n > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.empty(self.used + n, np.int32)])
            self.flat[self.used : self.used + n] = ids
            if k == len(self.at):
                self.at, self.size = np.concatenate([self.at, self.at]), np.concatenate([self.size, self.size])
            self.at[k], self.size[k] = self.used, n
            seen[w] = k
            self.used += n
            self.weight += len(raw)
        k = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
        size = self.size[k]
        end = np.cumsum(size)
        return self.flat[np.repeat(self.at[k] - end + size, size) + np.arange(end[-1] if len(end) else 0)], end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; matches of several short texts, or of a part of a long one, make a block."""
        out: list[list[bytes]] = [[] for _ in texts]
        words: list[str] = []
        parts: list[tuple[int, int]] = []

        def block() -> None:
            ids, end = self.numbers(words)
            ids, end = ids.astype("<u4", copy=False), np.append(0, end)
            k = 0
            for i, n in parts:
                out[i].append(ids[end[k] : end[k + n]].tobytes())
                k += n
            words.clear()
            parts.clear()

        for i, text in enumerate(texts):
            if text and len(text) <= MATCHES:
                found = self.pattern.findall(text)
                words += found
                parts.append((i, len(found)))
                if len(words) >= MATCHES:
                    block()
            elif text:
                matches = self.pattern.finditer(text)
                while found := [m[0] for m in islice(matches, MATCHES)]:
                    words += found
                    parts.append((i, len(found)))
                    block()
        if words:
            block()
        return [b"".join(x) for x in out]

    # decoding

    def decode(self, ids: bytes | None) -> bytes | None:
        if ids is None:
            return None
        if len(ids) % 4:
            raise ValueError("ids are not whole 32-bit integers")
        k = np.frombuffer(ids, "<u4")
        if len(k) and k.max() >= len(self.length):
            raise ValueError(f"id {k.max()} is not in the vocabulary")
        parts = []
        for i in range(0, len(k), 1 << 20):
            j = k[i : i + (1 << 20)].astype(np.int64)
            size = self.length[j]
            if not size.all():
                raise ValueError(f"id {j[size == 0][0]} is not in the vocabulary")
            end = np.cumsum(size)
            parts.append(self.bytes[np.repeat(self.start[j] - end + size, size) + np.arange(end[-1])].tobytes())
        return b"".join(parts)


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def _mapped(df: DataFrame, column: str, name: str, work) -> DataFrame:  # noqa: ANN001
    """df with a binary column `name`, made from `column` by work(list of values); it replaces one of that name."""
    names = [c for c in df.columns if c.lower() != name.lower()]
    at, keep = df.columns.index(column), [df.columns.index(c) for c in names]
    schema = T.StructType([*(df.schema[i] for i in keep), T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices((pa.RecordBatch.from_arrays(x.columns, [f"c{i}" for i in range(x.num_columns)]) for x in batches), f"c{at}", 2 << 20):
            made = pa.array(work(b.column(at).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), made], names=[*names, name])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, store: Store, column: str = "text", name: str = "ids", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """df with the packed ids of a text column. `store` sets up the session (batches, package path); nothing is written."""
    file = path or public_tokenizers.path(RANKS)
    return _mapped(df, column, name, lambda texts: vocabulary(file, pattern).encode(texts))


def decode(df: DataFrame, store: Store, column: str = "ids", name: str = "decoded", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """df with the bytes that packed ids stand for."""
    file = path or public_tokenizers.path(RANKS)

    def work(values: list[bytes | None]) -> list[bytes | None]:
        known = vocabulary(file, pattern)
        return [known.decode(x) for x in values]

    return _mapped(df, column, name, work)


def as_array(ids: Column) -> Column:
    """Packed ids as array<long>."""
    turned = lambda x: F.concat(*(F.substring(x, k, 2) for k in (7, 5, 3, 1)))
    return F.transform(F.regexp_extract_all(F.hex(ids), F.lit("[0-9A-F]{8}"), F.lit(0)), lambda x: F.conv(turned(x), 16, 10).cast("long"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "byte_bpe")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = decode(encode(docs, store).drop("text"), store)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
