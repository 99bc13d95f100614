"""URL filters as Bloom filter cascades.

Rules name a host and a path; a rule fits its host and all subdomains where the URL's path starts with the rule's. The keys a
URL can be listed under are its host's suffixes joined with the beginnings of its path that are as long as some rule's path;
over all URLs of the corpus these keys are the universe. Level 1 of a cascade encodes the listed keys, level 2 the keys of
the universe that level 1 takes wrongly, level 3 the listed keys that level 2 takes wrongly, and so on until none is left.
For every key of the universe the first level that misses tells exactly whether it is listed, so judging needs no join.
One cascade holds the allowed rules, one the blocked ones.

The filters are broadcast with the judging code. They take about 1.44 log2(universe / rules) + 4 bits a rule; when that would
pass `max_bytes`, the keys are dealt out by their hash into parts of about `part_rules` rules, each with cascades of its own in
the shared folder, and a url's keys go to the tasks that hold their parts (judge_in_parts).

Defined results: a null url, or one without '://', has an empty host and path and fits no rule; without a fitting rule the
url is in no list, and the verdict is allow; a key in both lists is blocked; repeated rows are judged alike; an empty table
gives no rows. Only url is read; other columns pass through, columns named host, path, rule
and verdict are replaced.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakequill.llm.common import FileWriter, RangeReader, Store, table

#: (verdict, host and path)
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
MAX_BYTES, CHUNK = 64 << 20, 1 << 16
#: Rules of a part where filters lie in files, and keys of one part that a task judges.
PART_RULES, TASK_KEYS = 1 << 18, 1 << 20
_LOWER = {c: c + 32 for c in range(65, 91)}


def host_and_path(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, path = rest[:end].translate(_LOWER), rest[end:]
    return host, path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]


def keys_of(host: str, path: str, lengths: list[int]) -> list[str]:
    """Longest first; lengths are those of the rules' paths, in falling order."""
    labels = host.split(".") if host else []
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    return sorted((h + path[:n] for h in hosts for n in lengths if n <= len(path)), key=lambda k: (-len(k), k))


def _positions(keys: list[str], level: int, bits: int, hashes: int) -> np.ndarray:
    """(keys, hashes) bit positions, by double hashing; each level hashes anew."""
    raw = np.array([divmod(xxhash.xxh3_128_intdigest(k.encode("utf-8", "surrogatepass"), level), 1 << 64) for k in keys], np.uint64).reshape(-1, 2)
    return (raw[:, :1] + np.arange(hashes, dtype=np.uint64) * (raw[:, 1:] | np.uint64(1))) % np.uint64(bits)


class Cascade:
    """Filters by level: (bits, hashes, bytes)."""

    def __init__(self, levels: list[tuple[int, int, bytes]]):
        self.levels = [(bits, k, np.frombuffer(data, np.uint8)) for bits, k, data in levels]

    def passes(self, keys: list[str], level: int) -> np.ndarray:
        bits, k, data = self.levels[level]
        at = _positions(keys, level, bits, k).astype(np.int64)
        return (data[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(1)

    def listed(self, keys: list[str]) -> np.ndarray:
        """For keys of the universe: exactly whether they are listed."""
        out, left = np.zeros(len(keys), bool), np.arange(len(keys))
        for level in range(len(self.levels)):
            if not len(left):
                return out
            hit = self.passes([keys[i] for i in left], level)
            out[left[~hit]] = level % 2 == 1
            left = left[hit]
        out[left] = len(self.levels) % 2 == 1
        return out


def _size(n: int, rate: float) -> tuple[int, int]:
    """Bits and hashes of a filter."""
    return max(64, math.ceil(n * math.log2(1 / rate) / math.log(2))), max(1, round(math.log2(1 / rate)))


def _first_rate(n: int, universe_size: int) -> float:
    return min(0.5, max(1e-6, n / (math.sqrt(2) * max(1, universe_size))))


def _bloom(keys: DataFrame, n: int, rate: float, level: int) -> tuple[int, int, bytes]:
    """A filter over the keys, its partial bit arrays merged by chunks; the bytes come to the driver."""
    bits, k = _size(n, rate)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                at = np.unique(_positions(b.column(0).to_pylist(), level, bits, k)).astype(np.int64)
                for c in np.unique(at // (8 * CHUNK)):
                    own = at[at // (8 * CHUNK) == c] - c * 8 * CHUNK
                    np.bitwise_or.at(chunks.setdefault(int(c), np.zeros(CHUNK, np.uint8)), own >> 3, (1 << (own & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int32()), pa.array([x.tobytes() for x in chunks.values()], pa.binary())], names=["chunk", "data"])

    def merge(t: pa.Table) -> pa.Table:
        data = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t.column("data").to_pylist()])
        return pa.table({"chunk": t.column("chunk").slice(0, 1).combine_chunks(), "data": pa.array([data.tobytes()], pa.binary())})

    whole = bytearray(-(-bits // 8))
    for r in keys.mapInArrow(part, "chunk int, data binary").groupBy("chunk").applyInArrow(merge, "chunk int, data binary").collect():
        at = r["chunk"] * CHUNK
        whole[at : at + CHUNK] = r["data"][: len(whole) - at]
    return bits, k, bytes(whole)


def build(universe: DataFrame, listed: DataFrame, store: Store, universe_size: int) -> Cascade:
    """universe and listed: tables with the one column key, distinct."""
    n = listed.count()
    if not n:
        return Cascade([])
    cascade, ins, outs = Cascade([_bloom(listed, n, _first_rate(n, universe_size), 0)]), listed, None
    while True:
        level = len(cascade.levels) - 1
        asked = universe if level == 0 else outs

        def taken(batches: Iterator[pa.RecordBatch], cascade: Cascade = cascade, level: int = level) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield b.filter(pa.array(cascade.passes(b.column(0).to_pylist(), level)))

        wrong = asked.mapInArrow(taken, "key string")
        if level == 0:  # few keys; the listed ones among them are right
            wrong = wrong.join(listed, "key", "left_anti")
        wrong = store.save(wrong, f"level-{level}")
        n = wrong.count()
        if not n:
            return cascade
        cascade = Cascade([*((b, k, d.tobytes()) for b, k, d in cascade.levels), _bloom(wrong, n, 0.5, level + 1)])
        ins, outs = wrong, ins


def universe_of(pages: DataFrame, lengths: list[int]) -> DataFrame:
    """The distinct keys that the urls can be listed under."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array({k for u in b.column(0).to_pylist() for k in keys_of(*host_and_path(u), lengths)}, pa.string())], names=["key"])

    return pages.select(F.col("url").cast("string").alias("url")).mapInArrow(run, "key string").distinct()


def judge(pages: DataFrame, rules: DataFrame, store: Store, max_bytes: int = MAX_BYTES, part_rules: int = PART_RULES) -> DataFrame:
    """pages with host, path, rule and verdict. rules: (verdict, rule), distinct; the lengths of their paths come to the driver."""
    pages = pages.drop("host", "path", "rule", "verdict")
    rules = store.save(rules.select("verdict", "rule").distinct(), "rules")
    path = F.when(F.col("rule").contains("/"), F.length(F.expr("substring(rule, locate('/', rule))"))).otherwise(0)
    lengths = sorted((r[0] for r in rules.select(path).distinct().collect()), reverse=True)
    universe = store.save(universe_of(pages, lengths), "universe")
    size, n_rules = universe.count(), rules.count()
    if n_rules * (1.44 * max(1.0, math.log2(max(2, size) / max(1, n_rules))) + 6) / 8 > max_bytes:
        return judge_in_parts(pages, rules, lengths, universe, store, max(1, -(-n_rules // part_rules)), size)
    lists = [build(universe, rules.where(F.col("verdict") == v).select(F.col("rule").alias("key")), store, size) for v in ("allow", "block")]
    at, names = pages.columns.index("url"), [*pages.columns, "host", "path", "rule", "verdict"]
    schema = T.StructType([*pages.schema.fields, *(T.StructField(c, T.StringType()) for c in names[-4:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [host_and_path(u) for u in b.column(at).to_pylist()]
            keys = [keys_of(h, p, lengths) for h, p in split]
            flat = list(dict.fromkeys(k for ks in keys for k in ks))
            allow, block = (dict(zip(flat, c.listed(flat), strict=True)) for c in lists)
            rule = [next((k for k in ks if allow[k] or block[k]), None) for ks in keys]
            verdict = ["block" if k is not None and block[k] else "allow" for k in rule]
            new = [[h for h, _ in split], [p for _, p in split], rule, verdict]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.string()) for x in new)], names=names)

    return pages.mapInArrow(run, schema)


class _Building:
    """The cascades (allow, block) of one part. The listed keys come first, so that the universe can stream past level 1."""

    def __init__(self, universe_size: int):
        self.size, self.listed, self.first, self.wrong = universe_size, (set(), set()), None, ([], [])

    @staticmethod
    def level(keys: list[str], rate: float, level: int) -> tuple[int, int, bytes]:
        bits, k = _size(len(keys), rate)
        data, at = np.zeros(-(-bits // 8), np.uint8), _positions(keys, level, bits, k).ravel().astype(np.int64)
        np.bitwise_or.at(data, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return bits, k, data.tobytes()

    def start(self) -> None:
        self.first = [[self.level(sorted(x), _first_rate(len(x), self.size), 0)] if x else [] for x in self.listed]

    def add(self, kind: int, keys: list[str]) -> None:
        """kind: 0 and 1 are the lists, 2 is the universe."""
        if kind < 2:
            self.listed[kind].update(keys)
            return
        if self.first is None:
            self.start()
        for levels, listed, wrong in zip(self.first, self.listed, self.wrong, strict=True):
            if levels:
                wrong += [k for k, hit in zip(keys, Cascade(levels).passes(keys, 0), strict=True) if hit and k not in listed]

    def done(self) -> bytes:
        if self.first is None:
            self.start()
        for levels, listed, wrong in zip(self.first, self.listed, self.wrong, strict=True):
            encoded, others = sorted(listed), wrong
            while others:
                levels.append(self.level(others, 0.5, len(levels)))
                hit = Cascade(levels).passes(encoded, len(levels) - 1)
                encoded, others = others, [k for k, h in zip(encoded, hit, strict=True) if h]
        return pickle.dumps(self.first)


def _cascade_files(universe: DataFrame, rules: DataFrame, folder: str, parts: int, universe_size: int) -> DataFrame:
    """Builds every part's cascades in one task each: part, and where its file has them."""
    kind = F.when(F.col("verdict") == "allow", 0).otherwise(1)
    keys = rules.select(F.col("rule").alias("key"), kind.alias("kind")).unionByName(universe.select("key", F.lit(2).alias("kind")))
    share = max(1, universe_size // parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows, part, now = FileWriter(folder, "cascade"), [], None, None
        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("part", "kind", "key"))
            for (p, k), group in groupby(zip(*columns, strict=True), lambda r: r[:2]):
                if p != part:
                    if now is not None:
                        rows.append((part, *out.write(now.done())))
                    part, now = p, _Building(share)
                now.add(k, [r[2] for r in group])
        if now is not None:
            rows.append((part, *out.write(now.done())))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["part", "file", "at", "size"])

    dealt = keys.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts))).repartition(parts, "part").sortWithinPartitions("part", "kind")
    return dealt.mapInArrow(run, "part long, file long, at long, size long")


def judge_in_parts(pages: DataFrame, rules: DataFrame, lengths: list[int], universe: DataFrame, store: Store, parts: int, universe_size: int) -> DataFrame:
    """The same results where no broadcast should hold the filters. A part that many urls ask is held by several tasks."""
    folder = store.path("cascades")
    files = store.save(_cascade_files(universe, rules, folder, parts, universe_size), "cascade-files")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = [host_and_path(u) for u in b.column(0).to_pylist()]
            new = [pa.array([h for h, _ in urls], pa.string()), pa.array([p for _, p in urls], pa.string()), pa.array([keys_of(h, p, lengths) for h, p in urls], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *new], names=["url", "host", "path", "keys"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, part, lists = RangeReader(folder, "cascade"), None, ()
        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("part", "file", "at", "size", "url", "key"))
            rows = []
            for (p, *place), group in groupby(zip(*columns, strict=True), lambda r: r[:4]):
                if p != part:
                    part, lists = p, [Cascade(levels) for levels in pickle.loads(reader.read(*place))]
                group = list(group)
                allow, block = (c.listed([r[5] for r in group]) for c in lists)
                rows += [(r[4], r[5], not x) for r, a, x in zip(group, allow, block, strict=True) if a or x]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_()))], names=["url", "rule", "ok"])

    urls = store.save(pages.select(F.col("url").cast("string").alias("url")).distinct().mapInArrow(split, "url string, host string, path string, keys array<string>"), "urls")
    keys = urls.select("url", F.explode("keys").alias("key")).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    sizes = store.save(keys.groupBy("part").agg(F.count("*").alias("n")), "part-sizes").join(files, "part")  # one row a part
    tasks = 1 + (sizes.agg(F.sum("n")).first()[0] or 0) // TASK_KEYS
    salted = keys.join(sizes, "part").withColumn("salt", F.pmod(F.xxhash64("url"), 1 + F.expr(f"n div {TASK_KEYS}")))
    found = salted.repartition(max(tasks, parts), "part", "salt").sortWithinPartitions("part").mapInArrow(asked, "url string, rule string, ok boolean")
    best = found.groupBy("url").agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule", "ok")).alias("b"))
    told = urls.drop("keys").join(best, "url", "left")
    verdict = F.when(F.coalesce("b.ok", F.lit(True)), "allow").otherwise("block").alias("verdict")
    told = told.select(F.col("url").alias("__url"), "host", "path", F.col("b.rule").alias("rule"), verdict)
    return pages.join(told, F.col("url").cast("string").eqNullSafe(F.col("__url")), "left").drop("__url")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RULES over every url of pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").cast("string").alias("url"))
    rules = spark.createDataFrame(RULES, "verdict string, rule string")
    return judge(pages, rules, Store(spark, "urls")).drop("url")


OP4_SQL = f"""
WITH rules AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{r}')" for v, r in RULES)}) AS r(verdict, rule)),
split AS (
  SELECT page_id, row_number() OVER () AS n,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), fits AS (
  SELECT s.n, r.rule, r.verdict, row_number() OVER (PARTITION BY s.n ORDER BY length(r.rule) DESC, r.rule) AS k
  FROM split s JOIN rules r ON (s.host = split_part(r.rule, '/', 1) OR ends_with(s.host, '.' || split_part(r.rule, '/', 1)))
   AND starts_with(s.path, substr(r.rule, instr(r.rule, '/')))
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM split s LEFT JOIN fits f ON s.n = f.n AND f.k = 1
"""
