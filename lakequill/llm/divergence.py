"""Source divergence audit: how far the word use of each source of a language lies from the other sources' and the language's.

Tasks count terms of whole texts in partial sums by (lang, source, term); Spark adds them up and keeps, for each language, the
terms found in enough of its documents. A group is a (lang, source). Its counts are packed into a vector for each chunk of the
vocabulary. Groups of a language stand in blocks, and vectors are sent to each pair of blocks that theirs is part of: a tile.
A tile takes one chunk of its segment of the vocabulary after the other, in order, and adds to its submatrix of absolute
differences; so it holds two blocks of one chunk and the submatrix. Segments of one tile are added up by Spark. Most
telling terms of a group are ranked in shares by salt first.

Shares are 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)), in whole numbers throughout.

Defined results: null text, lang and source count as ''; a group without terms, or without kept terms, is compared like any
other; a language without kept terms has distances of 0 and no terms; repeated rows count each; other columns are never read;
an empty table gives no rows. N + SMOOTH * V of 9e15 and more raises, as shares would no longer be exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakequill.llm.common import Store, slices, table

LEAST_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Groups of a block, terms of a chunk, chunks of a segment, shares of a group's terms.
BLOCK, CHUNK, SEGMENT, SALTS = 32, 8192, 16, 32
#: Distinct entries that a task counts before it passes them on, bytes of a long text that are cut into words at a time.
ENTRIES, PART = 300_000, 1 << 20
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str) -> Iterator[list[bytes]]:
    """Runs of ASCII letters and other code points above 127, A-Z lower-cased, as UTF-8; a part of a long text at a time."""
    raw, at = text.encode("utf-8").translate(_LETTERS), 0
    while at < len(raw):
        end = raw.find(b" ", at + PART)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in held.items():
            words = [None, *(w.decode("utf-8") for w in n)]  # null: the group occurs
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(words)), pa.array([source] * len(words)), pa.array(words, pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(df.__getitem__, n)], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    entries = 0
    for b in slices(batches, "text"):
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            n, df = held.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(n), set()
            for words in terms(text):
                n.update(words)
                own.update(words)
            df.update(own)
            entries += len(n) - before
        if entries > ENTRIES:
            yield from rows()
            entries = 0
    yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n occurrences, docs that hold it); a row with a null term says that the group occurs."""
    d = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = d.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, all_counts: Column) -> Column:
    whole = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", whole, all_counts.cast("decimal(20,0)"))


def shares(count: np.ndarray, all_counts: np.ndarray) -> np.ndarray:
    """The same in arrays, by long division three decimal digits at a time; SCALE is 1000 ** 3."""
    rest = count + SMOOTH
    q = rest // all_counts
    rest = rest - q * all_counts
    for _ in range(3):
        rest = rest * 1000
        digit = rest // all_counts
        q, rest = q * 1000 + digit, rest - digit * all_counts
    return q + 1


class _Tile:
    """The submatrix of two blocks of groups over one segment of the vocabulary."""

    def __init__(self, key: tuple, terms: int):
        self.key, self.left, self.done, self.chunk = key, terms, 0, -1
        self.rows: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.all: tuple[list[int], list[int]] = ([], [])
        self.sides = [0] if key[1] == key[2] else [0, 1]
        self.sum: np.ndarray | None = None
        self.vectors: list[tuple[int, int, np.ndarray, np.ndarray]] = []

    def group(self, side: int, source: str, total: int) -> None:
        self.rows[side][source] = len(self.all[side])
        self.all[side].append(total)

    def ready(self) -> None:
        self.totals = [np.array(self.all[s], np.int64)[:, None] for s in self.sides]
        if any((t >= 9 * 10**15).any() for t in self.totals):
            raise ValueError("a group is too large for exact shares")
        self.none = [shares(np.zeros_like(t), np.maximum(t, 1)) for t in self.totals]
        self.sum = np.zeros((len(self.totals[0]), len(self.totals[-1])), np.int64)

    def add(self, chunk: int, size: int, side: int, source: str, at: np.ndarray, n: np.ndarray) -> None:
        if chunk != self.chunk:
            self.close()
            self.chunk, self.size = chunk, size
        self.vectors.append((side, self.rows[side][source], at, n))

    def close(self) -> None:
        """Add the chunk's differences."""
        if self.sum is None:
            self.ready()
        if not self.vectors:
            return
        full = [np.zeros((len(t), self.size), np.int64) for t in self.totals]
        for side, row, at, n in self.vectors:
            full[side][row, at] = n
        p = [shares(c, t) for c, t in zip(full, self.totals, strict=True)]
        for a in range(len(p[0])):
            self.sum[a] += np.abs(p[-1] - p[0][a]).sum(axis=1)
        self.vectors.clear()
        self.left -= self.size

    def result(self) -> pa.RecordBatch:
        self.close()
        total = self.sum + self.left * np.abs(self.none[0] - self.none[-1].T)  # terms of chunks that no group of the tile has
        one, other = list(self.rows[0]), list(self.rows[self.sides[-1]])
        a, b = (x.ravel() for x in np.indices(total.shape))
        names, items, value = [one[i] for i in a], [other[i] for i in b], total.ravel().tolist()
        if len(self.sides) == 2:
            names, items, value = names + items, items + names, value * 2
        else:
            keep = [i for i in range(len(names)) if names[i] != items[i]]
            names, items, value = ([x[i] for i in keep] for x in (names, items, value))
        return pa.RecordBatch.from_arrays([pa.array([self.key[0]] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(items, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "item", "value"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by tile, its groups first (chunk -1), then its chunks in order."""
    tile: _Tile | None = None
    for b in batches:
        at, n = b.column("at"), b.column("n")
        cols = zip(*(b.column(c).to_pylist() for c in ("lang", "one", "two", "segment", "chunk", "side", "source", "total", "size")), strict=True)
        for i, (lang, one, two, segment, chunk, side, source, total, size) in enumerate(cols):
            key = (lang, one, two, segment)
            if tile is None or tile.key != key:
                if tile:
                    yield tile.result()
                tile = _Tile(key, size)
            if chunk < 0:
                tile.group(side, source, total)
            else:
                tile.add(chunk, size, side, source, at[i].values.to_numpy(zero_copy_only=False), n[i].values.to_numpy(zero_copy_only=False))
    if tile:
        yield tile.result()


def audit(docs: DataFrame, store: Store, least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, chunk: int = CHUNK, segment: int = SEGMENT) -> DataFrame:
    """(lang, source, part, item, value, rank): all distances of sources (`pair`), and the terms that a source uses most above its language (`term`)."""
    counts = store.save(term_counts(docs), "counts")
    by_term = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("everywhere"))
    kept = store.save(by_term.where(F.col("docs") >= least_docs).drop("docs"), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("everywhere").alias("n_lang"))
    chunks = max(1, -(-(langs.agg(F.max("v")).first()[0] or 0) // chunk))
    w = Window.partitionBy("lang", "chunk")  # about `chunk` rows
    placed = kept.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int"))
    placed = placed.withColumns({"at": F.row_number().over(w.orderBy("term")) - 1, "size": F.count("*").over(w)})
    base = store.save(counts.where("term IS NOT NULL").drop("docs").join(placed, ["lang", "term"]), "base")

    n_group = base.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    every = counts.select("lang", "source").distinct()
    blocks = every.groupBy("lang").agg(F.ceil(F.count("*") / block).alias("blocks"))
    sized = every.join(blocks, "lang").join(langs, "lang", "left").join(n_group, ["lang", "source"], "left").na.fill(0, ["v", "n_lang", "n_group"])
    groups = store.save(
        sized.select("lang", "source", "blocks", F.pmod(F.xxhash64("source"), F.col("blocks")).alias("block"), (F.col("n_group") + SMOOTH * F.col("v")).alias("total"), (F.col("n_lang") + SMOOTH * F.col("v")).alias("total_lang")),
        "groups",
    )

    part = F.floor(F.col("chunk") / segment).cast("int")
    segments = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int").alias("chunk")).groupBy("lang", part.alias("segment")).agg(F.count("*").alias("size"))
    none = F.array().cast("array<long>")
    heads = groups.join(segments, "lang", "left").select("lang", "source", "blocks", "block", "total", F.coalesce("segment", F.lit(0)).alias("segment"), F.lit(-1).alias("chunk"), F.coalesce("size", F.lit(0)).alias("size"), none.alias("at"), none.alias("n"))
    packed = base.groupBy("lang", "source", "chunk").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("at", "n"))).alias("x"))
    vectors = packed.join(groups, ["lang", "source"]).select("lang", "source", "blocks", "block", "total", part.alias("segment"), "chunk", "size", F.col("x.at").cast("array<long>").alias("at"), F.col("x.n").alias("n"))
    sent = heads.unionByName(vectors).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sent = sent.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")}).withColumn("side", F.when(F.col("block") == F.col("one"), 0).otherwise(1))
    key = ["lang", "one", "two", "segment"]
    dealt = sent.select(*key, "chunk", "side", "source", "total", "size", "at", "n").repartition(*key).sortWithinPartitions(*key, "chunk")
    pairs = dealt.mapInArrow(_tiles, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    order = (F.desc("value"), F.asc("item"))
    by_group = Window.partitionBy("lang", "source").orderBy(*order)
    pairs = pairs.withColumn("rank", F.row_number().over(by_group))
    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS))
    spread = groups.select("lang", "source", "total", "total_lang", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    over = base.withColumn("salt", salt).join(spread, ["lang", "source", "salt"])
    value = share(F.col("n"), F.col("total")) - share(F.col("everywhere"), F.col("total_lang"))
    telling = over.select("lang", "source", "salt", F.col("term").alias("item"), value.alias("value")).where("value > 0")
    few = telling.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "salt").orderBy(*order))).where(F.col("rank") <= top)
    telling = few.withColumn("rank", F.row_number().over(by_group)).where(F.col("rank") <= top)
    name = lambda df, x: df.select("lang", "source", F.lit(x).alias("part"), "item", "value", "rank")
    return name(pairs, "pair").unionByName(name(telling, "term"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), Store(spark, "divergence"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n, count(DISTINCT k) AS docs FROM w GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
own AS (SELECT c.lang, c.source, c.term, c.n FROM c JOIN kept USING (lang, term)),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(x.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, v FROM l) USING (lang) LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS total FROM own GROUP BY ALL) x USING (lang, source)),
p AS (SELECT g.lang, g.source, kept.term, coalesce(own.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(own.n, 0) + 5)) // (g.total + 5 * g.v) AS p
      FROM g JOIN kept USING (lang) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = kept.term),
q AS (SELECT kept.lang, kept.term, 1 + (1000000000::HUGEINT * (kept.n + 5)) // (l.total + 5 * l.v) AS q FROM kept JOIN l USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
words AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM words))
WHERE part = 'pair' OR rank <= 50
"""
