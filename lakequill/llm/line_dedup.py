"""Line dedup over levelled sorted runs of line hashes.

A LineStore keeps runs of (h, n_docs, owner) in the order of the line hash, where n_docs counts documents that hold the line
and owner is the largest doc_id among them. A run is cut by ranges of the hash into one sorted file for each of `parts`, and
all runs are cut alike, so that runs meet range by range without a shuffle: a task reads the files of its range from front to
end, a block at a time. A batch of documents is reduced to one entry for each of its lines, sorted, and merge-anti-joined
with the runs against entries that are settled (frequent already, with a larger owner: nothing the batch could add would
change a decision); what is left becomes a run of level 0. When a level has `fanout` runs they are merged into one run of the
next level, so that runs stay few and each entry is rewritten a logarithmic number of times.

A task writes its file under a name of its own and moves it into place when it is whole, so a lost executor leaves nothing
that is read, and a second attempt puts the same entries there.

Defined results: null and empty texts have one empty line; rows that repeat a doc_id count as one document; rows
without doc_id count together as one document, own nothing, and lose the frequent lines that another document owns; an empty
table gives an empty table. Only the id and text columns are read, the others pass through; columns named n_lines and
n_dropped are replaced.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakequill.llm.common import Store, slices, table

MIN_POINTS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 6, 3
#: Entries of a hash range, by which the number of ranges is chosen; entries that a merge reads of a run at once.
PART_LINES, BLOCK = 500_000, 1 << 16
_SPACE = b" \t\n\x0b\x0c\r"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CONTINUATION = bytes(range(0x80, 0xC0))


def line_keys(text: str | None, min_points: int) -> list[bytes | None]:
    """For each line: the hash of its key, or None where the key has fewer than min_points code points."""
    out = []
    for line in (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split(b"\n"):
        key = line.strip(_SPACE)
        long = len(key) >= min_points and (len(key) >= 4 * min_points or len(key.translate(None, _CONTINUATION)) >= min_points)
        out.append(hashlib.blake2b(key, digest_size=16).digest() if long else None)
    return out


def entries(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """(h, doc_id) once for each line of a document that is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(iter([whole]), "text"):
                hashes, ids = [], []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    found = {h for h in line_keys(text, min_points) if h}
                    hashes += found
                    ids += [doc] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(ids, pa.int64())], names=["h", "doc_id"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "h binary, doc_id long")


_ENTRY = pa.schema([("h", pa.binary()), ("n_docs", pa.int64()), ("owner", pa.int64())])


class _Keys:
    """A column of hashes as a sequence that can be bisected."""

    def __init__(self, column: pa.Array):
        self.column = column

    def __len__(self) -> int:
        return len(self.column)

    def __getitem__(self, i: int) -> bytes:
        return self.column[i].as_py()


class _Cursor:
    """A sorted run file, read forward block by block."""

    def __init__(self, files: fs.FileSystem, path: str):
        self.blocks, self.block = pq.ParquetFile(files.open_input_file(path)).iter_batches(BLOCK), None
        self._next()

    def _next(self) -> None:
        self.block = next((b for b in self.blocks if b.num_rows), None)

    def last(self) -> bytes | None:
        """The greatest hash of the block at hand; None at the end of the file."""
        return None if self.block is None else self.block.column(0)[-1].as_py()

    def upto(self, key: bytes) -> list[pa.RecordBatch]:
        """Entries that are not greater than the key and were not taken before."""
        out = []
        while self.block is not None:
            n = bisect_right(_Keys(self.block.column(0)), key)
            out.append(self.block.slice(0, n))
            if n < self.block.num_rows:
                self.block = self.block.slice(n)
                break
            self._next()
        return out


def _reduced(batches: list[pa.RecordBatch]) -> pa.Table:
    """One entry for each hash, in order."""
    t = pa.Table.from_batches(batches, _ENTRY).group_by("h", use_threads=False).aggregate([("n_docs", "sum"), ("owner", "max")])
    return t.rename_columns({"n_docs_sum": "n_docs", "owner_max": "owner"}).select(_ENTRY.names).cast(_ENTRY).sort_by("h")


def _merge(cursors: list[_Cursor]) -> Iterator[pa.Table]:
    """All entries of sorted runs in order, those of one hash as one; a block of each run is in memory."""
    while ends := [k for c in cursors if (k := c.last()) is not None]:
        yield _reduced([b for c in cursors for b in c.upto(min(ends))])


class _RunFile:
    """A run file that is put in place when it is whole."""

    def __init__(self, folder: str, part: int):
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.path, self.own, self.rows = _part_path(self.folder, part), f"{self.folder}/_{part}-{uuid.uuid4().hex}", 0
        self.writer = pq.ParquetWriter(self.fs.open_output_stream(self.own), _ENTRY, compression="zstd")

    def write(self, t: pa.Table) -> None:
        if t.num_rows:
            self.writer.write_table(t)
            self.rows += t.num_rows

    def close(self) -> int:
        self.writer.close()
        try:
            self.fs.move(self.own, self.path)
        except OSError:  # some file systems don't replace what another attempt has put there
            if self.fs.get_file_info(self.path).type != fs.FileType.File:
                raise
            self.fs.delete_file(self.own)
        return self.rows


def _part_path(folder: str, part: int) -> str:
    return f"{folder}/part-{part:06d}.parquet"


def _cursors(folders: list[str], part: int) -> list[_Cursor]:
    found = [fs.FileSystem.from_uri(f) for f in folders]
    return [_Cursor(files, _part_path(path, part)) for files, path in found]


class LineStore:
    """Levelled runs. add() takes batches in any order; frequent() tells the lines found in min_docs documents or more."""

    def __init__(self, store: Store, min_docs: int = MIN_DOCS, fanout: int = FANOUT, parts: int = 8):
        self.store, self.min_docs, self.fanout, self.parts = store, min_docs, fanout, parts
        self.levels: list[list[str]] = [[]]

    def _folders(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def runs(self) -> list[DataFrame]:
        return [self.store.spark.read.schema("h binary, n_docs long, owner long").parquet(r) for r in self._folders()]

    def _each_part(self) -> DataFrame:
        return self.store.spark.range(0, self.parts, 1, self.parts).select(F.col("id").cast("int").alias("part"))

    def _put(self, folder: str, level: int) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(folder)
        if len(self.levels[level]) >= self.fanout:
            self.compact(level)

    def compact(self, level: int) -> None:
        """Merge all runs of a level into one run of the next."""
        old, self.levels[level] = self.levels[level], []
        folder = self.store.path(f"run-{level + 1}")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in b.column(0).to_pylist():
                    out = _RunFile(folder, part)
                    for t in _merge(_cursors(old, part)):
                        out.write(t)
                    yield pa.RecordBatch.from_arrays([pa.array([out.close()], pa.int64())], names=["n"])

        self._each_part().mapInArrow(run, "n long").agg(F.sum("n")).collect()
        self._put(folder, level + 1)
        for r in old:
            self.store.delete(r)

    def add(self, lines: DataFrame) -> None:
        """lines: (h, doc_id), each pair once, of documents that no earlier batch had."""
        folder, old, parts, min_docs = self.store.path("run-0"), self._folders(), self.parts, self.min_docs
        batch = lines.groupBy("h").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("owner"))
        part = (F.conv(F.hex(F.substring("h", 1, 2)), 16, 10).cast("long") * parts / 65536).cast("int")
        every = batch.select(part.alias("part"), "h", "n_docs", "owner").union(self._each_part().selectExpr("part", "NULL", "NULL", "NULL"))  # a file for each range

        def left(t: pa.Table, cursors: list[_Cursor]) -> pa.Table:
            """The entries that aren't settled."""
            known = _reduced([b for c in cursors for b in c.upto(t.column("h")[-1].as_py())])
            known = known.filter(pc.and_kleene(pc.greater_equal(known["n_docs"], min_docs), pc.is_valid(known["owner"]))).select(["h", "owner"]).rename_columns(["h", "settled"])
            if not known.num_rows:
                return t
            both = t.join(known, "h", join_type="left outer", use_threads=False)
            gone = pc.fill_null(pc.greater_equal(both["settled"], pc.coalesce(both["owner"], both["settled"])), False)
            return both.filter(pc.invert(gone)).select(_ENTRY.names).sort_by("h")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, out, cursors = None, None, []
            for b in batches:
                own = b.column(0).to_numpy()
                cuts = [0, *((own[1:] != own[:-1]).nonzero()[0] + 1).tolist(), len(own)] if len(own) else []
                for i, j in zip(cuts, cuts[1:], strict=False):
                    if own[i] != at:
                        if out:
                            yield pa.RecordBatch.from_arrays([pa.array([out.close()], pa.int64())], names=["n"])
                        at, out, cursors = int(own[i]), _RunFile(folder, int(own[i])), _cursors(old, int(own[i]))
                    t = pa.Table.from_batches([b.slice(i, j - i)]).select(_ENTRY.names).cast(_ENTRY)
                    t = t.filter(pc.is_valid(t["h"]))
                    if t.num_rows:
                        out.write(left(t, cursors))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([out.close()], pa.int64())], names=["n"])

        every.repartition(parts, "part").sortWithinPartitions("part", "h").mapInArrow(run, "n long").agg(F.sum("n")).collect()
        self._put(folder, 0)

    def frequent(self) -> DataFrame:
        """(h, owner) of the lines found in min_docs documents or more."""
        old, min_docs = self._folders(), self.min_docs

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in b.column(0).to_pylist():
                    for t in _merge(_cursors(old, part)):
                        yield from t.filter(pc.greater_equal(t["n_docs"], min_docs)).select(["h", "owner"]).combine_chunks().to_batches()

        return self._each_part().mapInArrow(run, "h binary, owner long")


def drop_frequent_lines(docs: DataFrame, store: Store, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs with two more columns, n_lines and n_dropped, and text without the lines that min_docs documents share.

    A frequent line stays in the largest doc_id that holds it, with all its repeats there. Documents go to batches by a hash
    of doc_id, so that all rows of one doc_id meet in one batch.
    """
    docs = docs.drop("n_lines", "n_dropped")
    lines = store.save(entries(docs, min_points).distinct().withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "lines", "batch")
    runs = LineStore(store, min_docs, fanout, max(8, -(-lines.count() // PART_LINES)))
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k).select("h", "doc_id"))
    frequent = store.save(runs.frequent(), "frequent")
    gone = lines.join(frequent, "h").where(F.coalesce(F.col("doc_id") < F.col("owner"), F.col("owner").isNotNull()))
    by_doc = gone.groupBy("doc_id").agg(F.collect_set("h").alias("gone")).select(F.col("doc_id").alias("__doc"), F.col("gone").alias("__gone"))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for b in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                split = (text or "").split("\n")
                if drop:
                    hashes, drop = line_keys(text, min_points), set(drop)
                    left = [x for x, h in zip(split, hashes, strict=True) if h not in drop]
                    text = "\n".join(left)
                else:
                    left = split
                texts.append(text)
                n_lines.append(len(split))
                n_dropped.append(len(split) - len(left))
            columns = [pa.array(texts, b.schema.field(at).type) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    joined = docs.join(by_doc, F.col("doc_id").eqNullSafe(F.col("__doc")), "left").drop("__doc")
    return joined.mapInArrow(run, schema)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of 40 code points or more in 5 documents or more."""
    kept = drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), Store(spark, "lines"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their frequent lines dropped; n_chars follows the text. No document goes."""
    kept = drop_frequent_lines(docs, Store(spark, "lines-stage")).drop("n_lines", "n_dropped")
    return kept.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (f.key IS NOT NULL AND k.doc_id < f.owner)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (NOT (f.key IS NOT NULL AND k.doc_id < f.owner)), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f ON k.key = f.key
GROUP BY k.doc_id
"""
