"""Cross-tokenizer alignment: which tokens of tokenizer A cover the same bytes as which of tokenizer B.

Text is cut at spaces that follow a character which is no white space. Neither tokenizer merges over such a place: A's pattern
starts a match there, and no piece of B's vocabulary goes on after one (both are read from the files; where it isn't so, a
text is one segment). So segments that occur often are encoded once. For each Arrow batch, DuckDB holds the tokens of new
segments as tables of byte intervals: an ASOF join finds the B token in which each A token begins, a range join the B tokens
that begin inside an A token, which together are the overlaps; running sums over the common ends number the groups. Segments are
then counted by document, and links by (A id, B id) for each document and each batch. Spark merges the batches' partial
counts, and joins the documents' links with the totals: by broadcast up to BROADCAST_PAIRS pairs, counted first, beyond that by
a shuffle in salted shares.

Defined results: null and empty texts, and texts whose joined tokens of A or B are not a space and the text (such as those with
U+2581), have no tokens: zeros, and '' for groups and their hash. Repeated rows, and rows without an id, count each. Other
columns pass through, but those with names of the result's columns, which it replaces; an empty table gives no rows. A long
text is taken in parts of PART characters, cut like segments.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from lakequill.llm.common import Store, slices, table

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
BROADCAST_PAIRS, SALTS = 500_000, 16
#: Characters of a text taken at a time, segments counted, learnt and encoded at a time, segments and their characters that a task remembers.
PART, SEGMENTS, LEARNT, JOINED, KEPT, KEPT_CHARS = 1 << 21, 300_000, 40_000, 500, 200_000, 6 << 20
_CUT = re.compile(r"(?<=\S) ")
_ADDED = [
    *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")), T.StructField("groups", T.StringType()),
    *(T.StructField(c, T.ArrayType(kind)) for c, kind in (("a", T.IntegerType()), ("b", T.IntegerType()), ("n", T.LongType()))), T.StructField("partial", T.BooleanType()),
]


class Tokens:
    """Both tokenizers, and the bytes of their ids. `free`: texts may be encoded segment by segment."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        vocabulary = self.a.get_vocab()
        byte_of = self._byte_letters()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode("utf-8")
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode("utf-8") for k, p in enumerate(pieces)]
        self.lengths = [np.array([len(x) for x in tokens], np.int64) for tokens in (self.a_bytes, self.b_bytes)]
        self.free = self._free(a_path, b_path, pieces)

    @staticmethod
    def _byte_letters() -> dict[str, int]:
        """The letter of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from U+0100."""
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        rest = [b for b in range(256) if b not in set(own)]
        letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
        if set(letters) != set(ByteLevel.alphabet()):
            raise ValueError("the byte-level alphabet is another")
        return letters

    @staticmethod
    def _free(a_path: str, b_path: str, pieces: list[str]) -> bool:
        with open(a_path, encoding="utf-8") as f:
            head = json.load(f)
        split = head.get("pre_tokenizer") or {}
        a = head.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(b_path, "rb") as f:
            model.ParseFromString(f.read())
        n = model.normalizer_spec
        b = n.name == "identity" and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces
        return bool(a and b and not any("▁" in p.lstrip("▁") for p in pieces))


class Aligner:
    """What a task knows about segments, in DuckDB tables `seg` and `link`, and the counts of a batch, in `sums` and `pairs`."""

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        self.forget()

    def begin(self) -> None:
        self.con.execute("CREATE OR REPLACE TABLE sums (doc INT, n_a BIGINT, n_b BIGINT, n_groups BIGINT, n_links BIGINT); CREATE OR REPLACE TABLE pairs (doc INT, a INT, b INT, n BIGINT)")

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str | None] = []  # None: its bytes differ
        self.chars = 0
        self.con.execute("CREATE OR REPLACE TABLE seg (seg INT, n_a BIGINT, n_b BIGINT, n_groups BIGINT, n_links BIGINT); CREATE OR REPLACE TABLE link (seg INT, a INT, b INT, n BIGINT)")

    def encoded(self, segments: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Tokens of either side as (place of the segment, id), and the places whose bytes both sides hold.

        Segments that end in no white space are joined again by spaces, JOINED at a time, as they are cut where neither
        tokenizer merges; a block whose bytes or cuts differ, and other segments, are encoded one by one.
        """
        t = self.tokens
        plain = [i for i, s in enumerate(segments) if t.free and s and not s[-1].isspace()]
        blocks = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        alone = sorted(set(range(len(segments))) - set(plain))
        texts = [" ".join(map(segments.__getitem__, block)) for block in blocks]
        found: tuple[list, list] = ([], [])
        for block, text, a, b in zip(blocks, texts, t.a.encode_batch_fast([" " + x for x in texts], add_special_tokens=False), t.b.encode(texts, num_threads=1), strict=True):
            raw, ends = (" " + text).encode("utf-8"), np.cumsum([len(segments[i].encode("utf-8")) + 1 for i in block])
            made = []
            for ids, size, tokens in ((a.ids, t.lengths[0], t.a_bytes), (b, t.lengths[1], t.b_bytes)):
                flat = np.array(ids, np.int32)
                end = np.cumsum(size[flat])
                if b"".join(map(tokens.__getitem__, ids)) == raw and (end[np.searchsorted(end, ends)] == ends).all():
                    made.append((np.array(block)[np.searchsorted(ends, end)], flat))
            if len(made) == 2:
                for side, x in zip(found, made, strict=True):
                    side.append(x)
            else:
                alone += block
        good = np.array(sorted(set(range(len(segments))) - set(alone)), np.int64)
        if alone:
            some = [segments[i] for i in alone]
            a_ids, b_ids = [e.ids for e in t.a.encode_batch_fast([" " + s for s in some], add_special_tokens=False)], t.b.encode(some, num_threads=1)
            for i, s, a, b in zip(alone, some, a_ids, b_ids, strict=True):
                if b"".join(map(t.a_bytes.__getitem__, a)) == (" " + s).encode("utf-8") == b"".join(map(t.b_bytes.__getitem__, b)):
                    for side, ids in zip(found, (a, b), strict=True):
                        side.append((np.full(len(ids), i), np.array(ids, np.int32)))
                    good = np.append(good, i)
        sides = []
        for side in found:
            own, flat = (np.concatenate([x[k] for x in side]) if side else np.empty(0, np.int64) for k in (0, 1))
            order = np.argsort(own, kind="stable")
            sides.append((own[order].astype(np.int64), flat[order].astype(np.int32)))
        return sides, np.sort(good)

    @staticmethod
    def numbered(side: str) -> str:
        """Tokens with the number of their group, by a running sum over the common ends; `alone`: the only one of its side."""
        return f"""CREATE OR REPLACE TEMP TABLE {side}_num AS SELECT seg, id, s, e, count(c) OVER w - (c IS NOT NULL)::INT AS g, c IS NOT NULL AND lag(c, 1, 0) OVER w IS NOT NULL AS alone
              FROM (SELECT t.*, cut.e AS c FROM {side}_token t LEFT JOIN cut USING (e)) WINDOW w AS (ORDER BY s ROWS UNBOUNDED PRECEDING);"""

    def learn(self, segments: list[str]) -> None:
        t, first = self.tokens, len(self.groups)
        self.known.update((s, first + i) for i, s in enumerate(segments))
        self.chars += sum(map(len, segments))
        self.groups += [None] * len(segments)
        sides, good = self.encoded(segments)
        for name, (own, flat), size in zip("ab", sides, t.lengths, strict=True):
            end = np.cumsum(size[flat])
            kind = np.int32 if not len(end) or end[-1] < 2**31 else np.int64
            start = end - size[flat]
            self.con.register(name + "_in", pa.table({"seg": (own + first).astype(np.int32), "id": flat, "s": start.astype(kind), "e": end.astype(kind)}))
            self.con.execute(f"CREATE OR REPLACE TEMP TABLE {name}_token AS SELECT * FROM {name}_in")
            self.con.unregister(name + "_in")
        self.con.execute(f"""
            CREATE OR REPLACE TEMP TABLE cut AS SELECT e FROM a_token SEMI JOIN b_token USING (e);
            {self.numbered("a")}
            {self.numbered("b")}
            CREATE OR REPLACE TEMP TABLE one AS SELECT a.seg, g, a.id AS a, b.id AS b FROM a_num a JOIN b_num b USING (g) WHERE a.alone AND b.alone;
            CREATE OR REPLACE TEMP TABLE a_rest AS FROM a_num ANTI JOIN one USING (g);
            CREATE OR REPLACE TEMP TABLE b_rest AS FROM b_num ANTI JOIN one USING (g);
            INSERT INTO link SELECT seg, a, b, count(*) FROM (
              SELECT seg, a, b FROM one
              UNION ALL
              SELECT a.seg, a.id, b.id FROM a_rest a ASOF JOIN b_rest b ON a.s >= b.s
              UNION ALL
              SELECT a.seg, a.id, b.id FROM a_rest a JOIN b_rest b ON b.s > a.s AND b.s < a.e) GROUP BY ALL;
        """)  # fmt: skip
        # groups stand in the order of their numbers; most are one token on either side, and pairs of ids repeat
        read = lambda sql: self.con.execute(sql).fetchnumpy()
        one = read("SELECT seg, g, a, b FROM one")
        more = read("""
            SELECT seg, g, a.ids || '|' || b.ids AS ids, n_a, n_b FROM
              (SELECT seg, g, string_agg(id, ',' ORDER BY s) AS ids, count(*) AS n_a FROM a_rest GROUP BY seg, g) a JOIN (SELECT g, string_agg(id, ',' ORDER BY s) AS ids, count(*) AS n_b FROM b_rest GROUP BY g) b USING (g)
        """)
        pairs, which = np.unique(one["a"].astype(np.int64) << 32 | one["b"], return_inverse=True)
        said = np.empty(len(one["g"]) + len(more["g"]), object)
        of, sizes = np.zeros(len(said), np.int64), np.ones((2, len(said)), np.int64)
        said[one["g"]] = np.array([f"{x >> 32}|{x & 0xFFFFFFFF}" for x in pairs.tolist()], object)[which] if len(pairs) else []
        said[more["g"]], of[one["g"]], of[more["g"]], sizes[0][more["g"]], sizes[1][more["g"]] = more["ids"], one["seg"], more["seg"], more["n_a"], more["n_b"]
        ids, cut = said.tolist(), np.append(np.searchsorted(of, good + first), len(of)).tolist()
        for k, i, j in zip((good + first).tolist(), cut, cut[1:], strict=False):
            self.groups[k] = ";".join(ids[i:j])
        own = (of - first).astype(np.int64)
        n_a, n_b = (np.bincount(own, x, len(segments)).astype(np.int64)[good] for x in sizes)
        made = pa.table({"seg": (good + first).astype(np.int32), "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(own, minlength=len(segments))[good]})
        self.con.register("made", made)
        self.con.execute(f"INSERT INTO seg SELECT made.*, n FROM made JOIN (SELECT seg, sum(n) AS n FROM link WHERE seg >= {first} GROUP BY seg) USING (seg)")
        self.con.unregister("made")
        self.con.execute("".join(f"DROP TABLE {x};" for x in ("a_token", "b_token", "cut", "a_num", "b_num", "one", "a_rest", "b_rest")))

    def segments(self, text: str) -> Iterator[list[str]]:
        """The segments of a text, each without its leading space; one list for each part of the text."""
        if not self.tokens.free:
            yield [text]
            return
        at = 0
        while at <= len(text):
            m = _CUT.search(text, at + PART) if len(text) - at > PART else None
            part, at = (text[at : m.start()], m.end()) if m and m.end() < len(text) else (text[at:], len(text) + 1)
            found = _CUT.split(part)
            if not found[-1] and len(found) > 1:  # the text ends in a space
                found.pop()
                found[-1] += " "
            yield found

    def count(self, parts: list[tuple[int, int]], found: list[str]) -> list[str | None]:
        """Add these segments to sums and pairs, so many for each document as parts says; the groups of each are returned."""
        if len(self.known) > KEPT or self.chars > KEPT_CHARS:
            self.forget()
        new = [s for s in dict.fromkeys(found) if s not in self.known]
        for i in range(0, len(new), LEARNT):
            self.learn(new[i : i + LEARNT])
        k = np.fromiter(map(self.known.__getitem__, found), np.int32, len(found))
        docs, sizes = np.array(parts, np.int32).T
        self.con.register("given", pa.table({"doc": np.repeat(docs, sizes), "seg": k}))
        self.con.execute("""
            CREATE OR REPLACE TEMP TABLE held AS SELECT doc, seg, count(*) AS n FROM given GROUP BY ALL;
            INSERT INTO sums SELECT doc, sum(n * n_a), sum(n * n_b), sum(n * n_groups), sum(n * n_links) FROM held JOIN seg USING (seg) GROUP BY doc;
            INSERT INTO pairs SELECT doc, a, b, sum(held.n * link.n) FROM held JOIN link USING (seg) GROUP BY ALL;
        """)
        self.con.unregister("given")
        return list(map(self.groups.__getitem__, k.tolist()))

    def batch(self, texts: list[str | None], hashed: bool) -> tuple[list[list], list[pa.Array]]:
        """Counts and groups of each text; lists a, b and n of its linked pairs, and one list more of the whole batch's."""
        self.begin()
        say = [hashlib.sha256() if hashed else [] for _ in texts]
        begun, bad = [False] * len(texts), set()
        parts: list[tuple[int, int]] = []
        found: list[str] = []

        def flush() -> None:
            made, at = self.count(parts, found), 0
            for doc, n in parts:
                part, at = made[at : at + n], at + n
                if doc not in bad:
                    if None in part:
                        bad.add(doc)
                    else:
                        text = (";" if begun[doc] else "") + ";".join(part)
                        begun[doc] = True
                        say[doc].update(text.encode()) if hashed else say[doc].append(text)
            parts.clear()
            found.clear()

        for i, text in enumerate(texts):
            for part in self.segments(text) if text else ():
                parts.append((i, len(part)))
                found += part
                if len(found) >= SEGMENTS:
                    flush()
        if found:
            flush()
        self.con.register("bad", pa.table({"doc": pa.array(sorted(bad), pa.int32())}))
        self.con.execute("DELETE FROM sums WHERE doc IN (FROM bad); DELETE FROM pairs WHERE doc IN (FROM bad)")
        self.con.unregister("bad")
        out: list[list] = [[0] * len(texts) for _ in range(4)]
        for doc, *n in self.con.execute("SELECT doc, sum(n_a)::BIGINT, sum(n_b)::BIGINT, sum(n_groups)::BIGINT, sum(n_links)::BIGINT FROM sums GROUP BY doc").fetchall():
            for column, x in zip(out, n, strict=True):
                column[doc] = x
        done = [begun[i] and i not in bad for i in range(len(texts))]
        out.append([("" if not ok else x.hexdigest() if hashed else "".join(x)) for ok, x in zip(done, say, strict=True)])
        links = self.con.execute("SELECT doc, a, b, sum(n)::BIGINT AS n FROM pairs GROUP BY ALL ORDER BY doc").fetchnumpy()
        ends = np.append(np.searchsorted(links["doc"], np.arange(len(texts))), [len(links["doc"])] * 2)  # the last row is the batch's
        total = self.con.execute("SELECT a, b, sum(n)::BIGINT AS n FROM pairs GROUP BY a, b").fetchnumpy()
        ends[-1] += len(total["a"])
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([links[c], total[c]]).astype(kind))) for c, kind in (("a", "i4"), ("b", "i4"), ("n", "i8"))]
        return out, lists


@lru_cache(maxsize=1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    """One for each Python worker, so that its later tasks know the segments of its earlier ones."""
    return Aligner(Tokens(a_path, b_path))


def aligned(df: DataFrame, column: str = "text", hashed: bool = False, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """df without the text, with counts, groups (their SHA-256 if `hashed`) and linked id pairs (a, b, n) of each row.

    Rows with `partial` hold the pairs of a whole batch instead, and nulls; Spark merges them.
    """
    paths = a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)
    names = [c for c in df.columns if c != column and c.lower() not in {f.name for f in _ADDED}]
    df = df.select(*names, F.col(column).cast("string").alias("_text"))
    kept = [T.StructField(f.name, f.dataType) for f in df.schema.fields[:-1]]
    schema = T.StructType([*kept, *_ADDED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*paths)
        for b in slices((pa.RecordBatch.from_arrays(x.columns, [*(f"c{i}" for i in range(x.num_columns - 1)), "text"]) for x in batches), "text", 4 << 20):
            try:
                out, lists = aligner.batch(b.column("text").to_pylist(), hashed)
            except BaseException:
                _aligner.cache_clear()  # it may have stopped half-way
                raise
            made = [*(pa.array([*x, None], pa.string() if i == 4 else pa.int64()) for i, x in enumerate(out)), *lists, pa.array([False] * b.num_rows + [True])]
            own = [pa.concat_arrays([c, pa.nulls(1, c.type)]) for c in b.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*own, *made], names=[f.name for f in schema])

    return df.mapInArrow(run, schema)


def totals(parts: DataFrame) -> DataFrame:
    """Links of each id pair over all rows, and whether no other A id is linked as often to the B id."""
    pairs = parts.select(F.explode(F.arrays_zip("a", "b", "n")).alias("x")).groupBy("x.a", "x.b").agg(F.sum("x.n").alias("total"))
    return pairs.withColumn("best", F.col("total") == F.max("total").over(Window.partitionBy("b")))  # at most A's vocabulary a window


def align(df: DataFrame, store: Store, column: str = "text", hashed: bool = False, broadcast_pairs: int = BROADCAST_PAIRS, **paths: str) -> DataFrame:
    """df without the text, with n_a, n_b, n_groups, n_links, n_best, count_sum, groups, and a, b, n: its id pairs and how often it links them."""
    rows = store.save(aligned(df.withColumn("_row", F.monotonically_increasing_id()), column, hashed, **paths), "aligned", "partial")
    pairs = store.save(totals(rows.where("partial")), "pairs")
    docs = rows.where("NOT partial").drop("partial")
    links = docs.select("_row", F.explode(F.arrays_zip("a", "b", "n")).alias("x")).select("_row", "x.a", "x.b", "x.n")
    if pairs.count() <= broadcast_pairs:
        joined = links.join(F.broadcast(pairs), ["a", "b"])
    else:
        salted = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = links.withColumn("salt", F.pmod("_row", F.lit(SALTS)).cast("int")).join(salted, ["a", "b", "salt"])
    sums = joined.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum"))
    out = docs.drop(*(c for c in docs.columns if c.lower() in ("n_best", "count_sum"))).join(sums, "_row", "left").drop("_row")
    return out.na.fill(0, ["n_best", "count_sum"])


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "alignment")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = align(docs, store, hashed=True)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
