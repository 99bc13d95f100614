"""Line dedup, SimHash, suffix dedup and embedding dedup against brute force, and their edge cases."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import xxhash

from lakequill.llm import embedding_dedup, line_dedup, simhash, suffix_dedup
from lakequill.llm.common import Store
from lakequill.llm.components import connected_components

DOC = "doc_id long, text string"


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def texts(seed, n, alphabet="abcdefghij", longest=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 6))) for _ in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(0, longest))) for _ in range(n // 3)]
    out = []
    for _ in range(n):
        w = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out


class TestComponents:
    def test_random_graph_chain_and_star(self, spark):
        rng = random.Random(3)
        pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(200 + i, 201 + i) for i in range(60)] + [(300, 301 + i) for i in range(50)]
        got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), Store(spark, "t")).collect()}
        expected = roots(400, pairs)
        assert got == {x: expected[x] for p in pairs if p[0] != p[1] for x in p} | {x: expected[x] for x in got}
        assert len(got) == len({x for p in pairs if p[0] != p[1] for x in p})

    def test_no_edges(self, spark):
        assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long"), Store(spark, "t")).count() == 0


class TestLines:
    def brute(self, rows, points=40, docs=5):
        key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
        held = defaultdict(set)
        for d, t in rows:
            for x in (t or "").split("\n"):
                if len(key(x)) >= points:
                    held[key(x)].add(d)
        owner = {k: max(v) for k, v in held.items() if len(v) >= docs}
        out = {}
        for d, t in rows:
            lines = (t or "").split("\n")
            kept = [x for x in lines if d >= owner.get(key(x), d)]
            out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
        return out

    def test_against_brute_force(self, spark):
        rng = random.Random(5)
        pool = ["é" * 39 + str(i % 10) for i in range(8)] + ["short"] * 3 + [f"Line number {i} with Some Words to be long enough ok" for i in range(25)]
        dress = lambda s: rng.choice(["", " ", "\t"]) + rng.choice([s, s.upper() if s.isascii() else s]) + rng.choice(["", "\x0b", " \r"])
        rows = [(i, "\n".join(dress(rng.choice(pool)) for _ in range(rng.randint(0, 9)))) for i in rng.sample(range(500), 80)] + [(1000, None), (1001, "")]
        for batches, fanout in ((4, 4), (7, 2), (1, 9)):
            got = line_dedup.drop_frequent_lines(spark.createDataFrame(rows, DOC), Store(spark, "t"), batches=batches, fanout=fanout).collect()
            assert {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in got} == self.brute(rows)
        assert sum(v[1] for v in self.brute(rows).values()) > 50

    def test_runs_are_merged_block_by_block(self, spark, tmp_path, monkeypatch):
        monkeypatch.setattr(line_dedup, "BLOCK", 7)
        rng, expected, folders = random.Random(8), defaultdict(lambda: [0, None]), []
        for k in range(5):
            hs = sorted(rng.sample([b"%03d" % i for i in range(200)], rng.choice([0, 3, 60, 150])))
            rows = [(h, rng.randint(1, 9), rng.choice([None, rng.randint(-5, 99)])) for h in hs]
            folders.append(f"file://{tmp_path}/run-{k}")
            out = line_dedup._RunFile(folders[-1], 0)
            out.write(line_dedup.pa.Table.from_pylist([dict(zip(("h", "n_docs", "owner"), r, strict=True)) for r in rows], line_dedup._ENTRY))
            assert out.close() == len(rows)
            for h, n, o in rows:
                e = expected[h]
                e[0], e[1] = e[0] + n, max((x for x in (e[1], o) if x is not None), default=None)
        got = [(r["h"], r["n_docs"], r["owner"]) for t in line_dedup._merge(line_dedup._cursors(folders, 0)) for r in t.to_pylist()]
        assert got == sorted((h, *e) for h, e in expected.items())

    def test_compaction_comes_in_mid_course(self, spark):
        store = line_dedup.LineStore(Store(spark, "t"), min_docs=3, fanout=2, parts=3)
        rng = random.Random(4)
        held = {(h, d) for d in range(70) for h in rng.sample([hashlib.md5(b"%d" % i).digest() for i in range(90)], 8)}
        for k in range(7):
            store.add(spark.createDataFrame([(h, d) for h, d in held if d % 7 == k], "h binary, doc_id long"))
            assert all(len(level) < 2 for level in store.levels)
        assert len(store.levels) == 3 and all(r.count() for r in store.runs())
        owners = defaultdict(set)
        for h, d in held:
            owners[h].add(d)
        assert {bytes(r.h): r.owner for r in store.frequent().collect()} == {h: max(v) for h, v in owners.items() if len(v) >= 3}

    def test_very_long_texts(self, spark):
        shared = "\n".join(f"shared line number {i} that is long enough to count" for i in range(20_000))
        rows = [(i, shared + f"\nown line of document {i}, which is also long enough") for i in range(5)]
        got = sorted(line_dedup.drop_frequent_lines(spark.createDataFrame(rows, DOC), Store(spark, "t")).collect())
        assert [(r.n_lines, r.n_dropped) for r in got] == [(20_001, 20_000)] * 4 + [(20_001, 0)]

    def test_settled_lines_are_not_added_again(self, spark):
        store = line_dedup.LineStore(Store(spark, "t"), min_docs=2, fanout=9)
        line = lambda *docs: spark.createDataFrame([(b"x", d) for d in docs], "h binary, doc_id long")
        store.add(line(8, 9))
        store.add(line(1, 2))
        assert [r.count() for r in store.runs()] == [1, 0]
        store.add(line(20))
        assert store.frequent().collect()[0].owner == 20

    def test_edge_cases(self, spark):
        rows = [(None, "a line that is long enough to be counted, yes", 1, "q")] + [(i, "a line that is long enough to be counted, yes", 1, "q") for i in (1, 1, 2, 3, 4)]
        df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, __x string")
        got = sorted(line_dedup.drop_frequent_lines(df, Store(spark, "t")).collect(), key=lambda r: r.doc_id or 0)
        assert [r.n_dropped for r in got] == [1, 1, 1, 1, 1, 0]
        assert line_dedup.drop_frequent_lines(spark.createDataFrame([], DOC), Store(spark, "t")).count() == 0


class TestSimHash:
    def fingerprint(self, text, words=4):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
        import re

        w = re.findall(rb"[^\x20\x09-\x0d]+", w)
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))] if w else []
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    def test_against_brute_force(self, spark):
        rows = list(enumerate([*texts(1, 300), "", None, " \t", "Äß", "One", "one", "a b c", "x " * 3000]))
        got = {r.doc_id: r for r in simhash.group(spark.createDataFrame(rows, DOC), Store(spark, "t"), words=4, bits=64, radius=4, tile=40).collect()}
        fps = [self.fingerprint(t) for _, t in rows]
        assert [int(got[i].fp.hex(), 16) for i in range(len(rows))] == fps
        expected = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
        assert [got[i].component_id for i in range(len(rows))] == expected
        assert len(set(expected)) < len(expected)

    def test_wide_fingerprints_compare_exactly(self):
        rng = np.random.default_rng(0)
        a = rng.integers(0, 1 << 64, (60, 8), dtype=np.uint64)
        near = a[:20].copy()
        near[:, 5] ^= np.uint64(0b1011)
        both = np.concatenate([a, near])
        both = both[np.bitwise_count(both).sum(1).argsort(kind="stable")]
        found = simhash.tile_links(both, both, 3, True)
        assert len(found) == 20 and all(np.bitwise_count(both[i] ^ both[j]).sum() <= 3 for i, j in found)

    def test_edge_cases(self, spark):
        df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (3, "other words are in this one")], DOC).withColumnRenamed("x", "y")
        got = simhash.group(df, Store(spark, "t"), words=4, bits=64, radius=4).collect()
        assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, 7), (3, 3), (7, 7), (7, 7)]
        assert simhash.group(spark.createDataFrame([], DOC), Store(spark, "t"), words=4, bits=64, radius=4).count() == 0

    def test_stage_keeps_one_of_each_group(self, spark):
        rng = random.Random(2)
        word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
        base = [[word() for _ in range(200)] for _ in range(6)]
        near = [[*w[:100], word(), *w[101:]] for w in base[:3]]
        rows = [(i, " ".join(w)) for i, w in enumerate(base + near + base[:1])]
        kept = {r.doc_id for r in simhash.simhash_stage(spark, spark.createDataFrame(rows, DOC), "").collect()}
        assert kept == {0, 1, 2, 3, 4, 5}

    def test_stage_finds_short_texts(self, spark):
        rng = random.Random(6)
        word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
        base = [[word() for _ in range(8)] for _ in range(60)]
        rows = list(enumerate([" ".join(w) for w in base] + [" ".join([*w, word()]) for w in base]))  # four shingles of five are common
        kept = {r.doc_id for r in simhash.simhash_stage(spark, spark.createDataFrame(rows, DOC), "").collect()}
        assert kept == set(range(60))

    def test_stage_asks_past_rejected_links(self, spark):
        rng = random.Random(9)
        word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
        cut = lambda w, *at: [word() if i in at else x for i, x in enumerate(w)]
        rows = []
        for _ in range(6):
            a = [word() for _ in range(204)]
            # copies lie 20 or more shingles from the last text, a itself is 0.8 similar to it and no nearer than they are
            rows += [a, *(cut(a, 10 + 20 * k) for k in range(8)), cut(a, 20, 60, 100, 140)]
        rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
        sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
        expected = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
        df = spark.createDataFrame(rows, DOC)
        for tile in (simhash.TILE, 16):
            got = {r.doc_id: r.component_id for r in simhash.group(df, Store(spark, "t"), tile=tile, more=1).collect()}
            assert [got[i] for i in range(len(rows))] == expected
        assert len(set(expected)) == 6

    def test_stage_joins_a_large_group_as_all_pairs_do(self, spark):
        rng = random.Random(1)
        word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(6))
        base, rows = [word() for _ in range(100)], []
        for _ in range(1500):
            w = list(base)
            for _ in range(rng.randint(1, 5)):
                w[rng.randrange(100)] = word()
            rows.append(" ".join(w))
        rows = list(enumerate(rows + [" ".join(word() for _ in range(100)) for _ in range(500)]))
        rng.shuffle(rows)
        sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
        expected = roots(2000, [(i, j) for i in range(1500) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
        got = {r.doc_id: r.component_id for r in simhash.group(spark.createDataFrame(rows, DOC), Store(spark, "t"), tile=256).collect()}
        assert [got[i] for i in range(2000)] == expected
        assert 501 < len(set(expected)) < 1500  # a large group, and copies that reach nothing

    def test_clashing_columns_and_long_texts(self, spark):
        long = " ".join(f"w{i}" for i in range(150_000))
        rows = [(1, long, 1, "k"), (2, long + " and some more", 2, "k"), (3, "short text of a few words", 3, "k")]
        df = spark.createDataFrame(rows, "doc_id long, text string, ones int, key string")
        assert sorted(r.doc_id for r in simhash.simhash_stage(spark, df, "").collect()) == [1, 3]
        assert simhash.simhash_stage(spark, df, "").columns == df.columns

    def test_stage_compares_sets_of_shingles(self, spark):
        rng = random.Random(4)
        word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
        ruled = [" ".join(["0"] * 300 + [word() for _ in range(100)]) for _ in range(2)]  # one shingle is over half of all
        w = [word() for _ in range(300)]
        rows = list(enumerate([*ruled, " ".join(w), " ".join(w[:150] + w[100:150] * 20 + w[150:])]))
        kept = {r.doc_id for r in simhash.simhash_stage(spark, spark.createDataFrame(rows, DOC), "").collect()}
        assert kept == {0, 1, 2}


class TestSuffixes:
    def brute(self, docs, n=100):
        seen, out = set(), {}
        for d, t in sorted(docs):
            mask = bytearray(len(t))
            for i in range(len(t) - n + 1):
                if t[i : i + n] in seen:
                    mask[i : i + n] = b"\1" * n
                seen.add(t[i : i + n])
            kept = bytes(c for c, m in zip(t, mask, strict=True) if not m)
            out[d] = (len(t), sum(mask), sum(1 for i, m in enumerate(mask) if m and not (i and mask[i - 1])), kept)
        return out

    def test_construction(self):
        rng = random.Random(1)
        for _ in range(15):
            pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 40))]
            for spill in (1 << 30, 1):
                c = suffix_dedup.Construction(pieces, 5, spill)
                groups = defaultdict(set)
                for m, o, g in zip(c.member, c.offset, c.group, strict=True):
                    groups[int(g)].add(pieces[m][o : o + 5])
                assert all(len(v) == 1 for v in groups.values())
                assert len(groups) == len({p[i : i + 5] for p in pieces for i in range(len(p) - 4)})
                assert len(c.member) == sum(max(0, len(p) - 4) for p in pieces)

    def test_against_brute_force(self, spark):
        rng = random.Random(1)
        base = ["".join(rng.choice("abcdéf gh") for _ in range(rng.randint(0, 400))) for _ in range(30)]
        docs = []
        for i in range(100):
            a, b = rng.choice(base), rng.choice(base)
            t = rng.choice([a, a[rng.randint(0, 50) :] + b[: rng.randint(50, 400)] + a, "xy" * rng.randint(0, 200), None, "z" * 300])
            docs.append((i * 7 % 307, t))
        expected = self.brute([(d, (t or "").encode()) for d, t in docs])
        for hot in (20_000, 2):
            got = suffix_dedup.remove_repeats(spark.createDataFrame(docs, DOC), Store(spark, "t"), hot=hot, bucket=3000).collect()
            assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == expected

    def test_construction_of_wide_symbols_has_few_columns(self, monkeypatch):
        rng = random.Random(5)
        text = bytes(rng.choice(b"ab") for _ in range(400))
        pieces = [text[i : i + rng.randint(90, 168)] for i in (rng.randint(0, 200) for _ in range(50))] + [b"", b"\xff" * 168, b"\0" * 120]
        columns, keep = [], suffix_dedup._Columns.keep
        monkeypatch.setattr(suffix_dedup._Columns, "keep", lambda self, name, a, column: columns.append(column) or keep(self, name, a, column))
        for spill in (1 << 30, 1):
            c = suffix_dedup.Construction(pieces, 100, spill)
            groups = defaultdict(set)
            for m, o, g in zip(c.member, c.offset, c.group, strict=True):
                groups[int(g)].add(pieces[m][o : o + 100])
            assert all(len(v) == 1 for v in groups.values())
            assert len(groups) == len({p[i : i + 100] for p in pieces for i in range(len(p) - 99)})
            assert len(c.member) == sum(max(0, len(p) - 99) for p in pieces)
        assert max(columns) <= 9  # 42 by symbols of four bytes

    def test_anchors_of_texts_together_and_alone(self):
        rng = random.Random(6)
        texts = [bytes(rng.choice(b"abc") for _ in range(rng.choice([0, 50, 99, 100, 101, 300, 2000]))) for _ in range(60)] + [b"z" * 500]
        sizes = np.array([len(t) for t in texts])
        got = list(zip(*suffix_dedup.runs(np.frombuffer(b"".join(texts), np.uint8), sizes=sizes), strict=True))
        begin = np.cumsum(sizes) - sizes
        expected = [(m, p, f + a, c) for t, a in zip(texts, begin, strict=True) for m, p, f, c in zip(*suffix_dedup.runs(np.frombuffer(t, np.uint8)), strict=True)]
        assert got == expected

    def test_edge_cases(self, spark):
        long = "0123456789" * 30
        rows = [(None, long), (5, long), (5, long), (5, "other " + long), (9, "")]
        got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOC), Store(spark, "t")).collect()
        assert sorted((r.doc_id or -1, r.n_bytes) for r in got) == [(-1, 300), (5, 300), (5, 300), (5, 306), (9, 0)]
        assert next(r for r in got if r.doc_id is None).n_removed == 300
        same = [r.n_removed for r in got if r.n_bytes == 300 and r.doc_id]
        assert len(set(same)) == 1
        assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOC), Store(spark, "t")).count() == 0

    def test_hot_passage_between_other_neighbours(self, spark, monkeypatch):
        monkeypatch.setattr(suffix_dedup, "WINDOWS", 40)
        rng = random.Random(3)
        passage = "".join(rng.choice("abcdefgh ") for _ in range(130))
        docs = [(i, "".join(rng.choice("ijklmnop") for _ in range(rng.randint(0, 150))) + passage + "".join(rng.choice("qrstuvw") for _ in range(rng.randint(0, 150)))) for i in rng.sample(range(1000), 120)]
        expected = self.brute([(d, t.encode()) for d, t in docs])
        for hot in (5, 20_000):
            store = Store(spark, "t")
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
            got = suffix_dedup.remove_repeats(spark.createDataFrame(docs, DOC), store, hot=hot, bucket=2000, spill_bytes=1 if hot == 5 else suffix_dedup.SPILL).collect()
            assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == expected
        assert sum(v[1] for v in expected.values()) >= 119 * 130

    def test_texts_longer_than_a_slice(self, spark, monkeypatch):
        monkeypatch.setattr(suffix_dedup, "_SLICE", 1 << 12)
        rng = random.Random(5)
        long = "".join(rng.choice("abcdef") for _ in range(20_000))
        docs = [(1, long), (2, "x" * 50 + long[5000:12_000] + "y" * 300), (3, long[:99])]
        got = suffix_dedup.remove_repeats(spark.createDataFrame(docs, DOC), Store(spark, "t")).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == self.brute([(d, t.encode()) for d, t in docs])

    def test_pieces_hold_every_window_once(self):
        rng = np.random.default_rng(0)
        data = rng.integers(97, 100, 5000).astype(np.uint8)
        _, _, first, count = suffix_dedup.runs(data)
        assert count.sum() == 4901 and (first[1:] == first[:-1] + count[:-1]).all() and count.max() <= 69


class TestEmbeddings:
    def test_against_brute_force(self, spark):
        rng = np.random.default_rng(4)
        x = rng.normal(size=(400, 16))
        x[200:300] = x[:100] + rng.normal(size=(100, 16)) * rng.choice([0.05, 0.3, 0.5], (100, 1))
        x[300:350] = x[7]
        x[350:380] = x[8] * 3 + rng.normal(size=(30, 16)) * 0.2
        x = x.astype(np.float32)
        got = {r.vec_id: r for r in embedding_dedup.group(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), Store(spark, "t"), tile=50, sample=100).collect()}
        u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        link = u @ u.T >= 0.9
        np.fill_diagonal(link, False)
        expected = roots(400, zip(*np.nonzero(link), strict=True))
        assert [got[i].n_links for i in range(400)] == link.sum(1).tolist()
        assert [got[i].component_id for i in range(400)] == expected
        assert [got[i].kept for i in range(400)] == [i == e for i, e in enumerate(expected)]

    def test_blocks_of_64_dimensions_with_several_leaves(self, spark):
        rng = np.random.default_rng(2)
        x = rng.normal(size=(1500, 64))
        x[500:900] = x[:400] + rng.normal(size=(400, 64)) * rng.choice([0.1, 0.45, 0.5], (400, 1))
        x[900:1200] = x[3] + rng.normal(size=(300, 64)) * 0.45  # a group whose members lie on either side of the threshold
        x[1200:1210] = x[5] * rng.uniform(0.1, 9, (10, 1))
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        link = u @ u.T >= 0.9
        np.fill_diagonal(link, False)
        expected = roots(1500, zip(*np.nonzero(link), strict=True))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = {r.vec_id: r for r in embedding_dedup.group(df, Store(spark, "t"), tile=100, sample=300).collect()}
        assert [got[i].n_links for i in range(1500)] == link.sum(1).tolist()
        assert [got[i].component_id for i in range(1500)] == expected

    def test_every_link_has_one_block_and_lies_within_its_budget(self):
        rng = np.random.default_rng(3)
        for dim, blocks in ((64, 8), (13, 5), (7, 8)):
            x = rng.normal(size=(300, dim))
            x[150:] = x[:150] + rng.normal(size=(150, dim)) * rng.uniform(0, 0.6, (150, 1))
            u = embedding_dedup.unit(x)
            grid, edges, most = embedding_dedup.on_grid(u), embedding_dedup.block_edges(dim, blocks), embedding_dedup.most_apart(dim, 0.9)
            by = np.stack([embedding_dedup.distances(grid[:, lo:hi], grid[:, lo:hi]) / (hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)])
            link = u @ u.T >= 0.9
            assert (by.min(0)[link] <= most / dim).all() and link.sum() > 400

    def test_edge_cases(self, spark):
        nan, inf = float("nan"), float("inf")
        rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [1e200, 1.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [5.0, 0.0]), (10, [-1.0, 0.0])]
        got = embedding_dedup.group(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Store(spark, "t")).collect()
        found = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in got)
        assert found == [(-1, 3, 7, False), *((i, 0, i, True) for i in range(1, 7)), (7, 3, 7, True), (8, 3, 7, False), (8, 3, 7, False), (9, 0, 9, True), (10, 0, 10, True)]
        assert embedding_dedup.group(spark.createDataFrame([], "vec_id long, embedding array<float>"), Store(spark, "t")).count() == 0


def test_hashes_are_stable():
    assert hashlib.sha256(simhash.shingle_hashes("The quick brown fox jumps", 4).tobytes()).hexdigest() == hashlib.sha256(np.array([xxhash.xxh64_intdigest(b"the quick brown fox", 42), xxhash.xxh64_intdigest(b"quick brown fox jumps", 42)], np.uint64).tobytes()).hexdigest()
