"""Byte-level BPE, source divergence and tokenizer alignment."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from pyspark.sql import functions as F

from lakequill.llm import alignment, byte_bpe, divergence
from lakequill.llm.common import Store

rng = random.Random(4)
LETTERS = "abcdefghijklmnopqrstuvwxyz"


@pytest.fixture(scope="module")
def library():
    with open(public.path(byte_bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(library, text):
    return np.array(library.encode_ordinary(text or ""), "<u4").tobytes()


class TestByteBpe:
    vocabulary = byte_bpe.vocabulary(public.path(byte_bpe.RANKS), public.PATTERN)

    def agree(self, library, texts):
        got = self.vocabulary.encode(texts)
        assert got == [packed(library, t) for t in texts]
        assert [self.vocabulary.decode(x) for x in got] == [(t or "").encode() for t in texts]

    def test_mixed_texts(self, library):
        parts = [" ", "  ", "\n", "\t", "\r\n", "the", " the", "1234", "!?", "'s", "'ll", "é", "ß", "中文", "нет", "🙂", "\x00", "\x1c", "\x85", "　", "<|endoftext|>", "x" * 60]
        self.agree(library, [None, "", " ", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 80))) for _ in range(300))])

    def test_long_matches(self, library):
        runs = [x * n for x in ("a", "ab", "aab", "z", "中", "é") for n in (1, 2, 299, 300, 301, 302, 3000)]
        random_runs = ["".join(rng.choice(LETTERS[: rng.randint(1, 26)]) for _ in range(rng.randint(250, 3000))) for _ in range(60)]
        han = ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(rng.randint(90, 900))) for _ in range(20)]
        self.agree(library, [*runs, *random_runs, *han])

    def test_long_and_short_ways_agree(self):
        v = self.vocabulary
        for _ in range(200):
            word = "".join(rng.choice("aeinst" if rng.random() < 0.5 else LETTERS) for _ in range(rng.randint(2, 200))).encode()
            out = [np.empty(0, np.int32)]
            v.merge_rows([word], [0], 200, out)
            assert v.merge_long(v.single[np.frombuffer(word, np.uint8)]).tolist() == out[0].tolist()

    def test_small_bounds(self, library, monkeypatch):
        """Blocks of matches, of cells and the memory of matches don't show."""
        for name, value in (("MATCHES", 7), ("CELLS", 64), ("KEPT", 5), ("PLACES", 3)):
            monkeypatch.setattr(byte_bpe, name, value)
        v = byte_bpe.Vocabulary(public.path(byte_bpe.RANKS), public.PATTERN)
        texts = [" ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 40))) for _ in range(30)] + ["b" * 700]
        assert v.encode(texts) == [packed(library, t) for t in texts]

    def test_frame(self, spark, library):
        rows = [(1, "Hello, world", "kept"), (1, "Hello, world", "kept"), (None, None, None), (2, "", "x"), (3, "word " * 200_000, "long")]
        df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
        store = Store(spark, "t")
        coded = byte_bpe.encode(df, store)
        assert coded.columns == ["doc_id", "text", "ids"]
        out = byte_bpe.decode(coded, store).withColumn("list", byte_bpe.as_array(F.col("ids"))).collect()
        assert sorted((r.doc_id or 0, bytes(r.ids), bytes(r.decoded)) for r in out) == sorted((d or 0, packed(library, t), (t or "").encode()) for d, t, _ in rows)
        assert all(len(r.list) < 1000 or r.doc_id == 3 for r in out) and [r.list for r in out if r.doc_id == 1][0] == library.encode_ordinary("Hello, world")
        assert byte_bpe.encode(df.limit(0), store).count() == 0
        assert byte_bpe.decode(spark.createDataFrame([(None,)], "ids binary"), store).first().decoded is None

    def test_wrong_ids(self):
        for bad in (b"abc", (60_000).to_bytes(4, "little")):
            with pytest.raises(ValueError):
                self.vocabulary.decode(bad)


class TestDivergence:
    def brute(self, rows, least, top):
        import re

        count, docs = defaultdict(Counter), Counter()
        for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
            words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
            count[lang, source].update(words)
            docs.update((lang, w) for w in set(words))
        kept = defaultdict(list)
        for (lang, w), n in docs.items():
            if n >= least:
                kept[lang].append(w)
        out = []
        share = lambda n, total, v: 1 + 10**9 * (n + 5) // (total + 5 * v)
        of = lambda c, words: {w: share(c[w], sum(c[x] for x in words), len(words)) for w in words}
        for (lang, source), c in count.items():
            words, p = kept[lang], of(c, kept[lang])
            everywhere = of(sum((x for (k, _), x in count.items() if k == lang), Counter()), words)
            parts = {"pair": [(sum(abs(p[w] - q) for w, q in of(x, words).items()), s) for (k, s), x in count.items() if k == lang and s != source], "term": [(p[w] - everywhere[w], w) for w in words if c[w] and p[w] > everywhere[w]]}
            for part, found in parts.items():
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(found[: top if part == "term" else None], 1)]
        return sorted(out)

    def test_against_brute_force(self, spark):
        words = [*"abcdefgh", "Über", "über", "ÜBER", "naïve", "中文", "Straße", "don't", "x1y", "A_B", " nb", "🙂"]
        rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "é", "z", "Z", None]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for _ in range(300)]
        rows += [("fr", "one", None), ("fr", "two", "1 2 3"), ("fr", "two", ""), ("it", "only", "solo"), (None, None, None)]
        rows += [("en", "hot", "a b c " * 50)] * 100
        docs = spark.createDataFrame([(i, t, lang, s, "x") for i, (lang, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, term string")
        expected = self.brute(rows, 4, 3)
        for more in ({}, {"block": 2, "chunk": 3, "segment": 2}, {"block": 1, "chunk": 5, "segment": 1}):
            got = divergence.audit(docs, Store(spark, "t"), least_docs=4, top=3, **more)
            assert sorted(map(tuple, got.collect())) == expected
        assert divergence.audit(docs.limit(0), Store(spark, "t")).count() == 0

    def test_long_text_in_parts(self, monkeypatch):
        monkeypatch.setattr(divergence, "PART", 5)
        text = "Alpha beta, gamma-delta 12 épsilon " * 20
        assert sum((Counter(x) for x in divergence.terms(text)), Counter()) == Counter({w.encode(): 20 for w in ("alpha", "beta", "gamma", "delta", "épsilon")})

    def test_shares_are_exact(self):
        n, total = [rng.randrange(10**k) for k in range(1, 15)], 10**15 - 1
        got = divergence.shares(np.array(n, np.int64), np.array([total] * len(n), np.int64))
        assert got.tolist() == [1 + 10**9 * (x + 5) // total for x in n]


class TestAlignment:
    tokens = alignment.Tokens(public.path(alignment.A_FILE), public.path(alignment.B_FILE))

    def brute(self, texts):
        """One pass over both token lists of each whole text."""
        rows, total = [], Counter()
        for text in texts:
            raw = (" " + (text or "")).encode()
            a = self.tokens.a.encode(" " + (text or ""), add_special_tokens=False).ids
            b = self.tokens.b.encode(text or "")
            bytes_a, bytes_b = [self.tokens.a_bytes[k] for k in a], [self.tokens.b_bytes[k] for k in b]
            if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
                rows.append((0, 0, "", {}))
                continue
            end_a, end_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
            links, groups, group, i, j = Counter(), [], ([], []), 0, 0
            while i < len(a):
                links[a[i], b[j]] += 1
                x, y = end_a[i], end_b[j]
                if x <= y:
                    group[0].append(a[i])
                    i += 1
                if y <= x:
                    group[1].append(b[j])
                    j += 1
                if x == y:
                    groups.append("|".join(",".join(map(str, side)) for side in group))
                    group = ([], [])
            rows.append((len(a), len(b), ";".join(groups), dict(links)))
            total.update(links)
        return rows, total

    def texts(self):
        parts = [" ", "  ", "\n", "\n  ", "\t", "a", " the", "über", "中文", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "\x00", "17", "don't", "　", "\xa0", "\x1c", "\x85", "q" * 30, "🙂", ".", ", "]
        return [None, "", " ", "  ", "\n", "a▁b", "ends ", " begins", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 50))) for _ in range(150))]

    def test_vocabularies(self):
        assert self.tokens.free and all(self.tokens.a_bytes[k] for k in range(50_256))

    @pytest.mark.parametrize("small", [False, True])
    def test_batches(self, monkeypatch, small):
        if small:
            for name, value in (("PART", 20), ("SEGMENTS", 4), ("KEPT", 6)):
                monkeypatch.setattr(alignment, name, value)
        texts = self.texts()[: 60 if small else None]
        rows, total = self.brute(texts)
        out, lists = alignment.Aligner(self.tokens).batch(texts, False)
        *links, sums = [dict(zip(zip(x, y, strict=True), n, strict=True)) for x, y, n in zip(*(x.to_pylist() for x in lists), strict=True)]
        got = [(a, b, groups, own) for a, b, _, _, groups, own in zip(*out, links, strict=True)]
        assert got == rows and sums == total
        assert out[2] == [len(r[2].split(";")) if r[2] else 0 for r in rows] and out[3] == [sum(r[3].values()) for r in rows]

    def test_whole_texts_where_segments_are_not_free(self, monkeypatch):
        monkeypatch.setattr(self.tokens, "free", False)
        texts = self.texts()[:40]
        out, _ = alignment.Aligner(self.tokens).batch(texts, True)
        assert out[4] == [hashlib.sha256(r[2].encode()).hexdigest() if r[2] else "" for r in self.brute(texts)[0]]

    @pytest.mark.parametrize("most", [10**6, 0])
    def test_frame(self, spark, most):
        """Both ways to the totals; repeated ids and rows, clashing names."""
        texts = [*self.texts()[:50], "the same text", "the same text"]
        rows, total = self.brute(texts)
        best = defaultdict(int)
        for (_, b), n in total.items():
            best[b] = max(best[b], n)
        expected = Counter((a, b, groups, sum(links.values()), sum(n for (x, y), n in links.items() if total[x, y] == best[y]), sum(n * total[p] for p, n in links.items())) for a, b, groups, links in rows)
        df = spark.createDataFrame([(7, t, "x", "y", "z") for t in texts], "doc_id long, text string, n_best string, groups string, salt string").repartition(3)
        out = alignment.align(df, Store(spark, "t"), broadcast_pairs=most)
        assert {"doc_id", "salt"} <= set(out.columns) and "text" not in out.columns
        assert Counter((r.n_a, r.n_b, r.groups, r.n_links, r.n_best, r.count_sum) for r in out.collect()) == expected

    def test_empty(self, spark):
        assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), Store(spark, "t")).count() == 0
