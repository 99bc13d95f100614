"""Decontamination, toxicity, mixing and the pipeline."""

import hashlib
import random
import re
from collections import Counter
from math import exp

import corpus_pipeline
from lakequill.llm import decontaminate, mixing, toxicity
from lakequill.llm.common import Store

DOC = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(12)
WORDS = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 7))) for _ in range(400)]
say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))


class TestDecontamination:
    item = "A train leaves Paris at 7 with Alice and travels 120 km in 2 hours while Bob walks 7 miles to meet Alice at the old station"

    def leaks(self, spark, docs, items=None):
        bench = spark.createDataFrame(items or [(1, self.item), (2, None), (3, "too short"), (None, self.item)], "item_id long, text string")
        return {(r.doc_id, r.item_id): r for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench, Store(spark, "t")).collect()}

    def test_templates_and_slots(self, spark):
        other = self.item.replace("120", "95").replace("Paris", "London").replace("Alice", "Carol").replace(" 7 ", " 9 ")
        clash = other.replace("7", "9").replace("with Carol", "with Dave")
        mixed = self.item.replace("at 7", "at 8").replace("120", "9").replace("in 2", "in 9").replace("Bob", "Alice")
        docs = [(1, f"{say(30)}. {self.item}. {say(30)}"), (2, f"{say(9)} {other} {say(9)}"), (3, say(200)), (4, clash), (5, self.item.upper()), (6, None), (7, ""), (None, self.item), (8, " ".join(self.item.split()[:12])), (9, mixed)]
        found = self.leaks(spark, docs)
        assert {d for d, _ in found} >= {1, 2, 5} and not {d for d, _ in found} & {3, 6, 7, 8, 9, None}
        assert found[2, 1].n_slots > 0 and found[2, 1].n_consistent == found[2, 1].n_slots

    def test_chance_alignments_do_not_outvote(self, spark):
        item = "What is 12 plus 12 plus 15 plus 15"
        numbers = "the list holds 4 and 4 and 9 and 7 and 4 and 9 in the end"
        others = " ".join(f"What is {i} plus {i + 3} plus {i + 1} plus {i + 9}" for i in range(20, 40))
        docs = [(1, item), (2, f"{others} {item} {others}"), (3, item.replace("12", "31").replace("15", "40")), (4, "What is 1 plus 2 plus 3 plus 4"), (5, others), (6, numbers)]
        found = self.leaks(spark, docs, [(1, item), (2, numbers)])
        assert set(found) == {(1, 1), (2, 1), (3, 1), (6, 2)}

    def test_against_brute_force(self, spark):
        items = [(i, say(rng.randint(3, 25))) for i in range(12)]
        docs = []
        for i in range(60):
            _, t = rng.choice(items)
            w = t.split()
            cut = w[: rng.randint(len(w) // 2, len(w))]
            docs.append((i, f"{say(rng.randint(0, 20))} {' '.join(cut)} {say(rng.randint(0, 20))}"))
        shingles = lambda t: {tuple(w[i : i + 5]) for w in [re.findall("[a-z]+", t)] for i in range(len(w) - 4)}
        expected = {(d, i) for d, t in docs for i, u in items if shingles(u) and len(shingles(t) & shingles(u)) >= 0.8 * len(shingles(u))}
        assert set(self.leaks(spark, docs, items)) == expected and expected

    def test_empty_tables(self, spark):
        empty = spark.createDataFrame([], "doc_id long, text string")
        assert decontaminate.leaks(empty, spark.createDataFrame([], "item_id long, text string"), Store(spark, "t")).count() == 0


class TestToxicity:
    def corpus(self, n=900):
        bad = ["blargh", "snorfle", "grumbits"]
        docs, labels = [], []
        for i in range(n):
            words = say(rng.randint(5, 120)).split()
            toxic = rng.random() < 0.2
            if toxic:
                for _ in range(rng.randint(1, 4)):
                    words.insert(rng.randrange(len(words) + 1), rng.choice(bad) + rng.choice(["", "", "ed", "ing"]))
            docs.append((i, " ".join(words), "en", "s", 0))
            labels.append((i, 1, int(toxic)))
        return docs, labels

    def test_held_out_accuracy(self, spark):
        docs, labels = self.corpus()
        d, lab = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        scored = toxicity.score(d, toxicity.train(d, lab, Store(spark, "t"))).withColumn("held", toxicity.remainder(toxicity.F.col("doc_id")) == 1).collect()
        truth = {i: t for i, _, t in labels}
        held = [r for r in scored if r.held]
        right = sum((r.score >= toxicity.THRESHOLD) == bool(truth[r.doc_id]) for r in held)
        assert right / len(held) > 0.97 and all(0 <= r.score <= 1 for r in scored)

    def test_held_out_labels_are_not_used(self, spark):
        docs, labels = self.corpus(300)
        import zlib

        flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
        d = spark.createDataFrame(docs, DOC)
        models = [toxicity.train(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int"), Store(spark, "t")) for x in (labels, flipped)]
        assert models[0][0] == models[1][0] and models[0][2] == models[1][2]

    def test_edge_cases(self, spark):
        docs, labels = self.corpus(300)
        d = spark.createDataFrame([*docs, (None, None, None, None, None), (5000, "", "en", "s", 0), (5000, "x " * 50_000, "en", "s", 0)], DOC).withColumn("score", toxicity.F.lit("old"))
        lab = spark.createDataFrame([*labels, (None, 1, 1), (7, 1, None), (8, 1, 0)], "doc_id long, quality int, toxic int")
        got = toxicity.score(d, toxicity.train(d, lab, Store(spark, "t"))).collect()
        assert len(got) == 303 and all(0 <= r.score < 0.7 for r in got if r.doc_id in (None, 5000))
        none = toxicity.train(d, lab.where("toxic = 0"), Store(spark, "t"))
        assert none is None and {r.score for r in toxicity.score(d, none).collect()} == {0.0}
        assert toxicity.score(spark.createDataFrame([], DOC), None).count() == 0

    def test_risk_is_non_negative_learning(self):
        import numpy as np

        g = np.random.default_rng(1)
        pos, neg = g.normal(2, 1, (400, 2)), g.normal(-2, 1, (1600, 2))
        w, b = toxicity.nnpu_fit(pos[:200], np.r_[pos[200:], neg], 0.11)
        assert ((pos @ w + b) > 0).mean() > 0.9 and ((neg @ w + b) < 0).mean() > 0.97


class TestMixing:
    def test_counts_follow_the_poisson_distribution(self, spark):
        docs = [(i, "t", "en", "a" if i % 4 else "b", 1) for i in range(8000)]
        got = mixing.mix(spark.createDataFrame(docs, DOC), {"a": 0.5, "b": 0.5}).collect()
        by = Counter(r.source for r in got)
        assert abs(by["a"] - 4000) < 300 and abs(by["b"] - 4000) < 300
        per = Counter(Counter(r.doc_id for r in got if r.source == "b").values())
        for k in range(1, 5):
            expected = 2000 * exp(-2) * 2**k / [1, 1, 2, 6, 24][k]
            assert abs(per[k] - expected) < 5 * expected**0.5 + 5
        again = mixing.mix(spark.createDataFrame(docs, DOC).repartition(3), {"a": 0.5, "b": 0.5}).collect()
        assert sorted(r.shuffle_key for r in again) == sorted(r.shuffle_key for r in got)

    def test_large_rates(self, spark):
        u = [(i + 0.5) / 2000 for i in range(2000)]
        for rate in (599.0, 650.0, 5000.0):
            got = [r.k for r in spark.createDataFrame([(x,) for x in u], "u double").select(mixing.poisson_count(mixing.F.col("u"), rate).alias("k")).collect()]
            mean = sum(got) / len(got)
            assert got == sorted(got) and abs(mean - rate) < 0.02 * rate**0.5 and abs(sum((k - mean) ** 2 for k in got) / len(got) / rate - 1) < 0.02
        docs = [(i, "t", "en", "a" if i else "b", 1) for i in range(3000)]
        got = Counter(r.source for r in mixing.mix(spark.createDataFrame(docs, DOC), {"a": 0.5, "b": 0.5}).collect())
        assert abs(got["a"] - 1500) < 200 and abs(got["b"] - 1500) < 200

    def test_edge_cases(self, spark):
        docs = [(None, None, None, None, None)] * 3 + [(i, "t", "en", "z", 1) for i in range(50)] + [(4, "t", "en", "z", 1)]
        df = spark.createDataFrame(docs, DOC).withColumn("copy", mixing.F.lit("old")).withColumn("__x", mixing.F.lit(1))
        assert mixing.mix(df, {"a": 1.0}).count() == 0
        got = mixing.mix(df, {"a": 1.0}, other=1.0, total=540).collect()
        assert 400 < len(got) < 700 and {r.copy for r in got if r.doc_id == 3} >= {1}
        assert len({r.shuffle_key for r in got if r.doc_id not in (None, 4)}) == sum(r.doc_id not in (None, 4) for r in got)
        assert mixing.mix(spark.createDataFrame([], DOC), {"a": 1.0}).count() == 0


def near_roots(texts):
    """Least key of each group that all pairs of Jaccard 0.8 on five-word shingles make. texts: key -> text."""
    sets, up = {}, {k: k for k in texts}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def copies_of(docs):
    """doc_id -> copies, by going through the Poisson distribution with each document's own number. docs: (doc_id, source) rows."""
    weight = lambda s: mixing.WEIGHTS.get(s, mixing.OTHER)
    group = lambda s: s if s in mixing.WEIGHTS else None
    sizes = Counter(group(s) for _, s in docs)
    whole, out = sum(weight(g) for g in sizes), Counter()
    for d, s in docs:
        rate = weight(s) / whole * len(docs) / sizes[group(s)]
        u = int(hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest()[:13], 16) / (1 << 52)
        k, p = 0, exp(-rate)
        below = p
        while u >= below:
            k += 1
            p = p * rate / k
            below += p
        out[d] += k
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage against plain Python on its own input; what the classifier keeps is taken as it is."""
    docs, labels = TestToxicity().corpus(260)
    lines = [f"line {i} of forty or more characters stands in several of the documents" for i in range(4)]
    items = [say(25) for _ in range(5)]
    rows = [(i, "\n".join([*rng.sample(lines, rng.randint(0, 2)), t])) for i, t, *_ in docs]
    base = [say(120).split() for _ in range(12)]
    for i in range(300, 400):  # copies with up to eight words changed
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((i, " ".join(w)))
    for i in range(400, 430):  # passages of an item, from half of it to all
        w = rng.choice(items).split()
        rows.append((i, f"{say(rng.randint(0, 30))} {' '.join(w[: rng.randint(len(w) // 2, len(w))])} {say(rng.randint(0, 30))}"))
    rows += [(430, None), (431, ""), (432, say(3)), (433, say(40_000)), (300, rows[280][1])]
    rng.shuffle(rows)
    d = str(tmp_path)
    docs = [(i, t, "en", rng.choice(["src0", "src0", "src3", "elsewhere", None]), len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, DOC).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    df, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, d).write.parquet(f"{d}/{name}")
        df = spark.read.parquet(f"{d}/{name}")
        seen[name] = df.collect()
    pairs = lambda name: sorted((r.doc_id, r.text or "") for r in seen[name])

    held = {}
    for i, t in pairs("toxicity"):
        for x in set(t.split("\n")):
            if len(x.strip(" \t\n\x0b\x0c\r")) >= 40:
                held.setdefault(x.strip(" \t\n\x0b\x0c\r").lower(), set()).add(i)
    owner = {k: max(v) for k, v in held.items() if len(v) >= 5}
    kept = [(i, "\n".join(x for x in t.split("\n") if i >= owner.get(x.strip(" \t\n\x0b\x0c\r").lower(), i))) for i, t in pairs("toxicity")]
    assert pairs("line_dedup") == sorted(kept) and sum(len(a[1]) for a in pairs("toxicity")) > sum(len(a[1]) for a in kept)

    texts = {(i, n): t for n, (i, t) in enumerate(pairs("line_dedup"))}
    gone = {k[0] for k, r in near_roots(texts).items() if r[0] != k[0]}
    assert pairs("simhash_near_dedup") == sorted((i, t) for (i, _), t in texts.items() if i not in gone) and len(gone) > 20

    shingles = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[a-z]+", t)] for i in range(len(w) - 4)}
    leaks = {i for i, t in pairs("simhash_near_dedup") for u in items if len(shingles(t) & shingles(u)) >= 0.8 * len(shingles(u))}
    assert pairs("decontamination") == [(i, t) for i, t in pairs("simhash_near_dedup") if i not in leaks] and leaks

    assert Counter(r.doc_id for r in seen["source_mixing"]) == copies_of([(r.doc_id, r.source) for r in seen["decontamination"]])
    again = corpus_pipeline.run(spark, d).collect()
    assert Counter((r.doc_id, r.copy, r.text) for r in again) == Counter((r.doc_id, r.copy, r.text) for r in seen["source_mixing"])


def test_pipeline_of_empty_tables_and_nulls(spark, tmp_path):
    for k, docs in enumerate(([], [(None, None, None, None, None)] * 2 + [(1, "a b c d e f", "en", "src1", 11)] * 2)):
        d = f"{tmp_path}/{k}"
        spark.createDataFrame(docs, DOC).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        got = corpus_pipeline.run(spark, d).collect()
        assert (not got) if not docs else {r.doc_id for r in got} <= {None, 1}


def test_pipeline_stages(spark, tmp_path):
    docs, labels = TestToxicity().corpus(400)
    line = "this line of forty or more characters stands in many of the documents"
    item = say(30)
    docs = [(i, (line + "\n" if i % 3 == 0 else "") + t, lang, f"src{i % 3}", len(t)) for i, t, lang, _, _ in docs]
    long = say(150)
    docs += [(900, long, "en", "src1", len(long)), (901, long, "en", "src1", len(long)), (902, say(20) + " " + item + " " + say(20), "en", "src1", 0)]
    d = str(tmp_path)
    spark.createDataFrame(docs, DOC).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    seen, df = {}, spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, d).write.parquet(f"{d}/{name}")
        df = spark.read.parquet(f"{d}/{name}")
        seen[name] = df.collect()
        if name != "source_mixing":
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: {r.doc_id for r in seen[name]}
    toxic = {i for i, _, t in labels if t}
    assert len(toxic - ids("toxicity")) > 0.9 * len(toxic) and {i for i, _, t in labels if not t} <= ids("toxicity")
    assert ids("line_dedup") == ids("toxicity") and sum(line in r.text for r in seen["line_dedup"]) == 1
    assert 900 in ids("simhash_near_dedup") and 901 not in ids("simhash_near_dedup")
    assert ids("simhash_near_dedup") - ids("decontamination") == {902}
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).collect()} == ids("source_mixing") <= ids("decontamination")
