"""Sources, functions, votes, sampling, streaming and guards on small fixtures."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lakequill.functions import records, text
from lakequill.operators import aggregates, decisions, latest, quality, sampling, similarity, votes
from lakequill.sources import readers, writers
from lakequill.streaming import ingest


def one(spark, c, **columns):
    df = spark.createDataFrame([tuple(columns.values())], list(columns)) if columns else spark.range(1)
    return df.select(c.alias("x")).first().x


class TestSources:
    def test_jsonl_and_missing_log(self, spark, tmp_path):
        p = tmp_path / "a.jsonl"
        p.write_text('{"k": 1}\n\n{"k": 2}\n')
        assert sorted(r.k for r in readers.read_jsonl(spark, str(p), "k int").collect()) == [1, 2]
        assert readers.read_jsonl(spark, str(p), "k int", limit=1, order="k").first().k == 1
        assert readers.read_log(spark, str(tmp_path / "none"), "k int").count() == 0
        assert readers.read_register(spark, str(tmp_path / "none")).count() == 0
        p.write_text('{"k": 1}\n{"k": ')
        with pytest.raises((PySparkException, Py4JError)):
            readers.read_log(spark, str(p), "k int").collect()

    def test_torn_log_stops_at_first_bad_line(self, spark, tmp_path):
        p = tmp_path / "log.jsonl"
        p.write_text('{"_seq": 0, "v": 1}\n{"_seq": 1, "v": 2}\n{"_seq": 2, "v": \n{"_seq": 3, "v": 4}\n')
        assert sorted(r.v for r in readers.read_torn_log(spark, str(p), "_seq long, v int", "_seq").collect()) == [1, 2]
        p.write_text('{"_seq": 0, "v": 1}\n{"_s')
        assert [r.v for r in readers.read_torn_log(spark, str(p), "_seq long, v int", "_seq").collect()] == [1]

    def test_result_folder(self, spark, tmp_path):
        for name in ("t1", "t2", "_oracle"):
            (tmp_path / f"{name}.json").write_text(json.dumps({"v": 1}, indent=1))
        assert sorted(r.task_id for r in readers.read_result_dir(spark, str(tmp_path), "v int").collect()) == ["t1", "t2"]

    def test_labels(self, spark):
        df = spark.createDataFrame([("a", "human", {"i": " yes ", "j": "maybe"})], "annotator_id string, annotator_kind string, labels map<string,string>")
        assert sorted((r.item, r.label) for r in readers.read_labels(df).collect()) == [("i", "YES"), ("j", None)]
        with pytest.raises(PySparkException):
            readers.read_labels(df.withColumn("annotator_kind", F.lit("model"))).collect()

    def test_composite_keys(self, spark):
        df = spark.createDataFrame([("f||2||x",)], "key string")
        r = readers.split_composite(df, "key", ["a", "b", "c"], {"b": "int"}).first()
        assert (r.a, r.b, r.c) == ("f", 2, "x")
        with pytest.raises(PySparkException):
            readers.split_composite(df, "key", ["a", "b"]).collect()

    def test_quarantine(self, spark):
        good, bad = readers.quarantine(spark.createDataFrame([(1,), (-1,), (None,)], "x int"), {"positive": F.col("x") > 0})
        assert good.count() == 1 and sorted(r.reasons[0] for r in bad.collect()) == ["positive"] * 2

    def test_sinks(self, spark, tmp_path):
        df = spark.createDataFrame([(1, "a")], "k int, v string")
        for _ in range(2):
            writers.write_json(df, str(tmp_path / "o"))
        writers.append_jsonl(df, str(tmp_path / "o"))
        assert spark.read.json(str(tmp_path / "o")).count() == 2
        assert writers.markdown_table(df) == "| k | v |\n|---|---|\n| 1 | a |"
        assert writers.fill_template("{{a}} {{b}}", {"a": "1"}) == ("1 {{b}}", ["b"])
        assert writers.canonical_hash({"b": 1, "a": 2}) == writers.canonical_hash({"a": 2, "b": 1})


class TestText:
    def test_numbers(self, spark):
        c = F.col("t")
        get = lambda f, t: one(spark, f, t=t)
        assert get(text.numbers(c), "a 1,200.50 b -3") == [1200.5, -3.0]
        assert get(text.number_after_marker(c, "answer:"), "12 Answer: 7 then 9") == 7.0
        assert get(text.number_after_marker(c, "answer:"), "12 then 9") == 9.0
        assert get(text.bounded_int(c), "150 then 88 of 100x 300") == 100
        assert get(text.canonical_decimal(c), "costs 12,000.00") == 12000 and get(text.canonical_decimal(c), "1 or 2") is None
        assert get(text.worksheet(c), "a: 1\nb = 2.5\na: 3") == {"a": 3.0, "b": 2.5}
        assert get(text.conclusion_letter(c), "A or B? It's B. Cat") == "B"
        assert get(text.unit_after(c, F.lit("120")), "it is 120 km away") == "km"
        assert get(text.fold(c), "Élève Straße") == "eleve strasse"
        assert get(text.digitize(c), "The twelve apples") == ["12", "apples"]

    def test_empty_premises_are_not_superseded(self, spark):
        assert not one(spark, text.only_superseded(F.array().cast("array<string>"), "x", "no longer"))
        assert one(spark, text.only_superseded(F.array(F.lit("x no longer holds"), F.lit("other")), "x", "no longer"))

    @settings(max_examples=20, deadline=None)
    @given(st.text(alphabet="aB9 .,-é", max_size=30))
    def test_norm_exact(self, spark, s):
        import re

        assert one(spark, text.norm_exact(F.lit(s))) == re.sub("[^a-z0-9]+", " ", s.lower()).strip()


class TestRecords:
    def test_prompts(self, spark):
        src = F.array(F.struct(F.lit(1).alias("id"), F.lit("b").alias("text")), F.struct(F.lit(0).alias("id"), F.lit("a").alias("text")))
        assert one(spark, records.numbered(records.ordered_texts(src))) == "[0] a\n[1] b"
        assert one(spark, records.axis_documents(F.lit("A2"), src, F.array(F.lit(0)), F.array(F.lit("c")))) == ["b"]
        assert one(spark, records.axis_documents(F.lit("A1"), src, F.array(F.lit(0)), F.array(F.lit("c")))) == ["a", "b", "c"]
        assert one(spark, F.size(records.turns(F.array(F.lit("s")), F.array().cast("array<string>")))) == 1

    def test_threshold_is_quantised(self, spark):
        assert one(spark, records.contaminated(F.lit(0.7 - 1e-12), F.lit(0.9)))
        assert not one(spark, records.contaminated(F.lit(0.7), F.lit(1.0 - 1e-12)))

    def test_guards(self, spark):
        assert one(spark, records.dose(F.lit("D3"))) == 3
        for bad in (records.dose(F.lit("none")), records.leave_one_out(F.array(F.lit(0.5)), F.lit(1))):
            with pytest.raises(PySparkException):
                one(spark, bad)
        assert one(spark, records.leave_one_out(F.array(F.lit(0.5)), F.lit(0))) == 0.5
        assert one(spark, records.in_band(F.lit(5), F.lit(0), 0.0, 1.0)) is False
        assert one(spark, records.entropy(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0)))) == pytest.approx(0.693147, abs=1e-6)


class TestOperators:
    def test_latest_and_todo(self, spark):
        log = spark.createDataFrame([("t", "A", 1, "x"), ("t", "A", 2, None), ("u", "B", 1, "y")], "task string, arm string, seq int, v string")
        assert {(r.task, r.v) for r in latest.last_wins(log, ["task", "arm"], "seq").collect()} == {("t", None), ("u", "y")}
        assert {(r.task, r.arm) for r in latest.todo(log, ["A", "B"], log, "task").collect()} == {("t", "B"), ("u", "A")}
        tops = spark.createDataFrame([("f", 3, 2, "b"), ("f", 3, 1, "a"), ("f", 1, 0, "c")], "fam string, dose int, seq int, v string")
        assert latest.top_level(tops, "fam", "dose", "seq").first().v == "a"

    def test_votes(self, spark):
        df = spark.createDataFrame([("a", "YES"), ("a", "NO"), ("b", "YES"), ("b", "YES"), ("c", "YES")], "k string, label string")
        assert {r.k: r.label for r in votes.consensus(df, "k", "label").collect()} == {"a": None, "b": "YES", "c": None}
        same = spark.createDataFrame([("y", "y")] * 3, "a string, b string")
        assert votes.kappa(same, [], "a", "b").first().kappa == 1.0

    def test_direction_missing_raises(self, spark):
        df = spark.createDataFrame([("i", "s", 0, 0.5)], "i string, s string, d int, x double")
        with pytest.raises(PySparkException):
            aggregates.bidirectional(df, "i", "s", "d", "x").collect()

    def test_sampling(self, spark):
        df = spark.range(100).withColumn("g", F.when(F.col("id") < 7, "a").otherwise("b"))
        assert sampling.proportional(df, "g", "id", 1, 10).count() == 10
        assert {r.g: r["count"] for r in sampling.stratified(df, "g", "id", 1, 0.1, 3).groupBy("g").count().collect()} == {"a": 3, "b": 9}
        assert [r.id for r in sampling.even_stride(df.where("g = 'b'"), ["g"], "id", 4).orderBy("id").collect()] == [7, 30, 53, 76]

    def test_similarity(self, spark):
        import random

        rng = random.Random(0)
        words = [f"w{i}" for i in range(30)]
        rows = [(i, " ".join(rng.sample(words, rng.randint(0, 8)))) for i in range(60)]
        df = spark.createDataFrame(rows, "id long, text string").select("id", text.tokens(F.col("text")).alias("tokens"))
        got = {(r.a, r.b) for r in similarity.jaccard_pairs(df.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b"), "a", "b", 0.5).collect()}
        sets = {i: set(t.split()) for i, t in rows}
        assert got == {(i, j) for i in sets for j in sets if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])}

    def test_diff_and_verdicts(self, spark):
        a, b = spark.createDataFrame([(1, 0.2), (2, 0.5), (3, None)], "k int, v double"), spark.createDataFrame([(1, 0.9), (2, 0.5), (4, 1.0)], "k int, v double")
        assert {r.k: r.status for r in quality.compare(a, b, ["k"], "v", 0.7).collect()} == {1: "flip", 2: "equal", 3: "only_left", 4: "only_right"}
        v = decisions.verdict([("a", F.lit(None).cast("boolean")), ("b", F.lit(True))], "c")
        assert one(spark, v) == "b"


def test_stream_ingest_resumes(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = "task string, seq long, config_hash string, error string, v int"

    def put(name, rows):
        (tmp_path / "src").mkdir(exist_ok=True)
        (tmp_path / "src" / name).write_text("".join(json.dumps(r) + "\n" for r in rows))

    row = lambda t, s, v, h="h", e=None: {"task": t, "seq": s, "config_hash": h, "error": e, "v": v}
    put("a.json", [row("t", 1, 1), row("t", 2, 2), row("u", 3, 9, e="boom"), row("w", 4, 9, h="old")])
    ingest.ingest(ingest.read_log_stream(spark, src, schema), out, ck, ["task"], "seq", "h").awaitTermination()
    put("b.json", [row("t", 5, 7), row("u", 6, 3)])
    ingest.ingest(ingest.read_log_stream(spark, src, schema), out, ck, ["task"], "seq", "h").awaitTermination()
    assert {r.task: r.v for r in spark.read.parquet(out).collect()} == {"t": 2, "u": 3}


def test_means_in_any_order(spark):
    from lakequill.operators import quality

    # 0.1 ten times is 0.9999999999999999 as a running sum; the others are out of a decimal's reach
    rows = [("a", 0.1)] * 10 + [("b", 0.1)] * 3 + [("c", 1e300), ("c", 1e300), ("d", float("nan")), ("e", None)]
    got = dict(spark.createDataFrame(rows, "k string, x double").groupBy("k").agg(quality.exact_mean(F.col("x"))).collect())
    assert got["a"] == got["b"] == 0.1 and got["c"] == 1e300 and got["d"] != got["d"] and got["e"] is None
