"""Logs by the place of their lines, side-car archives, folding and spellings."""

import numpy as np
from pyspark.sql import functions as F

from lakequill.functions import echo, scorer, text
from lakequill.sources import readers, side_cars


class TestPlaces:
    def test_stops_at_the_first_broken_line(self, spark, tmp_path):
        for name, third in enumerate(('{"us', '{"n": 3} x', '{"n": 3}{"n": 4}', '{"n": 3},{"n": 4}', '{"n": 3, "n": 4}', "17", "[]", "null")):
            (tmp_path / f"{name}.jsonl").write_text(f'{{"n": 1}}\n\n{{"n": 2, "s": "x"}}\n{third}\n{{"n": 5}}\n')
        (tmp_path / "whole.jsonl").write_text('{"n": 1}\n{"n": "not a number"}\n{"s": "y"}')
        rows = readers.read_log_until_torn(spark, str(tmp_path), "n long, s string").collect()
        by_file = {}
        for r in sorted(rows, key=lambda r: (r["_file"], r["_at"])):
            by_file.setdefault(r["_file"].rpartition("/")[2], []).append((r.n, r.s))
        assert by_file.pop("whole.jsonl") == [(1, None), (None, None), (None, "y")]
        assert len(by_file) == 8 and set(map(tuple, by_file.values())) == {((1, None), (2, "x"))}

    def test_numbers_over_many_splits(self, spark, tmp_path):
        for f, n in (("a", 5000), ("b", 1), ("c", 700)):
            (tmp_path / f).write_text("".join(f"{f} {i}\n" for i in range(n)))
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        try:
            rows = readers.number_lines(readers.read_positions(spark, str(tmp_path))).select("value", "_file", "_line").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert len(rows) == 5701 and all(r.value == f"{r['_file'][-1]} {r['_line']}" for r in rows)

    def test_empty_log(self, spark, tmp_path):
        (tmp_path / "x").write_text("\n \n")
        assert readers.read_log_until_torn(spark, str(tmp_path), "n long").count() == 0


class TestSideCars:
    def test_round_trip_and_damage(self, spark, tmp_path):
        rows = [(i, [float(i), 0.5, -1.0]) for i in range(10)]
        folder = "file://" + str(tmp_path)
        written = side_cars.write_side_cars(spark.createDataFrame(rows, "id long, v array<double>"), folder, "id", ["v"], rows=4).collect()
        assert sorted((r.file, r.n) for r in written) == [("000000000000.npz", 4), ("000000000001.npz", 4), ("000000000002.npz", 2)]
        np.savez(tmp_path / "narrow.npz", id=np.arange(2), v=np.zeros((2, 2)))
        np.savez(tmp_path / "short.npz", id=np.arange(3), v=np.zeros((2, 3)))
        np.savez(tmp_path / "none.npz", id=np.arange(3))
        np.savez(tmp_path / "nan.npz", id=np.arange(1), v=np.full((1, 3), np.nan))
        (tmp_path / "text.npz").write_bytes(b"no archive, but as long as one may be " * 20)
        (tmp_path / "notes.txt").write_text("not one of them")
        got = side_cars.read_side_cars(spark, folder, v=(3,)).collect()
        assert sorted((r.id, list(r.v)) for r in got if r.reason is None) == rows
        assert {r.file: r.reason.partition(":")[0] for r in got if r.reason} == {"narrow.npz": "ValueError", "short.npz": "ValueError", "none.npz": "ValueError", "nan.npz": "ValueError", "text.npz": "BadZipFile"}

    def test_members_that_are_not_asked_for(self, spark, tmp_path):
        np.savez(tmp_path / "a.npz", id=np.arange(2), v=np.ones((2, 2, 2)), w=np.array(["not", "numbers"]))
        got = side_cars.read_side_cars(spark, "file://" + str(tmp_path), v=(2, 2)).collect()
        assert [r.v for r in got] == [[[1.0, 1.0], [1.0, 1.0]]] * 2

    def test_empty_folder(self, spark, tmp_path):
        assert side_cars.read_side_cars(spark, "file://" + str(tmp_path), v=(3,)).count() == 0


def test_fold(spark):
    cases = {"đồng": "dong", "Łódź": "lodz", "Dvořák": "dvorak", "ĐỒNG": "dong", "Złoty": "zloty", "İzmir ılık": "izmir ilik", "ﬁn ½ ㎏ Ⅷ": "fin 1⁄2 kg viii", "𝐀𝐛": "ab", "éä": "ea", "Straße": "strasse", "plain": "plain", "": "", "한국 中文": "한국 中文", None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.fold(F.col("t")).alias("f")).collect()
    assert {r.t: r.f for r in rows} == cases


def test_marked_names_are_scored_right(spark):
    rows = [("dong", "Vietnamese đồng"), ("Lodz", "It is Łódź."), ("Dvorak", "Antonín Dvořák wrote it")]
    df = spark.createDataFrame([("factual", g, a, [], 0.0, True) for g, a in rows], "f string, g string, a string, x array<string>, t double, d boolean")
    assert all(r.r.correct for r in df.select(scorer.scored(*(F.col(c) for c in "fgaxtd")).alias("r")).collect())


def test_spellings_and_keys(spark):
    one = lambda c: spark.range(1).select(c.alias("r")).first().r
    assert one(text.number_forms(F.lit(12.5))) == ["12.5", "12.50"] and one(text.number_forms(F.lit(1234.25))) == ["1234.25", "1,234.25"]
    assert one(text.number_forms(F.lit(1200))) == ["1200", "1,200", "1,200.00", "1200.0"]
    assert set(one(text.spellings(F.lit(1200)))) == {"1200", "1,200", "$1200", "$1,200"} and set(one(text.spellings(F.lit(4.5)))) == {"4.5", "4.50", "$4.5", "$4.50"}
    assert one(text.gold_key(F.lit("St. John's, 3rd"))) == "stjohns3rd" and one(text.gold_key(F.lit(None).cast("string"))) is None
    stale = lambda *p: one(text.stale_only_in_retraction(F.array(*map(F.lit, p)), F.lit(8000.0), echo.SUPERSESSION))
    assert stale("It was $8,000.", "Nothing") and not stale("It was $8,000.", "Pay 8000 now") and not stale("Nothing was") and stale("Corrected from 8000")
    assert one(text.declines(F.lit("Please PROVIDE the meter"), True)) and not one(text.declines(F.lit("Please provide the meter"))) and not one(text.declines(F.lit(None).cast("string"), True))


def test_leave_set_out(spark):
    import pytest

    from lakequill.functions import records

    one = lambda *dropped: spark.range(1).select(records.leave_set_out(F.array(F.lit(0.9), F.lit(0.5), F.lit(0.7)), F.array(*map(F.lit, dropped)).cast("array<int>")).alias("r")).first().r
    assert [round(one(*x), 6) for x in ((), (0,), (0, 2), (0, 0), (1, 2), (0, 1, 2))] == [0.0, 0.2, 0.4, 0.2, 0.0, 0.9]
    for bad in ((3,), (0, -1)):
        with pytest.raises(Exception, match="no such source"):
            one(*bad)
