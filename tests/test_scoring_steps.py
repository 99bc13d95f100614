"""Scoring by projections: the same results as in one expression, little interpreted, and rows of one row group on many cores."""

import pytest
from pyspark.sql import functions as F

from lakequill.functions import scorer, text
from lakequill.plans import records  # noqa: F401  (registers the query)
from lakequill.plans.catalog import QUERIES, spread

CASES = [
    # family, gold, answer, accept, tolerance, finished; correct, extracted, note, truncated
    (("deduction", "B", "The answer is A: B", [], 0.0, True), (True, "B", "conclusion-letter-match", False)),  # A stands before the last marker
    (("deduction", "C", "Say C=", [], 0.0, True), (True, "C", "conclusion-letter-match", False)),  # none after it: the last of all
    (("deduction", "C", "thenC=", [], 0.0, True), (False, "thenC=", "conclusion-letter-mismatch", False)),  # C does not stand alone
    (("deduction", "A", "so B", [" B ", None], 0.0, True), (True, "B", "conclusion-letter-match", False)),
    (("arithmetic", "50", "İİ is 50 =", [], 0.0, True), (True, "50.0", "numeric[last-number-fallback]tol=0.0", False)),
    (("arithmetic", "5", "İİİ = 5-3", [], 0.0, True), (True, "5.0", "numeric[after-marker]tol=0.0", False)),  # a letter that lower case lengthens
    (("arithmetic", "1,234.5", "total $1,234.50 or 7", [], None, True), (True, "1234.5", "numeric[after-marker]tol=0.0", False)),
    (("factual", "7", "Seven, so 8", ["x"], 0.0, True), (False, "8.0", "numeric[first-after-marker]tol=0.0", False)),
    (("factual", "one two", "a one the two", [], 0.0, True), (True, "one two", "token-run-match", False)),
    (("factual", "one one", "the one", ["A One"], 0.0, False), (True, "A One", "token-run-match", False)),
    (("factual", "the", "and", [], 0.0, True), (False, "", "empty-gold", False)),
    (("factual", "and", "an", [], 0.0, False), (False, "", "empty-answer", True)),
    (("factual", "Rome", "a b c d e f g h i j", None, 0.0, True), (False, "c d e f g h i j", "no-token-match", False)),
    (("factual", "Rome", None, None, 0.0, True), (False, "", "no-token-match", False)),
    (("poem", "Rome", "Rome", [], 0.0, True), None),
]


@pytest.mark.parametrize("bound_by", ["columns", "lambdas"])
def test_odd_answers(spark, bound_by):
    df = spark.createDataFrame([(k, *row) for k, (row, _) in enumerate(CASES)], "k int, f string, g string, a string, x array<string>, t double, d boolean")
    row = [F.col(c) for c in "fgaxtd"]
    got = scorer.score(df, "r", *row) if bound_by == "columns" else df.withColumn("r", scorer.scored(*row))
    assert got.columns == [*df.columns, "r"]
    assert [r.r and tuple(r.r) for r in got.orderBy("k").collect()] == [expected for _, expected in CASES]


def test_nothing_but_other_spellings_is_interpreted(spark, tmp_path):
    spark.createDataFrame([(1, 2, 3, 4, 5.0, "N")], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    plan = QUERIES["scored_answers"](spark, str(tmp_path))._jdf.queryExecution().analyzed().toString()
    # of folded rare characters and number words, in gold and answer each, and of the spellings accepted beside the gold
    assert plan.count("lambdafunction(") <= 10


def test_long_lines_of_articles(spark):
    long = "a the an " * 50_000
    got = spark.createDataFrame([(long,), (long + "cat",), ("and then a.the,one",), ("",)], "t string").select(text.word_line(F.col("t")))
    assert [r[0] for r in got.collect()] == [" ", " cat ", " and then 1 ", " "]


def test_rows_of_one_row_group_are_spread(spark, tmp_path):
    spark.range(0, 10_000, 1, 1).write.parquet(str(tmp_path / "one"))
    few = spread(spark.read.parquet(str(tmp_path / "one")), "id")
    assert few.select(F.spark_partition_id()).distinct().count() > spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 10 * spark.sparkContext.defaultParallelism)
    assert spread(many, "id") is many
