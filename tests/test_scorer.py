"""Scoring by family, and reading of statements, on hand-made answers."""

import pytest
from pyspark.sql import functions as F

from lakequill.functions import echo, scorer


@pytest.mark.parametrize(
    ("family", "gold", "answer", "accept", "tol", "done", "expected"),
    [
        ("arithmetic", "42", "6 times 7 is 42", [], 0.0, True, (True, "42.0", "numeric[after-marker]tol=0.0", False)),
        ("arithmetic", "3", "It appears three times", [], 0.0, True, (True, "3.0", "numeric[last-number-fallback]tol=0.0", False)),
        ("arithmetic", "3.14", "so about 3.1", [], 0.05, True, (True, "3.1", "numeric[after-marker]tol=0.05", False)),
        ("arithmetic", "42", "first 40 and", [], 0.0, False, (False, "40.0", "truncated-excluded", True)),
        ("arithmetic", "42", "no idea", [], 0.0, True, (False, "", "no-number-parsed", False)),
        ("factual", "100", "The number is 100, found in 1952", [], 0.0, True, (True, "100.0", "numeric[first-after-marker]tol=0.0", False)),
        ("deduction", "20", "1952 people, therefore 20", [], 0.0, True, (True, "20.0", "numeric[after-marker]tol=0.0", False)),
        ("deduction", "B", "A or B? The answer: B", [], 0.0, True, (True, "B", "conclusion-letter-match", False)),
        ("deduction", "A", "A was first. Therefore B", ["C"], 0.0, True, (False, "B", "conclusion-letter-mismatch", False)),
        ("factual", "dong", "The Vietnamese Dong", [], 0.0, True, (True, "dong", "token-run-match", False)),
        ("factual", "Vatican City", "the Vatican", ["Vatican"], 0.0, True, (True, "Vatican", "token-run-match", False)),
        ("factual", "Rome", "It may be", [], 0.0, False, (False, "it may be", "truncated-excluded", True)),
        ("factual", "Rome", "It is Paris", [], 0.0, True, (False, "it is paris", "no-token-match", False)),
        ("poem", "Rome", "Rome", [], 0.0, True, None),
    ],
)
def test_scores(spark, family, gold, answer, accept, tol, done, expected):
    df = spark.createDataFrame([(family, gold, answer, accept, tol, done)], "f string, g string, a string, x array<string>, t double, d boolean")
    got = df.select(scorer.scored(*(F.col(c) for c in "fgaxtd")).alias("r")).first().r
    assert (got and tuple(got)) == expected


@pytest.mark.parametrize(
    ("statement", "value", "threshold"),
    [
        ("The load is 120, below 150.", 120.0, 150.0),
        ("Cabin 7's load is $1,800 of 2,000.", 1800.0, 2000.0),
        ("The delivery exceeds Silo 4's capacity.", None, None),
        ("It holds 12.5 tonnes", 12.5, None),
        ("The road has 3 lanes", None, None),
    ],
)
def test_stale_values(spark, statement, value, threshold):
    got = spark.range(1).select(echo.stale_value(F.lit(statement)).alias("r")).first().r
    assert tuple(got) == (value, threshold)


def test_verdicts_and_topics(spark):
    df = spark.createDataFrame([("The combined load of the ferry is 120 tonnes, below 150.", ["The ferry carries 120 tonnes and exceeds its limit."], "90"), ("The load is 120 tonnes.", ["It rained 120 tonnes."], "90")], "s string, p array<string>, c string")
    got = df.select(echo.topic(F.col("s")).alias("t"), echo.verdict_echo(F.col("s"), F.col("p"), F.col("c")).alias("v"), echo.classified(F.col("s"), F.col("p"), F.col("c")).alias("k")).collect()
    assert [tuple(r) for r in got] == [(["load", "ferry"], True, "REAL"), (["load"], False, "REAL")]
