"""A text is read once a row: an expression that lambdas or branches name several times must not stand in the plan several times."""

import pytest
from pyspark.sql import functions as F

from lakequill.functions import echo, scorer


@pytest.fixture
def plan(spark):
    def shown(c):
        before = spark.conf.get("spark.sql.debug.maxToStringFields")
        spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
        try:
            return spark.createDataFrame([("x", ["x"], [1])], "t string, ts array<string>, ids array<bigint>").select(c.alias("c"))._jdf.queryExecution().analyzed().toString()
        finally:
            spark.conf.set("spark.sql.debug.maxToStringFields", before)

    return shown


def test_number_words_are_spelt_out_once(plan):
    assert plan(scorer.final_number(F.col("t"))).count("\\bseven\\b") == 1
    assert plan(scorer.scored(F.lit("arithmetic"), F.lit("1"), F.col("t"), F.col("ts"), F.lit(0.0), F.lit(True))).count("\\bseven\\b") <= 4  # one a branch


def test_texts_without_number_words(spark):
    rows = spark.createDataFrame([("It is Seven",), ("the seventh: 8",), ("ONE and twenty-two",), ("",)], "t string").select(scorer.spelt_out(F.col("t")))
    assert [r[0] for r in rows.collect()] == ["It is  7 ", "the seventh: 8", " 1  and  20 -two".replace("20 -two", "20 - 2 "), ""]


def test_stale_value_reads_the_statement_once(plan):
    assert plan(echo.stale_value(F.col("t"))).count("regexp_extract_all") == 1


def test_classes_read_each_text_once(plan):
    # statement, premises and the right state; the texts of the premises were read anew for each number and each reason
    assert plan(echo.classified(F.col("t"), F.col("ts"), F.col("t"))).count("regexp_extract_all") == 3


def test_acknowledged_reads_both_sides_once(plan):
    assert plan(echo.acknowledged(F.col("ts"), F.col("ids"), F.col("ids"), F.col("ts"))).count("regexp_extract_all") == 2


def test_money_reads_its_text_once(plan):
    assert plan(echo.money(F.col("t"))).count("regexp_extract_all") == 1
