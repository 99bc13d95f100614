"""A memo of scored pairs that lasts between runs: a table in buckets by the pair's hash.

A run asks the memo for its pairs by a join on the bucket column, so that only the run's own pairs are shuffled, to the
memo's buckets; what the memo holds is read where it lies. Only pairs that it doesn't hold reach the scorer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
Scorer = Callable[[DataFrame], DataFrame]


def pair_key(a: Column, b: Column) -> Column:
    """SHA-256 of both texts; the first one's length keeps ("ab", "c") and ("a", "bc") apart. Null where either is."""
    return F.sha2(F.concat(F.length(a).cast("string"), F.lit(":"), a, b), 256)


def create(spark: SparkSession, table: str, path: str, buckets: int = BUCKETS) -> None:
    """An empty memo in a folder that all executors share."""
    empty = spark.createDataFrame([], "pair string, score double")
    empty.write.bucketBy(buckets, "pair").sortBy("pair").option("path", path).saveAsTable(table)


def _buckets(spark: SparkSession, table: str) -> int:
    rows = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").select("data_type").collect()
    return int(rows[0][0])


def _asked(pairs: DataFrame, a: str, b: str, table: str) -> DataFrame:
    """Each pair once, dealt out to the memo's buckets. Repeats are dropped before and after the shuffle, so one pair in a third of
    all rows is one row a task."""
    one = pairs.select(pair_key(F.col(a), F.col(b)).alias("pair"), F.col(a).alias("a"), F.col(b).alias("b")).where("pair IS NOT NULL")
    return one.groupBy("pair").agg(F.any_value(F.struct("a", "b")).alias("t")).select("pair", "t.*").repartition(_buckets(pairs.sparkSession, table), "pair")


def unseen(pairs: DataFrame, a: str, b: str, table: str) -> DataFrame:
    """(pair, a, b) of the pairs that the memo doesn't hold, each once; a pair with a null is none."""
    return _asked(pairs, a, b, table).join(pairs.sparkSession.table(table).select("pair").hint("merge"), "pair", "left_anti")


def extend(pairs: DataFrame, a: str, b: str, table: str, scorer: Scorer) -> None:
    """Score what the memo doesn't hold and add it. `scorer` takes (pair, a, b) and returns these rows with a score. A run that is
    lost before its rows are committed adds none and is repeated; runs that add to one memo go one after another."""
    new = scorer(unseen(pairs, a, b, table)).select("pair", F.col("score").cast("double").alias("score"))
    new.write.mode("append").bucketBy(_buckets(pairs.sparkSession, table), "pair").sortBy("pair").saveAsTable(table)
    pairs.sparkSession.catalog.refreshTable(table)


def looked_up(pairs: DataFrame, a: str, b: str, table: str) -> DataFrame:
    """pairs with score; null where the memo doesn't hold the pair. Pairs are looked up once each and joined back by the pair."""
    held = _asked(pairs, a, b, table).join(pairs.sparkSession.table(table).hint("merge"), "pair").select("pair", "score")
    keyed = pairs.withColumn("_pair", pair_key(F.col(a), F.col(b)))
    return keyed.join(held.withColumnRenamed("pair", "_pair"), "_pair", "left").drop("_pair")


def disagreements(pairs: DataFrame, a: str, b: str, table: str, scorer: Scorer, share: float = 0.01, within: float = 0.0) -> DataFrame:
    """(checked, differing): the gate on the memo. The pairs of least hash, a `share` of all, are scored again and compared; a null
    score differs from a number."""
    least = F.conv(F.substring("pair", 1, 13), 16, 10).cast("double") < share * float(1 << 52)
    again = scorer(_asked(pairs, a, b, table).where(least)).select("pair", F.col("score").cast("double").alias("_again"))
    both = again.join(pairs.sparkSession.table(table).hint("merge"), "pair")
    same = F.coalesce(F.abs(F.col("score") - F.col("_again")) <= within, F.col("score").isNull() & F.col("_again").isNull())
    return both.agg(F.count("*").alias("checked"), F.count_if(~same).alias("differing"))
