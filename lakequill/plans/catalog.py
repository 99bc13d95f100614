"""Where queries register themselves, with their SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.sources.readers import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of a folder by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def scratch(self, name: str) -> str:
        """A new path below spark.checkpoint.dir, which all executors share; in local mode a temporary folder will do."""
        base = self.spark.conf.get("spark.checkpoint.dir", None) or self.spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not base:
            if not self.spark.sparkContext.master.startswith("local") or self.spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="lakequill-")
        return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)


def query(sql: str | None = None) -> Callable:
    """Register f(tables) under its name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt to four tasks a core by its keys, if it comes in few splits: a file of few row groups leaves most cores idle. Inputs of many splits stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() > 2 * cores else df.repartition(4 * cores, *keys)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on the order of rows in the last places."""
    return df.select(*(F.round(F.col(c), digits).alias(c) if c in columns else F.col(c) for c in df.columns))


def r6(c: Column) -> Column:
    return F.round(c, 6)
