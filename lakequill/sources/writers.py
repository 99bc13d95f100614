"""Sinks. Spark's committer makes them atomic: a file is visible whole or not at all."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    """Idempotent: the same rows again leave the same table."""
    df.write.mode("overwrite").json(path)


def write_record(spark: SparkSession, path: str, record: dict) -> None:
    """One record as a file of its own name, which appears whole: it is written beside and then renamed."""
    jvm, hidden = spark.sparkContext._jvm, re.sub(r"([^/]+)$", r"_\1.tmp", path)
    place, temporary = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, hidden))
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(temporary, True)
    out.write(json.dumps(record).encode())
    out.close()
    files.delete(place, False)
    files.rename(temporary, place)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_per_key(df: DataFrame, path: str, key: str) -> None:
    """One folder for each key, so that a key can be rewritten alone."""
    df.write.mode("overwrite").partitionBy(key).json(path)


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A small aggregate as a Markdown table; more than `limit` rows raise."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])


def fill_template(template: str, values: dict[str, str]) -> tuple[str, list[str]]:
    """{{name}} replaced where a value is known, and the names that were not."""
    missing = sorted({n for n in re.findall(r"\{\{\s*(\w+)\s*\}\}", template) if n not in values})
    return re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: values.get(m[1], m[0]), template), missing


def canonical_hash(value: object) -> str:
    """SHA-256 of compact ASCII JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


def row_hash(*columns: str) -> Column:
    """SHA-256 of a row's columns as compact JSON, names in order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def batches(df: DataFrame, size: int, *order: str, within: str | None = None) -> DataFrame:
    """batch numbers of `size` rows each, in the given order, within a key if one is given."""
    from lakequill.operators.ranks import row_numbers

    return row_numbers(df, [within] if within else [], list(order), "_i").withColumn("batch", F.floor((F.col("_i") - 1) / size).cast("int")).drop("_i")
