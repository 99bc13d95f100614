"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, mixing to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakequill.llm.common import Store, table
from lakequill.llm.decontaminate import decontaminate_stage
from lakequill.llm.line_dedup import line_dedup_stage
from lakequill.llm.mixing import mixing_stage
from lakequill.llm.simhash import simhash_stage
from lakequill.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("decontamination", decontaminate_stage),
    ("source_mixing", mixing_stage),
]

#: Neither the classifier nor fingerprints and their components can be said in SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    store, docs = Store(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else store.save(out, name)
    return docs
