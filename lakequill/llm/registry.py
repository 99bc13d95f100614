"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lakequill.llm.alignment import op13_tokenizer_alignment
from lakequill.llm.byte_bpe import op11_byte_bpe
from lakequill.llm.decontaminate import op1_decontaminate
from lakequill.llm.divergence import OP12_SQL, op12_source_divergence
from lakequill.llm.embedding_dedup import op8_embedding_dedup
from lakequill.llm.html_extract import op9_html_extract
from lakequill.llm.line_dedup import OP3_SQL, op3_line_dedup
from lakequill.llm.mixing import OP7_SQL, op7_mix_sources
from lakequill.llm.simhash import op10_simhash_near_dedup
from lakequill.llm.suffix_dedup import op5_suffix_dedup
from lakequill.llm.toxicity import op6_toxicity
from lakequill.llm.url_filter import OP4_SQL, op4_url_filter
from lakequill.llm.warc import OP2_SQL, op2_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_decontaminate, op2_warc, op3_line_dedup, op4_url_filter, op5_suffix_dedup, op6_toxicity, op7_mix_sources, op8_embedding_dedup, op9_html_extract,
        op10_simhash_near_dedup, op11_byte_bpe, op12_source_divergence, op13_tokenizer_alignment,
    )
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op3_line_dedup": OP3_SQL, "op4_url_filter": OP4_SQL, "op7_mix_sources": OP7_SQL, "op12_source_divergence": OP12_SQL}
