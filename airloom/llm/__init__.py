"""Operators for training-data pipelines, and the queries that apply them.

Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from airloom.llm.bpe import op1_byte_bpe
from airloom.llm.chat import op10_chat_formats
from airloom.llm.decontaminate import op6_benchmark_hits
from airloom.llm.divergence import op13_source_divergence
from airloom.llm.fingerprint import op5_fingerprints
from airloom.llm.html_text import op7_html_text
from airloom.llm.mixing import op11_source_mix
from airloom.llm.ngram_join import op3_ngram_join
from airloom.llm.prefix_trie import op12_prefix_trie
from airloom.llm.quality import op4_quality
from airloom.llm.span_dedup import op9_span_dedup
from airloom.llm.suffix_dedup import op8_suffix_dedup
from airloom.llm.toxicity import op2_toxicity
from airloom.llm.twins import SQL

_QUERIES = (
    op1_byte_bpe,
    op2_toxicity,
    op3_ngram_join,
    op4_quality,
    op5_fingerprints,
    op6_benchmark_hits,
    op7_html_text,
    op8_suffix_dedup,
    op9_span_dedup,
    op10_chat_formats,
    op11_source_mix,
    op12_prefix_trie,
    op13_source_divergence,
)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def llm_sql() -> dict[str, str]:
    return dict(SQL)
