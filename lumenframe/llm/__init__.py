"""Training-data operators.  Nothing outside this subpackage imports it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import conversation_repair, embedding_dedup, exact_dedup, fill_middle, jaccard_join, language_id, mixing, packing, sharding, token_counts, token_output, toxicity, transport_stream

_MODULES = (exact_dedup, token_counts, jaccard_join, packing, language_id, toxicity, sharding, token_output, mixing, transport_stream, embedding_dedup, fill_middle, conversation_repair)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(m, name) for m in _MODULES for name in vars(m) if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
