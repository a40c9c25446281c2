"""Queries and SQL of this package, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontamination,
    embedding_dedup,
    jaccard_join,
    language_id,
    mixing,
    periodic_runs,
    pii,
    sentence_pieces,
    source_divergence,
    suffix_dedup,
    token_counts,
    toxicity,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_source_mixing": mixing.query,
        "op2_warc": warc.query,
        "op3_pii": pii.query,
        "op4_toxicity": toxicity.query,
        "op5_language_id": language_id.query,
        "op6_decontamination": decontamination.query,
        "op7_jaccard_join": jaccard_join.query,
        "op8_token_counts": token_counts.query,
        "op9_embedding_dedup": embedding_dedup.query,
        "op10_suffix_dedup": suffix_dedup.query,
        "op11_sentence_pieces": sentence_pieces.query,
        "op12_source_divergence": source_divergence.query,
        "op13_periodic_runs": periodic_runs.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_source_mixing": mixing.SQL,
        "op2_warc": warc.SQL,
        "op6_decontamination": decontamination.SQL,
        "op7_jaccard_join": jaccard_join.SQL,
        "op9_embedding_dedup": embedding_dedup.SQL,
        "op12_source_divergence": source_divergence.SQL,
    }
