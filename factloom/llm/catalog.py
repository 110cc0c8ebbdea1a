"""Queries of this subpackage and their SQL checks, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import (
    byte_bpe,
    centroids,
    fingerprints,
    jaccard_join,
    language_id,
    mixing,
    perplexity,
    prefix_trie,
    quality_rules,
    substring_dedup,
    suffix_dedup,
    token_counts,
    word_bpe,
)

_MODULES = (
    mixing, suffix_dedup, jaccard_join, perplexity, language_id, substring_dedup, quality_rules, token_counts, byte_bpe, fingerprints,
    prefix_trie, word_bpe, centroids,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in _MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
