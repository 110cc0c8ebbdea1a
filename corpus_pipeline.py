"""From a corpus to training tokens: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import byte_bpe, jaccard_join, mixing, perplexity, substring_dedup
from factloom.session import durable

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the perplexity model rejects go."""
    trusted = perplexity.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return perplexity.classify(docs, trusted).filter("keep").select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) one document stays."""
    return jaccard_join.one_of_each(docs)


def substring_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat are cut out of the text; documents without a word left go."""
    found = substring_dedup.remove_repeats(docs, keep_layout=True)
    gone = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = found.filter(gone < F.col("n_words")).withColumn("text", F.col("kept_text"))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix, partition after partition."""
    return mixing.in_order(mixing.mix(docs)).select(*docs.columns)


def byte_bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with the text decoded from them, and the slot and position in the mix.

    Stages before hand on documents only, and the order of rows does not outlast a
    table; so the mix of the same rows, which is the same again, is derived here.
    """
    file = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.RANKS_FILE))
    found = byte_bpe.round_trip(mixing.mix(docs), file)
    return found.select(
        "doc_id", F.decode("decoded", "UTF-8").alias("text"), "lang", "source", "n_chars",
        F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "slot", "position")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_removal),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE encoding and decoding", byte_bpe_tokens),
]

# The perplexity model, the set joins and the tokenizer are beyond SQL; the tests
# hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
