"""Reading the document tables and sizing the work on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Text bytes that one bucket of a packed shuffle stands for.
BUCKET_BYTES = 12 << 20


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def bucket_count(docs: DataFrame, text: str = "text", per_bucket: int = BUCKET_BYTES) -> int:
    """Buckets for a packed shuffle: they follow the text, at least one per shuffle partition."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // per_bucket + 1)


def row_check(text: str = "text") -> Column:
    """Tells rows of one id apart: 63 bits of a hash of the text (the sign is left to callers)."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND((1 << 63) - 1)
