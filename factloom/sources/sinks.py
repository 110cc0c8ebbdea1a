"""Write derived facts and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import collapse_whitespace
from factloom.session import checkpoint_dir


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder name beside the shared checkpoints."""
    return f"{checkpoint_dir(spark).rstrip('/')}/facts-{uuid.uuid4().hex}"


def write_facts(facts: DataFrame, path: str, partitions: tuple[str, ...] = ("snapshot_id",), rows_per_file: int = 5_000_000) -> None:
    """One folder per snapshot, replaced as a whole. A snapshot is spread over
    as many tasks as AQE finds it needs; a large one is split by file size."""
    (
        facts.hint("rebalance", *partitions)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", rows_per_file).partitionBy(*partitions).parquet(path)
    )


def tsv_report(findings: DataFrame) -> DataFrame:
    """code, position and message of each finding as one tab-separated line."""
    place = F.concat_ws(":", "uri", F.col("line").cast("string"), F.col("character").cast("string"))
    return findings.select(
        F.concat_ws("\t", "code", place, F.btrim(collapse_whitespace("message"))).alias("line")
    )


def write_report(findings: DataFrame, path: str) -> None:
    tsv_report(findings).write.mode("overwrite").text(path)
