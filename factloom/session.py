"""Session set-up and durable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# SQL settings every job here relies on; applied only where the session has not
# chosen a value itself.
_RUNTIME_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Streams keep maps, timers and values by key, which only this store can.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# The fact tables are short strings that compress very well, so the bytes of a file or
# a shuffle say little about the memory its rows take. Splits and merged tasks are kept
# small, and files count as what they unpack to before one side of a join is broadcast.
_FACT_DEFAULTS = {
    "spark.sql.files.maxPartitionBytes": "8m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.sources.fileCompressionFactor": "8.0",
}


def build_session(app: str = "factloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session for local runs and tests; a cluster passes its own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **_RUNTIME_DEFAULTS,
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime defaults to a session somebody else built."""
    explicit = {key for key, _ in spark.sparkContext.getConf().getAll()}
    for key, value in (_RUNTIME_DEFAULTS | _FACT_DEFAULTS).items():
        if key not in explicit:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of checkpoints; a folder of its own only for local masters without one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative jobs")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
    return sc.getCheckpointDir()


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside free their shuffle files as soon as they have ended.

    Otherwise those stay on disk until the driver happens to collect garbage.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there.

    Iterative operators call this once per round: the plan stays short and a
    lost executor costs a re-read, not a recomputation of every earlier round.
    A table is written rather than an RDD checkpoint, which would compute the
    rows twice and hide their size from the optimizer.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    with _shuffles_freed(spark):
        df.write.option("compression", "zstd").option("maxRecordsPerFile", 2_000_000).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows of one task of :func:`spread_by`; a few sorts of them stay within some 300 MB.
_ROWS_A_TASK = 100_000


def spread_by(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, which has about ``rows`` rows, dealt by ``keys`` over as many tasks as they need.

    What a join or an explode makes of a small shuffle can be far larger than that
    shuffle, whose size is all that adaptive execution sees when it merges tasks.
    """
    return df.repartition(max(1, -(-rows // _ROWS_A_TASK)), *keys)
