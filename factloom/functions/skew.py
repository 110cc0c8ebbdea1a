"""Building blocks that stay bounded when one key holds a large share of the rows.

Nothing here gathers a whole group in one task: group-wise picks are aggregates
with map-side combine, ordered scans run per (key, bucket) and are stitched
together through one small row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A side whose estimated size is below this may be broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate for ``df`` (no job is run)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only where the optimizer's estimate proves the side small."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def pick_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """One row per key: the one that sorts first. Combines before the shuffle."""
    ordering = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), ordering).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in cols])


def pick_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """One row per key: the one that sorts last."""
    ordering = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), ordering).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in cols])


def running_sum(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], value: Column, out: str
) -> DataFrame:
    """Inclusive running sum of ``value`` per key.

    ``bucket`` must not decrease along ``order``. Rows are summed inside their
    bucket; the totals of earlier buckets come from a table with one row per
    (key, bucket), so a hot key is spread over as many tasks as it has buckets.
    """
    tagged = df.withColumn("_b", bucket).withColumn("_v", value)
    totals = tagged.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off")
    )
    within = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumn("_s", F.sum("_v").over(within))
    return (
        local.join(offsets, [*keys, "_b"])
        .withColumn(out, F.col("_s") + F.col("_off"))
        .drop("_b", "_v", "_s", "_off")
    )


def previous_row(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], cols: Sequence[str], prefix: str
) -> DataFrame:
    """``lag(1)`` of ``cols`` per key, spread over buckets (see running_sum)."""
    tagged = df.withColumn("_b", bucket)
    ordering = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    tails = tagged.groupBy(*keys, "_b").agg(F.max_by(F.struct(*cols), ordering).alias("_tail"))
    by_bucket = Window.partitionBy(*keys).orderBy("_b")
    carried = tails.select(*keys, "_b", F.lag("_tail").over(by_bucket).alias("_carry"))
    within = Window.partitionBy(*keys, "_b").orderBy(*order)
    local = tagged.withColumn("_lag", F.lag(F.struct(*cols)).over(within))
    joined = local.join(carried, [*keys, "_b"]).withColumn("_prev", F.coalesce("_lag", "_carry"))
    for c in cols:
        joined = joined.withColumn(prefix + c, F.col(f"_prev.{c}"))
    return joined.drop("_b", "_lag", "_carry", "_prev")


def last_value_before(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], value: Column, out: str
) -> DataFrame:
    """Latest non-null ``value`` at or before each row, spread over buckets."""
    tagged = df.withColumn("_b", bucket).withColumn("_v", value)
    ordering = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    tails = tagged.groupBy(*keys, "_b").agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), ordering)).alias("_tail")
    )
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*keys, "_b", F.last("_tail", ignorenulls=True).over(before).alias("_carry"))
    within = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumn("_l", F.last("_v", ignorenulls=True).over(within))
    return (
        local.join(carried, [*keys, "_b"])
        .withColumn(out, F.coalesce("_l", "_carry"))
        .drop("_b", "_v", "_l", "_carry")
    )


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salts: int = 32) -> DataFrame:
    """First ``k`` rows per key with their ``rank``; at most ``k * salts`` rows of a
    key reach its final task however large the group is."""
    spread = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    survivors = spread.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k).drop("_r", "_salt")
    final = Window.partitionBy(*keys).orderBy(*order)
    return survivors.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)


def distinct_count(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Distinct values per key in two combining aggregations."""
    return df.select(*keys, value).distinct().groupBy(*keys).agg(F.count(value).alias(out))


def running_max(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], value: Column, out: str
) -> DataFrame:
    """Largest ``value`` at or before each row per key, spread over buckets."""
    tagged = df.withColumn("_b", bucket).withColumn("_v", value)
    tails = tagged.groupBy(*keys, "_b").agg(F.max("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*keys, "_b", F.max("_t").over(before).alias("_carry"))
    within = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumn("_l", F.max("_v").over(within))
    return (
        local.join(carried, [*keys, "_b"])
        .withColumn(out, F.when(F.col("_carry") > F.col("_l"), F.col("_carry")).otherwise(F.col("_l")))
        .drop("_b", "_v", "_l", "_carry")
    )
