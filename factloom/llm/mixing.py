"""Operator 1: mix sources to target weights (Pfair scheduling), in SQL functions only.

Every source is cut into blocks of ``block_rows`` documents. With weight w out of
W, block j of a source (from 0) is released at slot floor(j * W / w) and due at
ceil((j + 1) * W / w); each slot takes the released block that is due first (of
equal ones the source that sorts first). Then after any number of slots a source
is less than one block away from its share. Where a source runs out, a phase
ends, and the next one starts with the sources left and their weights.

The schedule repeats every W slots, so one period per phase describes it: sums of
weights and the number of sources bound it, not the data. A document finds its
slot by its rank inside its source, which is counted per (source, hash bucket),
so that a source with a third of all rows is dealt to as many tasks as others.

Weights are positive integers; sources not named get ``default_weight``. A null
source is a source of its own, sorted first. Documents keep a pseudo-random order
inside their source; rows equal in id follow the other columns. No document is
dropped: a source longer than its share fills the end of the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from factloom.functions.skew import broadcast_if_small
from factloom.llm.tables import documents
from factloom.session import durable

BLOCK_ROWS = 32
# Production weights of the registered query: shares of blocks.
WEIGHTS = {"src0": 6, "src1": 3, "src2": 3, "src3": 2, "src4": 2}
DEFAULT_WEIGHT = 1
SEED = "mix"
BUCKET_DIGITS = 3
OUTPUTS = ("slot", "place", "position")


def _weight(source: Column, weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, w in weights.items():
        out = F.when(source == name, F.lit(w)).otherwise(out)
    return F.coalesce(out, F.lit(default)).cast("long")


# SQL with names: LET binds a value inside an expression.
def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


# One period of a phase p (live: structs i, w, n; total: their weights): per slot
# the source whose released block is due first.
_PERIOD = """
aggregate(
  sequence(0L, p.total - 1),
  named_struct('order', array_repeat(0L, 0), 'taken', transform(p.live, s -> 0L)),
  (acc, t) -> transform(array(
    array_min(transform(
      filter(zip_with(p.live, acc.taken, (s, c) -> named_struct('s', s, 'c', c)), x -> x.c * p.total < (t + 1) * x.s.w),
      x -> named_struct('due', ((x.c + 1) * p.total + x.s.w - 1) div x.s.w, 'i', x.s.i)))),
    pick -> named_struct(
      'order', concat(acc.order, array(pick.i)),
      'taken', zip_with(p.live, acc.taken, (s, c) -> c + if(s.i = pick.i, 1L, 0L))))[0],
  acc -> acc.order)
"""
# Slots of source s in the period; its blocks in the first ``length`` slots.
_SLOTS = "filter(transform(period, (o, t) -> if(o = s.i, CAST(t AS BIGINT), NULL)), t -> t IS NOT NULL)"
_USED = "(length div p.total * s.w + size(filter(slice(period, 1, CAST(length % p.total AS INT)), o -> o = s.i)))"
# A phase ends with the slot that takes the last block of some source.
_LENGTH = f"""
array_min(transform(p.live, s ->
  (s.n - 1) div s.w * p.total + 1 + element_at({_SLOTS}, CAST((s.n - 1) % s.w + 1 AS INT))))
"""
_PHASE = f"""
named_struct(
  'state', transform(acc.state, s -> if(s.n = 0, s, named_struct('i', s.i, 'w', s.w, 'n', s.n - {_USED}, 'done', s.done + {_USED}))),
  'start', acc.start + length,
  'out', concat(acc.out, transform(p.live, s -> named_struct(
    'i', s.i, 'first', s.done, 'n', {_USED}, 'w', s.w, 'total', p.total, 'start', acc.start, 'slots', {_SLOTS}))))
"""
_STEP = _let(
    "live", "filter(acc.state, s -> s.n > 0)",
    _let("p", "named_struct('live', live, 'total', aggregate(live, 0L, (a, s) -> a + s.w))",
         _let("period", _PERIOD, _let("length", _LENGTH, _PHASE))))
_ALL_PHASES = f"""
aggregate(sources,
  named_struct(
    'state', transform(sources, s -> named_struct('i', s._i, 'w', s._w, 'n', s._blocks, 'done', 0L)),
    'start', 0L,
    'out', array_repeat(named_struct('i', 0L, 'first', 0L, 'n', 0L, 'w', 0L, 'total', 0L, 'start', 0L, 'slots', array_repeat(0L, 0)), 0)),
  (acc, _) -> if(exists(acc.state, s -> s.n > 0), {_STEP}, acc),
  acc -> acc.out)
"""


def schedule(sources: DataFrame) -> DataFrame:
    """Per source _i its phases: first block, blocks, weight, all weights, first slot, slots in a period.

    ``sources`` has _i, _w and _blocks. One row holds all sources and is stepped
    once per source; no document is part of it.
    """
    row = sources.agg(F.array_sort(F.collect_list(F.struct("_i", "_w", "_blocks"))).alias("sources"))
    phases = row.select(F.explode(F.expr(_ALL_PHASES)).alias("p")).select("p.*").filter("n > 0")
    plan = F.array_sort(F.collect_list(F.struct("first", "n", "w", "total", "start", "slots")))
    return phases.groupBy(F.col("i").alias("_i")).agg(plan.alias("_plan"))


def _slot(block: str) -> Column:
    return F.expr(_let(
        "p", f"filter(_plan, p -> {block} >= p.first AND {block} < p.first + p.n)[0]",
        f"p.start + ({block} - p.first) div p.w * p.total + p.slots[CAST(({block} - p.first) % p.w AS INT)]"))


def mix(
    docs: DataFrame, weights: dict[str, int] | None = None, default_weight: int = DEFAULT_WEIGHT,
    block_rows: int = BLOCK_ROWS, source: str = "source", id_column: str = "doc_id", seed: str = SEED,
) -> DataFrame:
    """The documents with the slot of their block, their place in it and their position in the mix.

    Columns named like an output are replaced.
    """
    weights = WEIGHTS if weights is None else weights
    if min([default_weight, *weights.values()]) < 1:
        raise ValueError("weights must be positive")
    docs = docs.drop(*OUTPUTS)
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))))
    bucket = F.substring(order, 1, BUCKET_DIGITS)
    counts = durable(docs.groupBy(F.col(source).alias("_source"), bucket.alias("_bucket")).agg(F.count("*").alias("_n")))
    sizes = counts.groupBy(F.col("_source").alias("_name")).agg(F.sum("_n").alias("_rows"))
    # One window over as many rows as there are sources.
    sources = sizes.select(
        "_name", "_rows", (F.row_number().over(Window.orderBy(F.asc_nulls_first("_name"))) - 1).cast("long").alias("_i"),
        _weight(F.col("_name"), weights, default_weight).alias("_w"), F.ceil(F.col("_rows") / block_rows).alias("_blocks"))
    plan = schedule(sources).join(sources.withColumnRenamed("_i", "_j"), F.col("_i") == F.col("_j"))
    # A source's last block may be short: (its slot, rows it lacks).
    plan = durable(plan.select("_i", "_name", "_plan", F.struct(
        _slot("(_blocks - 1)").alias("slot"), (F.col("_blocks") * block_rows - F.col("_rows")).alias("lack")).alias("_short")))
    names = plan.select("_i", "_name")
    before = Window.partitionBy("_i").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.join(names, F.col("_source").eqNullSafe(F.col("_name"))).select(
        "_i", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))

    ties = [F.col(f"`{f.name}`") for f in docs.schema if f.name != id_column and not isinstance(f.dataType, (MapType, VariantType))]
    rank = F.row_number().over(Window.partitionBy("_i", "_bucket").orderBy("_order", F.col(id_column), *ties))
    dealt = docs.select("*", order.alias("_order"), bucket.alias("_bucket"))
    dealt = dealt.join(broadcast_if_small(names), F.col(source).eqNullSafe(F.col("_name"))).drop("_name")
    ranked = dealt.withColumn("_rank", rank).join(starts, ["_i", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before") - 1)
    ranked = ranked.withColumn("_block", F.expr(f"_rank div {block_rows}"))
    every = Window.partitionBy()  # as many rows as there are sources
    placed = ranked.join(broadcast_if_small(plan.select("_i", "_plan", F.collect_list("_short").over(every).alias("_shorts"))), "_i")
    placed = placed.withColumn("slot", _slot("_block")).withColumn("place", F.expr(f"_rank % {block_rows}"))
    lack = F.expr("aggregate(filter(_shorts, x -> x.slot < slot), 0L, (a, x) -> a + x.lack)")
    return placed.withColumn("position", F.col("slot") * block_rows + F.col("place") - lack).select(
        *[F.col(f"`{c}`") for c in docs.columns], *OUTPUTS)


def in_order(mixed: DataFrame) -> DataFrame:
    """Rows dealt to partitions and sorted by their position."""
    return mixed.repartitionByRange("position").sortWithinPartitions("position")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir, "doc_id", "source"))


def _case(weights: dict[str, int], default: int) -> str:
    return "CASE source " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items()) + f" ELSE {default} END"


# Slot by slot, without periods or phase plans.
ORACLE = f"""
WITH RECURSIVE sources AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) AS i, {_case(WEIGHTS, DEFAULT_WEIGHT)}::BIGINT AS w,
         ((count(*) + {BLOCK_ROWS - 1}) // {BLOCK_ROWS})::BIGINT AS blocks
  FROM documents GROUP BY source
), run AS (
  SELECT 0::BIGINT AS slot, 0::BIGINT AS t, NULL::BIGINT AS pick, list(w ORDER BY i) AS w, list(blocks ORDER BY i) AS n,
         list(0::BIGINT ORDER BY i) AS taken
  FROM sources
  UNION ALL
  SELECT slot + 1, CASE WHEN n[k] = 1 THEN 0 ELSE t + 1 END, k, w,
         list_transform(n, lambda x, i: x - CASE WHEN i = k THEN 1 ELSE 0 END),
         CASE WHEN n[k] = 1 THEN list_transform(n, lambda x: 0::BIGINT)
              ELSE list_transform(taken, lambda x, i: x + CASE WHEN i = k THEN 1 ELSE 0 END) END
  FROM (
    SELECT *, list_sort(list_transform(
        list_filter(range(1, len(n) + 1), lambda i: n[i] > 0 AND taken[i] * total < (t + 1) * w[i]),
        lambda i: [((taken[i] + 1) * total + w[i] - 1) // w[i], i]))[1][2] AS k
    FROM (SELECT *, list_sum(list_transform(range(1, len(n) + 1), lambda i: CASE WHEN n[i] > 0 THEN w[i] ELSE 0 END))::BIGINT AS total FROM run)
    WHERE total > 0)
), blocks AS (
  SELECT pick AS i, slot - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS block
  FROM run WHERE pick IS NOT NULL
), ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS rank
  FROM documents
)
SELECT doc_id, r.source, slot, rank % {BLOCK_ROWS} AS place,
       row_number() OVER (ORDER BY slot, rank % {BLOCK_ROWS}) - 1 AS position
FROM ranked r JOIN sources s ON r.source IS NOT DISTINCT FROM s.source
JOIN blocks b ON b.i = s.i AND b.block = rank // {BLOCK_ROWS}
"""

QUERIES = {"op1_source_mix": op1_source_mix}
ORACLES = {"op1_source_mix": ORACLE}
