"""Operator 13: exact Lloyd clustering with the dimensions dealt over shards.

Vectors become integers floor(scale * x) and are packed into chunks of rows; each
chunk is cut into column blocks, one row of the shard table per (chunk, block). In
a round every block task computes exact partial squared distances against its
slice of the centroids, the blocks of a chunk are added up where the smallest sum
picks the cluster, and every block sums its own columns by cluster to move its own
slice. Vectors are read once; a round shuffles packed blocks and partial distances.

What travels through the driver is the centroids alone: k times the dimensions
(40 times 64 numbers by default), whatever the number of vectors.

Defined results: a vector that is null, has another number of components, or one
null or non-finite component takes no part and gives no row. A null id is kept,
hashes as empty text and comes back as null. Rows of one id are vectors of their
own, told apart by their components where hashes tie. With fewer than k vectors all
of them are centroids; an empty table gives no rows. Components beyond 2^27 in
magnitude after scaling count as 2^27, so that distances fit 64 bits. Columns other
than id and vector, whatever their names, are not read; join by id for them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import durable

CLUSTERS, ROUNDS, SEED = 40, 5, 2
DIMENSIONS, SCALE = 64, 256
# Columns of one shard, and vectors of one packed chunk.
SHARD_COLUMNS, CHUNK_ROWS = 32, 1024
# Integers up to this size have exact squared distances in 64 bits.
LARGEST = 1 << 27
# Below this size products and sums over a block are exact in doubles.
_EXACT_IN_DOUBLE = 1 << 20

Slices = list[np.ndarray]


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as a double, held within LARGEST."""
    def one(x: Column) -> Column:
        scaled = F.floor(F.greatest(F.least(x.cast("double") * F.lit(float(scale)), F.lit(float(LARGEST))), F.lit(-float(LARGEST))))
        return scaled.cast("int")

    return F.transform(vector, one)


def usable(vectors: DataFrame, vec_id: str, vector: str, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, v): vectors of full length, every component a finite number, as integers."""
    finite = F.forall(F.col("x"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    plain = vectors.select(F.col(_quoted(vec_id)).alias("vec_id"), F.col(_quoted(vector)).cast("array<double>").alias("x"))
    return plain.filter((F.size("x") == dimensions) & finite).select("vec_id", integers(F.col("x"), scale).alias("v"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _narrow(block: np.ndarray) -> bytes:
    """The block in the smallest of 16, 32 and 64 bits, with its width in front."""
    top = int(np.abs(block).max(initial=0))
    kind = np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64
    return bytes([np.dtype(kind).itemsize]) + np.ascontiguousarray(block, kind).tobytes()


def _wide(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, f"i{data[0]}", offset=1).astype(np.int64).reshape(-1, columns)


def shard_table(kept: DataFrame, dimensions: int, shard_columns: int, chunk_rows: int) -> DataFrame:
    """(chunk, shard, block, ids): packed column blocks; the ids are with shard 0 alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, chunk_rows):
                part = batch.slice(at, chunk_rows)
                matrix = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dimensions)
                blocks = [_narrow(matrix[:, c:c + shard_columns]) for c in range(0, dimensions, shard_columns)]
                ids = [part.column("vec_id").cast(pa.int64()).to_pylist(), *[None] * (len(blocks) - 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([made] * len(blocks), pa.int64()), pa.array(range(len(blocks)), pa.int32()),
                     pa.array(blocks, pa.binary()), pa.array(ids, pa.list_(pa.int64()))],
                    names=["chunk", "shard", "block", "ids"])
                made += 1

    return kept.mapInArrow(run, "chunk long, shard int, block binary, ids array<long>")


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the smallest hashes, in the order of the hashes."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = kept.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k)
    return np.array([row["v"] for row in first.collect()], np.int64)


def partial_distances(block: np.ndarray, slice_: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids over the columns of one block."""
    top = max(int(np.abs(block).max(initial=0)), int(np.abs(slice_).max(initial=0)))
    if top < _EXACT_IN_DOUBLE:
        b, c = block.astype(np.float64), slice_.astype(np.float64)
        found = (b * b).sum(1)[:, None] - 2.0 * (b @ c.T) + (c * c).sum(1)[None, :]
        return found.astype(np.int64)
    return np.stack([((block - c) ** 2).sum(1) for c in slice_], axis=1)


def assign(shards: DataFrame, slices: Slices) -> DataFrame:
    """(chunk, cluster array, distance array): nearest centroid of every vector, ties to the smaller number."""
    k = len(slices[0])

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, shard in enumerate(batch.column("shard").to_pylist()):
                block = _wide(batch.column("block")[i].as_py(), slices[shard].shape[1])
                part = _narrow(partial_distances(block, slices[shard]))
                yield pa.RecordBatch.from_arrays([batch.column("chunk").slice(i, 1), pa.array([part], pa.binary())], names=["chunk", "part"])

    def nearest(rows: pa.Table) -> pa.Table:
        total = sum(_wide(part.as_py(), k) for part in rows.column("part"))
        cluster = total.argmin(1)
        return pa.table({
            "chunk": rows.column("chunk").slice(0, 1),
            "cluster": pa.array([cluster], pa.list_(pa.int32())),
            "distance": pa.array([total[np.arange(len(total)), cluster]], pa.list_(pa.int64())),
        })

    parts = shards.select("chunk", "shard", "block").mapInArrow(distances, "chunk long, part binary")
    return parts.groupBy("chunk").applyInArrow(nearest, "chunk long, cluster array<int>, distance array<long>")


def move(shards: DataFrame, slices: Slices) -> Slices:
    """One round: assign, sum every shard's columns by cluster, and move every slice.

    Sums of a task leave it as one row per shard and cluster that it has met.
    """
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        counts = [np.zeros(len(s), np.int64) for s in slices]
        for batch in batches:
            for i, shard in enumerate(batch.column("shard").to_pylist()):
                block = _wide(batch.column("block")[i].as_py(), slices[shard].shape[1])
                cluster = np.asarray(batch.column("cluster")[i].values)
                total = held.setdefault(shard, np.zeros(slices[shard].shape, np.int64))
                order = np.argsort(cluster, kind="stable")
                found, starts = np.unique(cluster[order], return_index=True)
                total[found] += np.add.reduceat(block[order], starts, axis=0)
                counts[shard] += np.bincount(cluster, minlength=len(total))
        for shard, total in held.items():
            met = np.flatnonzero(counts[shard])
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(met), pa.int32()), pa.array(met, pa.int32()), pa.array(counts[shard][met], pa.int64()),
                 pa.array(list(total[met]), pa.list_(pa.int64()))], names=["shard", "cluster", "n", "s"])

    dealt = shards.select("chunk", "shard", "block").join(assign(shards, slices).select("chunk", "cluster"), "chunk")
    by_task = dealt.select("shard", "block", "cluster").mapInArrow(sums, "shard int, cluster int, n long, s array<long>")
    by_column = by_task.select("shard", "cluster", "n", F.posexplode("s").alias("place", "s"))
    total = by_column.groupBy("shard", "cluster", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    means = durable(total.select("shard", "cluster", "place", F.expr("(s - pmod(s, n)) div n").alias("mean")))
    moved = [s.copy() for s in slices]
    for row in means.collect():  # at most clusters x dimensions rows
        moved[row["shard"]][row["cluster"], row["place"]] = row["mean"]
    return moved


def cluster(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED,
    dimensions: int = DIMENSIONS, scale: int = SCALE, shard_columns: int = SHARD_COLUMNS, chunk_rows: int = CHUNK_ROWS,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) per usable vector after ``rounds`` rounds, and the final centroids."""
    kept = usable(vectors, vec_id, vector, dimensions, scale)
    shards = durable(shard_table(kept, dimensions, shard_columns, chunk_rows))
    centres = first_centroids(kept, k, seed)
    if not len(centres):
        none = kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).filter(F.lit(False))
        return none, np.zeros((0, dimensions), np.int64)
    slices = [centres[:, c:c + shard_columns] for c in range(0, dimensions, shard_columns)]
    for _ in range(rounds):
        slices = move(shards, slices)
    named = assign(shards, slices).join(shards.filter("shard = 0").select("chunk", "ids"), "chunk")
    found = durable(named.select(F.inline(F.arrays_zip("ids", "cluster", "distance"))).withColumnRenamed("ids", "vec_id"))
    return found, np.concatenate(slices, axis=1)


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centres = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    inertia = dict(found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect())  # one row per cluster
    rows = [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, centre.tolist())).encode()).hexdigest())
            for c, centre in enumerate(centres)]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The rounds as chained common tables, one component list per vector."""
    distance = "list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    parts = [f"""kept AS MATERIALIZED (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})""",
             f"""c0 AS MATERIALIZED (
      SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS INT) AS c, v FROM kept
      ORDER BY sha256('{SEED}:' || vec_id) LIMIT {CLUSTERS})"""]
    for r in range(ROUNDS + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
      SELECT vec_id, v, best[2] AS c, best[1] AS d FROM (
        SELECT v.vec_id, any_value(v.v) AS v, min([{distance}, c.c]) AS best FROM kept v, c{r} c GROUP BY v.vec_id))""")
        if r < ROUNDS:
            parts.append(f"""m{r} AS MATERIALIZED (
      SELECT c, list(m ORDER BY i) AS v FROM (
        SELECT c, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
        FROM (SELECT c, unnest(v) AS x, unnest(range({DIMENSIONS})) AS i FROM a{r}) GROUP BY c, i) GROUP BY c)""")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))")
    return "WITH " + ",\n".join(parts) + f"""
    SELECT a.vec_id, CAST(a.c AS INT) AS cluster, a.d AS distance,
           CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
           sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.c = a.c"""


QUERIES = {"op13_centroid_clusters": op13_centroid_clusters}
ORACLES = {"op13_centroid_clusters": _oracle()}
