"""Packed shuffles of (hash, document, position): find which hashes meet others.

One row of such a shuffle holds what a slice of texts has for one bucket of
hashes, so a place costs a few bytes. Every hash goes to the bucket its value
names; a bucket holds a bounded share of the text. What a slice can settle by
itself is settled there and sent on once, so a hash that a third of all
documents share costs one place per slice, not one per document. What is found goes back to
the documents the same way, one row per bucket and group of documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from factloom.llm.packed import pack, slices, unpack
from factloom.llm.tables import row_check

PACKED = "bucket int, known boolean, hashes binary, places binary"
HITS = "_group int, docs binary, values binary"
_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), ("hashes", pa.binary()), ("places", pa.binary())])
_HITS_ARROW = pa.schema([("_group", pa.int32()), ("docs", pa.binary()), ("values", pa.binary())])
_PRIME, _STEP = (1 << 31) - 1, 1_000_003


def keyed(docs: DataFrame, id_column: str, text: str, groups: int = 1) -> DataFrame:
    """Add the key of a row, id and text hash without nulls (a null id has a negative check), and its group."""
    check = row_check(text)
    found = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(0)).alias("_id"),
        F.when(F.col(f"`{id_column}`").isNull(), -1 - check).otherwise(check).alias("_check"),
    )
    spread = F.pmod("_id", F.lit(_PRIME)) * _STEP + F.when(F.col("_check") < 0, -1 - F.col("_check")).otherwise(F.col("_check")) % _PRIME
    return found.withColumn("_group", (spread % groups).cast("int"))


def group_of(ids: np.ndarray, checks: np.ndarray, groups: int) -> np.ndarray:
    """The groups that ``keyed`` gives to these keys."""
    return (ids % _PRIME * _STEP + np.where(checks < 0, -1 - checks, checks) % _PRIME) % groups


def packed_rows(
    batch: pa.RecordBatch, row: np.ndarray, at: np.ndarray, hashes: np.ndarray, bucket: np.ndarray, known: bool
) -> Iterator[pa.RecordBatch]:
    """Places in rows of one bucket each; ``row`` and ``at`` ascend."""
    if not len(row):
        return
    ids = batch.column("_id").to_numpy(zero_copy_only=False)
    checks = batch.column("_check").to_numpy(zero_copy_only=False)
    order = np.argsort(bucket, kind="stable")
    bucket, row, at, hashes = bucket[order], row[order], at[order], hashes[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    out: list[tuple] = []
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
        r, a = row[lo:hi], at[lo:hi]
        heads = np.concatenate([[0], np.flatnonzero(np.diff(r)) + 1])
        steps = np.diff(a, prepend=0)
        steps[heads] = a[heads]
        counts = np.diff(np.append(heads, hi - lo))
        places = pack(ids[r[heads]], checks[r[heads]], counts.astype(np.uint32), steps.astype(np.uint32))
        out.append((int(bucket[lo]), known, b"" if known else hashes[lo:hi].tobytes(), places))
    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _PACKED_ARROW, strict=True)], schema=_PACKED_ARROW)


def _opened(block: bytes) -> tuple[np.ndarray, ...]:
    ids, checks, counts, steps = unpack(block)
    ids, checks, counts = ids.view(np.int64), checks.view(np.int64), counts.astype(np.int64)
    at = np.cumsum(steps.astype(np.int64))
    first = np.cumsum(counts) - counts
    at -= np.repeat(at[first] - steps[first], counts)
    return ids, checks, counts, at


def hit_rows(ids: np.ndarray, checks: np.ndarray, doc: np.ndarray, groups: int, *values: np.ndarray) -> pa.Table:
    """Values of documents (``doc`` numbers them) as rows of ``HITS``, one per group of documents."""
    group = group_of(ids, checks, groups)
    order = np.lexsort((doc, group[doc]))
    doc, values = doc[order], [np.ascontiguousarray(v[order], np.uint32) for v in values]
    cuts = np.flatnonzero(np.diff(group[doc])) + 1
    out = []
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(doc)], strict=True):
        if hi > lo:
            heads = lo + np.concatenate([[0], np.flatnonzero(np.diff(doc[lo:hi])) + 1])
            docs = pack(ids[doc[heads]], checks[doc[heads]], np.diff(np.append(heads, hi)))
            out.append((int(group[doc[lo]]), docs, pack(*(v[lo:hi] for v in values))))
    return pa.table([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_HITS_ARROW)], schema=_HITS_ARROW)


def meet(packed: DataFrame, width: int, decide: Callable[[np.ndarray, np.ndarray], np.ndarray], groups: int) -> DataFrame:
    """Places (rows of ``HITS``) whose hash passes ``decide(runs, at)``, plus those already known.

    ``runs`` numbers the hash of each place from 0; ``decide`` answers for each
    number. One bucket is in memory at a time.
    """
    kind = np.uint32 if width == 4 else np.uint64

    def one_bucket(table: pa.Table) -> pa.Table:
        rows = table.select(["known", "hashes", "places"]).to_pylist()
        out = [_HITS_ARROW.empty_table()]
        known = [_opened(r["places"]) for r in rows if r["known"]]
        if known:
            ids, checks, counts, at = (np.concatenate(x) for x in zip(*known, strict=True))
            out.append(hit_rows(ids, checks, np.repeat(np.arange(len(ids)), counts), groups, at))
        opened = [(np.frombuffer(r["hashes"], kind), *_opened(r["places"])) for r in rows if not r["known"]]
        if opened:
            hashes, ids, checks, counts, at = (np.concatenate(x) for x in zip(*opened, strict=True))
            order = np.argsort(hashes)
            runs = np.empty(len(order), np.int64)
            runs[order] = np.cumsum(np.concatenate([[0], np.diff(hashes[order]) != 0]))
            hit = decide(runs, at)[runs]
            out.append(hit_rows(ids, checks, np.repeat(np.arange(len(ids)), counts)[hit], groups, at[hit]))
        return pa.concat_tables(out)

    return packed.groupBy("bucket").applyInArrow(one_bucket, HITS)


class Located:
    """The hits of a group of documents, by row of the group's table."""

    def __init__(self, docs: pa.Table, hits: pa.Table) -> None:
        numbers: dict[tuple[int, int], int] = {}
        keys = zip(docs.column("_id").to_pylist(), docs.column("_check").to_pylist(), strict=True)
        self._key = [numbers.setdefault(k, len(numbers)) for k in keys]
        owners, values = [np.zeros(0, np.int64)], []
        for row in hits.select(["docs", "values"]).to_pylist():
            ids, checks, counts = unpack(row["docs"])
            mine = [numbers[k] for k in zip(ids.view(np.int64).tolist(), checks.view(np.int64).tolist(), strict=True)]
            owners.append(np.repeat(np.array(mine, np.int64), counts.astype(np.int64)))
            values.append(np.stack(unpack(row["values"]), axis=1))
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        self._values = np.concatenate(values)[order].astype(np.int64) if values else np.zeros((0, 1), np.int64)
        self._ends = np.searchsorted(owner[order], np.arange(len(numbers) + 1))

    def of(self, row: int) -> np.ndarray:
        """The row's hits, one line of values each."""
        key = self._key[row]
        return self._values[self._ends[key]: self._ends[key + 1]]


def with_hits(rows: DataFrame, hits: DataFrame, work: Callable, schema: str, text: str, all_rows: bool) -> DataFrame:
    """Run ``work(batch, hits of each row)`` over slices of the documents of each group.

    Without ``all_rows`` groups that have no hits are passed over.
    """
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def one_group(docs: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        if len(docs) and (all_rows or len(found)):
            located, at = Located(docs, found), 0
            for batch in slices(iter(docs.combine_chunks().to_batches()), text):
                out += work(batch, [located.of(at + r) for r in range(len(batch))])
                at += len(batch)
        return pa.Table.from_batches(out).cast(arrow) if out else arrow.empty_table()

    return rows.groupBy("_group").cogroup(hits.groupBy("_group")).applyInArrow(one_group, schema)
