"""Operator 6: remove passages of words that occur more than once (fixed-block anchors).

Every text is cut into non-overlapping blocks of (window + 1) // 2 words; these
reference blocks are the index. A window that repeats holds a whole block of
each of its occurrences, so probing the index with every rolling window of block
length finds all places where a repeat can be. Hits are extended over the
windows around them: two hits belong to one exact repeat if the words to their
left and right are equal, which is settled for all occurrences of a window at
once by the window's hash instead of pair by pair. Overlapping and adjacent
windows join to maximal removed runs.

Nulls and texts without words have no windows. Rows equal in id and text are two
occurrences of their windows. Columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import places as P
from factloom.llm.packed import Words, covered, slices
from factloom.llm.tables import bucket_count, documents

OUTPUTS = ("n_words", "removed_spans", "kept_text")


def block_words(window: int) -> int:
    return (window + 1) // 2


def _probes(window: int, buckets: int, text: str):
    """Every rolling window of block length; hits inside the slice are settled here."""
    block = block_words(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            words = Words(batch.column(text))
            start, hashes = words.windows(block)
            row = words.row[start]
            at = start - words.first_of[row]
            # Only texts of a full window can have a repeat.
            long = words.count[row] >= window
            start, hashes, row, at = start[long], hashes[long], row[long], at[long]
            _, first, runs, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            anchored = np.full(len(n), -1)
            on_grid = np.flatnonzero(at % block == 0)
            anchored[runs[on_grid]] = on_grid
            settled = ((n > 1) & (anchored >= 0))[runs]
            send = ~settled
            send[anchored[(n > 1) & (anchored >= 0)]] = True
            yield from P.packed_rows(batch, row[settled], at[settled], hashes[settled], row[settled] * 0 + int(hashes[0] % buckets) if len(hashes) else row[settled], True)
            yield from P.packed_rows(batch, row[send], at[send], (hashes[send] >> np.uint64(32)).astype(np.uint32), (hashes[send] % np.uint64(buckets)).astype(np.int64), False)

    return run


def _windows(window: int, buckets: int, text: str):
    """Every window that holds a hit; equal ones inside the slice are settled here."""
    block = block_words(window)

    def work(batch: pa.RecordBatch, found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        words = Words(batch.column(text))
        hits = np.zeros(len(words.start) + 1, np.int64)
        for r, at in enumerate(found):
            hits[words.first_of[r] + at[:, 0] + 1] = 1
        hits = np.cumsum(hits)
        start, hashes = words.windows(window)
        near = hits[start + window - block + 1] > hits[start]
        start, hashes = start[near], hashes[near]
        other = words.windows(window, 1)[1][near]
        row = words.row[start]
        at = start - words.first_of[row]
        _, first, runs, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        settled = (n > 1)[runs]
        send = np.zeros(len(start), bool)
        send[first] = True
        yield from P.packed_rows(batch, row[settled], at[settled], hashes[settled], row[settled] * 0 + int(other[0] % buckets) if len(other) else row[settled], True)
        yield from P.packed_rows(batch, row[send], at[send], hashes[send], (other[send] % np.uint64(buckets)).astype(np.int64), False)

    return work


def repeated_windows(rows: DataFrame, window: int, groups: int, text: str = "text") -> DataFrame:
    """First words of all windows that start anywhere else too, by group of documents."""
    block = block_words(window)
    probes = rows.mapInArrow(_probes(window, groups, text), P.PACKED)

    def anchored(runs: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = np.bincount(runs)
        return (n > 1) & (np.bincount(runs, weights=at % block == 0) > 0)

    hits = P.meet(probes, 4, anchored, groups)
    near = P.with_hits(rows, hits, _windows(window, groups, text), P.PACKED, text, all_rows=False)
    return P.meet(near, 8, lambda runs, at: np.bincount(runs) > 1, groups)


def _cut(window: int, text: str, columns: list[str], layout: bool):
    def work(batch: pa.RecordBatch, found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        words = Words(batch.column(text))
        spans, kept = [], []
        raw = words.data.tobytes()
        for r, hits in enumerate(found):
            at = np.unique(hits[:, 0])
            lo, n = int(words.first_of[r]), int(words.count[r])
            piece = raw[words.bounds[r]: words.bounds[r + 1]]
            if not len(at):
                spans.append([])
                kept.append(piece if layout else b" ".join(piece.split()))
                continue
            gone = covered(at, np.full(len(at), window), n)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
            if layout:
                at_byte = np.append(words.start[lo: lo + n] - int(words.bounds[r]), len(piece))
                cuts = [0, *at_byte[edges].tolist(), len(piece)]
                kept.append(b"".join(piece[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
            else:
                kept.append(b" ".join([w for w, g in zip(piece.split(), gone.tolist(), strict=True) if not g]))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in columns), pa.array(words.count, pa.int64()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
             pa.array(kept, pa.binary()).cast(pa.string())],
            names=[*columns, *OUTPUTS])

    return work


def remove_repeats(
    docs: DataFrame, window: int = 35, text: str = "text", id_column: str = "doc_id", keep_layout: bool = False
) -> DataFrame:
    """The documents with word count, removed word spans and what is left of the text.

    ``kept_text`` is the kept words joined by one space, or with ``keep_layout``
    the text with the removed stretches cut out.
    """
    groups = bucket_count(docs, text)
    rows = P.keyed(docs, id_column, text, groups)
    columns = [c for c in docs.columns if c not in OUTPUTS]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns])
    schema += ", n_words long, removed_spans array<struct<start:int,end:int>>, kept_text string"
    marks = repeated_windows(rows, window, groups, text)
    return P.with_hits(rows, marks, _cut(window, text, columns, keep_layout), schema, text, all_rows=True)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir, "doc_id", "text"))
    gone = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLES: dict[str, str] = {}
