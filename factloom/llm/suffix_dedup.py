"""Operator 2: remove byte strings that occur more than once (suffix-array dedup).

Shipping every suffix with 200 bytes of text would cost 200 times the input, so
suffixes are sorted from anchors: of the 16-byte strings that start in a window,
the one with the smallest hash (the leftmost of equal ones) is its anchor.
Consecutive windows share it and form a segment, about 280 bytes of text for 90
windows. Equal windows have equal anchors at equal distance, so only segments
whose suffixes start alike can hold equal windows.

1. Segments are range-partitioned by the leading bytes of the suffix at their
   anchor; splitters come from a sample. Inside a range, runs of equal anchors
   and of equal segments are found. An anchor met once is done; equal segments
   repeat as a whole and one of them stands for all.
2. The other segments bring their text, again range-partitioned, and their windows
   are sorted per anchor and distance by multikey quicksort: all groups of equal
   prefix take their next token (40 bytes, by fingerprint) at once, and windows
   alone in their group drop out. What is left repeats.

A leading string so common that it fills ranges by itself (it is several
splitters) is dealt over all buckets: its segments by their hash, its windows by
theirs, so equal ones meet across the borders of the ranges without one task
holding them all.

Matches do not cross rows. Null and empty texts have nothing to remove. Rows
equal in id and text are two occurrences. Columns named like an output are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import places as P
from factloom.llm.packed import SLICE_BYTES, byte_column, byte_hashes, covered, mix, pack, slices, unpack
from factloom.llm.tables import bucket_count, documents

LENGTH = 200
GRAM = 16
TOKEN = 40  # bytes compared at a time
RANGES = 1024  # splitters, at most
SAMPLE_PARTS = 64  # one part of the documents gives the splitters
OUTPUTS = ("n_bytes", "removed_spans", "kept")
_ROWS = "bucket int, kind int, docs binary, body binary, tail binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("body", pa.binary()), ("tail", pa.binary())])
SEGMENTS, WINDOWS, SETTLED = 0, 1, 2


class Segments(NamedTuple):
    """Per segment: row, first window (in the row), windows, distance to the anchor, keys."""

    row: np.ndarray
    first: np.ndarray
    count: np.ndarray
    ahead: np.ndarray
    lead: np.ndarray  # leading 8 bytes of the suffix at the anchor
    gram: np.ndarray
    whole: np.ndarray  # hash of all bytes of the windows


def segments(data: np.ndarray, bounds: np.ndarray, length: int) -> Segments:
    last = np.diff(bounds) - length  # last window of each row
    rows = np.flatnonzero(last >= 0)
    none = np.zeros(0, np.int64)
    if not len(rows):
        return Segments(none, none, none, none, *[none.astype(np.uint64)] * 3)
    hashes = byte_hashes(data)
    n = len(data) - GRAM + 1
    at = np.arange(n)
    gram = hashes.of(at, at + GRAM)
    # Smallest hash in reach of each window, the leftmost of equal ones.
    low = max(1, int(n).bit_length())
    key = ((gram >> np.uint64(low)) << np.uint64(low)) | at.astype(np.uint64)
    reach = length - GRAM + 1
    padded = np.full(-(-n // reach) * reach, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = key
    blocks = padded.reshape(-1, reach)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = _ranges(bounds[rows], last[rows] + 1)
    anchor = (np.minimum(behind[starts], ahead[starts + reach - 1]) & np.uint64((1 << low) - 1)).astype(np.int64)
    row = np.repeat(rows, last[rows] + 1)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(row) != 0)]))
    count = np.diff(np.append(new, len(starts)))
    first, anchor, row = starts[new], anchor[new], row[new]
    lead = np.ascontiguousarray(data[anchor[:, None] + np.arange(8)]).view(">u8").ravel().astype(np.uint64)
    return Segments(row, first - bounds[row], count, anchor - first, lead, gram[anchor], hashes.of(first, first + count - 1 + length, 1))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _signed_order(lead: np.ndarray) -> np.ndarray:
    """Leading bytes as signed numbers in the same order."""
    return (lead ^ np.uint64(1 << 63)).view(np.int64)


class Ranges:
    """Where segments go: by splitters of the leading bytes, finer by hash, common ones everywhere."""

    def __init__(self, splitters: list[int], buckets: int) -> None:
        splitters = np.array(splitters, np.int64)
        self.splitters, times = np.unique(splitters, return_counts=True)
        self.common = self.splitters[times > 1]
        self.buckets = buckets
        self._fine = max(1, buckets // (len(self.splitters) + 1))

    def is_common(self, lead: np.ndarray) -> np.ndarray:
        return np.isin(_signed_order(lead), self.common)

    def bucket(self, lead: np.ndarray, gram: np.ndarray) -> np.ndarray:
        coarse = np.searchsorted(self.splitters, _signed_order(lead), side="right")
        return (coarse * self._fine + (mix(gram, 2) % np.uint64(self._fine)).astype(np.int64)) % self.buckets


def _sampled_leads(length: int, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = segments(*byte_column(batch.column(text)), length)
            yield pa.RecordBatch.from_arrays([pa.array(_signed_order(found.lead))], names=["lead"])

    return run


def splitters(rows: DataFrame, length: int, text: str, ranges: int) -> list[int]:
    """Quantiles of the leading bytes in one part of the documents."""
    part = F.pmod(F.xxhash64("_id", "_check"), F.lit(SAMPLE_PARTS)) == 0
    leads = rows.filter(part).select(text).mapInArrow(_sampled_leads(length, text), "lead long")
    steps = F.array(*[F.lit((k + 1) / ranges) for k in range(ranges - 1)])
    return list(leads.agg(F.percentile_approx("lead", steps, F.lit(10 * ranges))).first()[0] or []) if ranges > 1 else []


def _grouped(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Bucket and the places of its entries, in order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for places in np.split(order, cuts):
        if len(places):
            yield int(bucket[places[0]]), places


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)


def _doc_block(ids: np.ndarray, checks: np.ndarray, row: np.ndarray) -> bytes:
    """Documents of entries whose rows ascend, with the entries of each."""
    heads = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
    return pack(ids[row[heads]], checks[row[heads]], np.diff(np.append(heads, len(row))))


def _list_segments(length: int, text: str, ranges: Ranges):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = segments(*byte_column(batch.column(text)), length)
            if not len(found.row):
                continue
            ids, checks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_id", "_check"))
            # Equal segments of this slice are settled here; one of them goes on for all.
            _, first, which, n = np.unique(found.whole, return_index=True, return_inverse=True, return_counts=True)
            again = (n > 1)[which]
            sent = np.zeros(len(again), bool)
            sent[first] = True
            common = ranges.is_common(found.lead)
            bucket = np.where(common, (mix(found.whole, 4) % np.uint64(ranges.buckets)).astype(np.int64), ranges.bucket(found.lead, found.gram))
            out = []
            for b, at in _grouped(np.where(again, bucket[0], -1)):
                if b >= 0:
                    out.append((b, SETTLED, _doc_block(ids, checks, found.row[at]), pack(*_shape(found, at)), b""))
            picked = np.flatnonzero(sent)
            for b, at in _grouped(bucket[picked]):
                at = picked[at]
                flags = common[at].astype(np.uint8) | (again[at].astype(np.uint8) << 1)
                out.append((b, SEGMENTS, _doc_block(ids, checks, found.row[at]), pack(*_shape(found, at), flags), found.gram[at].tobytes() + found.whole[at].tobytes()))
            yield _batch(out)

    return run


def _shape(found: Segments, at: np.ndarray) -> tuple[np.ndarray, ...]:
    return found.first[at].astype(np.uint32), found.count[at].astype(np.uint32), found.ahead[at].astype(np.uint32)


_FOUND = f"_same boolean, {P.HITS}"


def _found(ids: np.ndarray, checks: np.ndarray, doc: np.ndarray, groups: int, same: bool, *shape: np.ndarray) -> pa.Table:
    """(first window, windows, distance) of documents, as rows of ``_FOUND``."""
    hits = P.hit_rows(ids, checks, doc, groups, *shape)
    return hits.add_column(0, "_same", pa.array(np.full(len(hits), same)))


def _docs_of(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, checks, counts = unpack(block)
    return ids.view(np.int64), checks.view(np.int64), counts.astype(np.int64)


class _Entries:
    """Entries of several packed rows with their documents numbered through."""

    def __init__(self, rows: list[dict]) -> None:
        parts = [_docs_of(r["docs"]) for r in rows]
        self.ids, self.checks, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.doc = np.repeat(np.arange(len(self.ids)), counts)
        self.fields = [np.concatenate(x) for x in zip(*[unpack(r["body"]) for r in rows], strict=True)]


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys and the number of each entry's run in that order."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= np.diff(k[order].view(np.int64)) != 0
    return order, np.cumsum(new) - 1


def _compare_segments(groups: int):
    def run(table: pa.Table) -> pa.Table:
        return _same_segments(table.to_pylist(), groups)

    return run


def _same_segments(table: list[dict], groups: int) -> pa.Table:
    """Of one range: segments that repeat as a whole, and those whose windows must be looked at."""
    out = []
    settled = [r for r in table if r["kind"] == SETTLED]
    if settled:
        e = _Entries(settled)
        out.append(_found(e.ids, e.checks, e.doc, groups, True, *e.fields))
    rows = [r for r in table if r["kind"] == SEGMENTS]
    if rows:
        e = _Entries(rows)
        first, count, ahead, flags = e.fields
        keys = [np.frombuffer(r["tail"], np.uint64).reshape(2, -1) for r in rows]
        gram, whole = np.concatenate(keys, axis=1)
        order, run = _runs(gram, whole)
        size = np.bincount(run)
        head = np.concatenate([[0], np.cumsum(size)[:-1]])
        same = (size > 1) | (np.bincount(run, weights=(flags[order] >> 1) & 1) > 0)
        # Different segments of one anchor.
        anchor_of_run = np.cumsum(np.concatenate([[0], np.diff(gram[order][head].view(np.int64)) != 0]))
        variety = np.bincount(anchor_of_run)[anchor_of_run]
        look = (variety > 1) | ((flags[order][head] & 1) > 0)
        whole_again = order[same[run]]
        stand_in = order[head][look]
        out.append(_found(e.ids, e.checks, e.doc[whole_again], groups, True, first[whole_again], count[whole_again], ahead[whole_again]))
        out.append(_found(e.ids, e.checks, e.doc[stand_in], groups, False, first[stand_in], count[stand_in], ahead[stand_in]))
    return pa.concat_tables(out)


def _bring_texts(length: int, text: str, ranges: Ranges):
    """The windows to look at: as stretches of text by anchor, of common anchors as hashes."""

    def work(batch: pa.RecordBatch, each: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        row = np.repeat(np.arange(len(each)), [len(t) for t in each])
        if not len(row):
            return
        data, bounds = byte_column(batch.column(text))
        ids, checks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_id", "_check"))
        first, count, ahead = np.concatenate([t for t in each if len(t)]).T
        order = np.lexsort((first, row))
        row, first, count, ahead = row[order], first[order], count[order], ahead[order]
        start = bounds[row] + first
        anchor = start + ahead
        hashes = byte_hashes(data)
        gram = hashes.of(anchor, anchor + GRAM)
        lead = np.ascontiguousarray(data[anchor[:, None] + np.arange(8)]).view(">u8").ravel().astype(np.uint64)
        common = ranges.is_common(lead)
        out = []
        plain = np.flatnonzero(~common)
        for b, at in _grouped(ranges.bucket(lead[plain], gram[plain])):
            at = plain[at]
            body = pack(first[at].astype(np.uint32), count[at].astype(np.uint32), ahead[at].astype(np.uint32), gram[at])
            stretch = data[_ranges(start[at], count[at] - 1 + length)]
            out.append((b, SEGMENTS, _doc_block(ids, checks, row[at]), body, stretch.tobytes()))
        hot = np.flatnonzero(common)
        if len(hot):
            window = _ranges(start[hot], count[hot])
            of = np.repeat(hot, count[hot])
            key, other = hashes.of(window, window + length, 2), hashes.of(window, window + length, 3)
            for b, at in _grouped((other % np.uint64(ranges.buckets)).astype(np.int64)):
                r = row[of[at]]
                out.append((b, WINDOWS, _doc_block(ids, checks, r), pack((window[at] - bounds[r]).astype(np.uint32)), key[at].tobytes()))
        yield _batch(out)

    return work


def multikey(group: np.ndarray, token, levels: int) -> np.ndarray:
    """Entries that share their group and all tokens with another: multikey quicksort.

    Every group of equal prefix is sorted by its next token, all groups at once;
    entries alone in their group are in their final place and drop out.
    """
    open_ = np.arange(len(group))
    for level in range(-1, levels):
        if not len(open_):
            break
        if level >= 0:
            order, run = _runs(group, token(open_, level))
        else:
            order, run = _runs(group)
        open_, group = open_[order], run
        shared = (np.bincount(run) > 1)[run]
        open_, group = open_[shared], group[shared]
    return open_


def _repeated(data: np.ndarray, count: np.ndarray, ahead: np.ndarray, gram: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (segment, number in it) of stretches of text that occur more than once among them."""
    size = count - 1 + length
    segment = np.repeat(np.arange(len(count)), count)
    nth = _ranges(np.zeros(len(count), np.int64), count)
    start = (np.cumsum(size) - size)[segment] + nth
    hashes = byte_hashes(data)
    _, anchor = np.unique(gram, return_inverse=True)
    group = anchor[segment].astype(np.int64) * (length + 1) + ahead[segment] - nth

    def token(at: np.ndarray, level: int) -> np.ndarray:
        begin = start[at] + level * TOKEN
        return hashes.of(begin, np.minimum(begin + TOKEN, start[at] + length))

    again = multikey(group, token, -(-length // TOKEN))
    return segment[again], nth[again]


def _compare_windows(length: int, groups: int):
    def run(table: pa.Table) -> pa.Table:
        rows, out = table.to_pylist(), []
        stretches = [r for r in rows if r["kind"] == SEGMENTS]
        if stretches:
            e = _Entries(stretches)
            first, count, ahead, gram = e.fields
            first, count, ahead = first.astype(np.int64), count.astype(np.int64), ahead.astype(np.int64)
            data = np.frombuffer(b"".join(r["tail"] for r in stretches), np.uint8)
            size = count - 1 + length
            base = np.cumsum(size) - size
            # Anchors of a few megabytes of text at a time.
            share = (mix(gram, 6) % np.uint64(len(data) // SLICE_BYTES + 1)).astype(np.int64)
            for _, at in _grouped(share):
                again = _repeated(data[_ranges(base[at], size[at])], count[at], ahead[at], gram[at], length)
                segment = at[again[0]]
                out.append(_found(e.ids, e.checks, e.doc[segment], groups, True, *_joined(first[segment] + again[1])))
        single = [r for r in rows if r["kind"] == WINDOWS]
        if single:
            e = _Entries(single)
            key = np.concatenate([np.frombuffer(r["tail"], np.uint64) for r in single])
            order, of = _runs(key)
            again = order[(np.bincount(of) > 1)[of]]
            out.append(_found(e.ids, e.checks, e.doc[again], groups, True, *_joined(e.fields[0][again].astype(np.int64))))
        return pa.concat_tables(out)

    return run


def _joined(window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return window, np.ones(len(window), np.int64), np.zeros(len(window), np.int64)


def _cut(length: int, text: str, columns: list[str]):
    def work(batch: pa.RecordBatch, each: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        data, bounds = byte_column(batch.column(text))
        spans, kept = [], []
        for r, found in enumerate(each):
            piece = data[bounds[r]: bounds[r + 1]]
            if not len(found):
                spans.append([])
                kept.append(piece.tobytes())
                continue
            gone = covered(found[:, 0], found[:, 1] - 1 + length, len(piece))
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
            kept.append(piece[~gone].tobytes())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in columns), pa.array(np.diff(bounds)),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())],
            names=[*columns, *OUTPUTS])

    return work


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The documents with their size in bytes, removed byte spans and the bytes that are kept."""
    buckets = bucket_count(docs, text)
    rows = P.keyed(docs, id_column, text, buckets)
    ranges = Ranges(splitters(rows, length, text, min(buckets, RANGES)), buckets)
    found = (
        rows.mapInArrow(_list_segments(length, text, ranges), _ROWS)
        .groupBy("bucket").applyInArrow(_compare_segments(buckets), _FOUND))
    look = found.filter("NOT _same").drop("_same")
    brought = P.with_hits(rows, look, _bring_texts(length, text, ranges), _ROWS, text, all_rows=False)
    inside = brought.groupBy("bucket").applyInArrow(_compare_windows(length, buckets), _FOUND)
    marks = found.filter("_same").union(inside).drop("_same")
    columns = [c for c in docs.columns if c not in OUTPUTS]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns)
    schema += ", n_bytes long, removed_spans array<struct<start:int,end:int>>, kept binary"
    return P.with_hits(rows, marks, _cut(length, text, columns), schema, text, all_rows=True)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_bytes(documents(spark, sf_dir, "doc_id", "text"))
    gone = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed_spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
ORACLES: dict[str, str] = {}
