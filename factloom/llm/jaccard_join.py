"""Operator 3: n-gram Jaccard join by a token-group matrix.

Documents become sets of word shingles; equal sets are one class. Links are found
in two steps. First, classes that share a min-hash are held against two leaders
of that min-hash, and what links forms groups of similar classes. Then every pair
of classes from different groups that could link is looked for: two sets that
link share a token among the rarest few of each (their prefix), so a shared
prefix token names a query class and a group. For such a group the token union of
its members is stored, block by block; the part of the query that the union
covers bounds any similarity in the block, and only a block whose bound reaches
the threshold is opened and compared set by set.

A group is connected already, so one link into it is enough, and no list of all
pairs inside a group of near copies is ever made. The order of tokens (rare ones
first) comes from counts in a table of fixed size over all documents; it decides
how much is compared, never what links.

Null texts and texts without words have an empty set, link with nothing and are
their own component. Rows of one id are documents of their own that carry the
same id. The component is the smallest id among its documents (null if all are).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.skew import broadcast_if_small
from factloom.llm import places as P
from factloom.llm.components import components
from factloom.llm.packed import Words, distinct_per_row, mix, pack, signed, slices, unpack
from factloom.llm.tables import bucket_count, documents
from factloom.session import durable

COUNTERS = 1 << 24
KEYS = 4  # min-hashes per class
BLOCK = 256  # members of a group that one task holds
_PARTS = 256  # pieces in which the counter table travels
_SLICE = 1 << 20  # bytes of text that are made into sets at a time
_STEPS = 200  # a token's place in its set is sent in so many steps


def _sets(batch: pa.RecordBatch, words: int, text: str) -> tuple[np.ndarray, np.ndarray]:
    return distinct_per_row(*Words(batch.column(text), fold_case=True).shingles(words))


def _token_counts(words: int, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.uint8)
        for batch in slices(batches, text, _SLICE):
            place, n = np.unique((_sets(batch, words, text)[1] % np.uint64(COUNTERS)).astype(np.int32), return_counts=True)
            seen[place] = np.minimum(255, seen[place] + n)
        for part in range(_PARTS):
            at = part * (COUNTERS // _PARTS)
            block = pack(seen[at: at + COUNTERS // _PARTS])
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.binary())], names=["part", "seen"])

    return run


def _added(table: pa.Table) -> pa.Table:
    total = np.zeros(COUNTERS // _PARTS, np.int64)
    for block in table.column("seen"):
        total += unpack(block.as_py())[0]
    rank = np.minimum(255, np.round(8 * np.log2(1 + total))).astype(np.uint8)
    return pa.table({"part": table.column("part").slice(0, 1), "seen": pa.array([pack(rank)], pa.binary())})


def token_order(docs: DataFrame, words: int, text: str) -> np.ndarray:
    """How frequent all documents' tokens are, on a log scale, in ``COUNTERS`` counters of one byte.

    A task counts a token up to 255 times; beyond, all it sees of it is very frequent.
    """
    rows = docs.mapInArrow(_token_counts(words, text), "part int, seen binary").groupBy("part").applyInArrow(_added, "part int, seen binary").collect()
    found = [unpack(r.seen)[0] for r in sorted(rows)]
    return np.concatenate(found) if found else np.zeros(COUNTERS, np.uint8)


_SET_FIELDS = "_id long, _check long, n int, d1 long, d2 long, keys array<long>, prefix binary"


def _described(words: int, percent: int, text: str, order):
    """Per document: set size, two digests of the set, min-hashes, and its rarest tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = order.value
        for batch in slices(batches, text, _SLICE):
            row, token = _sets(batch, words, text)
            n = np.bincount(row, minlength=len(batch))
            ends = np.cumsum(n)
            some = n > 0

            def summed(values: np.ndarray, ends=ends, n=n) -> np.ndarray:
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
                return total[ends] - total[ends - n]

            keys = np.zeros((len(n), KEYS), np.int64)
            for k in range(KEYS):
                if some.any():
                    keys[some, k] = signed(np.minimum.reduceat(mix(token, 5 + k), (ends - n)[some]))
            by_rarity = np.lexsort((token, counts[(token % np.uint64(COUNTERS)).astype(np.int64)], row))
            rare = token[by_rarity]
            # A link keeps percent % of a set at least; one of the other places and one more must be shared.
            length = n - -(-percent * n // 100) + some
            prefix = [rare[e - m: e - m + p].tobytes() for e, m, p in zip(ends.tolist(), n.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_check"), pa.array(n, pa.int32()),
                 pa.array(signed(summed(mix(token, 1)))), pa.array(signed(summed(mix(token, 2)))),
                 pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), KEYS).cast(pa.list_(pa.int64())), pa.array(prefix, pa.binary())],
                names=["_id", "_check", "n", "d1", "d2", "keys", "prefix"])

    return run


def _token_sets(texts: pa.ChunkedArray, words: int) -> Iterator[np.ndarray]:
    """The set of each text, in order."""
    for batch in slices(iter(pa.table({"text": texts}).combine_chunks().to_batches()), limit=_SLICE):
        row, token = _sets(batch, words, "text")
        yield from np.split(token, np.cumsum(np.bincount(row, minlength=len(batch)))[:-1])


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def _links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = _shared(a, b)
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _edge_table(edges: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})


def _held_against_leader(words: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        lead = table.column("lead")[0].as_py()
        ids = table.column("cls").to_pylist()
        leader = next(_token_sets(table.column("text").slice(ids.index(lead), 1), words))
        sets = zip(ids, _token_sets(table.column("text"), words), strict=True)
        return _edge_table([(lead, cls) for cls, tokens in sets if cls != lead and _links(leader, tokens, percent)])

    return run


def _opened(words: int, percent: int):
    """One block of a group: members (query = false) and queries with their texts."""

    def run(table: pa.Table) -> pa.Table:
        group, ids = table.column("group")[0].as_py(), table.column("cls").to_pylist()
        asks = table.column("query").to_pylist()
        sets = list(_token_sets(table.column("text"), words))
        members = [s for s, q in zip(sets, asks, strict=True) if not q]
        union = np.unique(np.concatenate(members)) if members else np.zeros(0, np.uint64)
        found = []
        for cls, tokens, query in zip(ids, sets, asks, strict=True):
            if not query or 100 * _shared(tokens, union) < percent * len(tokens):
                continue
            if any(100 * min(len(m), len(tokens)) >= percent * max(len(m), len(tokens)) and _links(tokens, m, percent) for m in members):
                found.append((group, cls))
        return _edge_table(found)

    return run


def _prefix_rows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                cls, group, size, n = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cls", "group", "size", "n"))
                blocks = part.column("prefix").to_pylist()
                token = np.frombuffer(b"".join(blocks), np.uint64)
                row = np.repeat(np.arange(len(part)), [len(b) // 8 for b in blocks])
                ends = np.cumsum([len(b) // 8 for b in blocks])
                place = np.arange(len(row)) - (ends - np.diff(ends, prepend=0))[row]
                step = (_STEPS * place // n[row]).astype(np.uint8)
                bucket = (mix(token, 9) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, row, token, step = bucket[order], row[order], token[order], step[order]
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                out = []
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
                    if hi > lo:
                        rows, counts = np.unique(row[lo:hi], return_counts=True)
                        out.append((int(bucket[lo]), pack(cls[rows], group[rows], size[rows], n[rows], counts, step[lo:hi]), token[lo:hi].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())],
                    names=["bucket", "classes", "tokens"])

    return run


def _queries(percent: int, alone: bool):
    """Query classes and the groups of others that share one of their prefix tokens.

    Per token the members of a group count as one, by the range of their sizes and the
    most that any of them has left; so a token of one large group costs a row for each
    outsider. The member of the smaller group asks. Two groups of one member meet only
    if ``alone``.
    """

    def run(table: pa.Table) -> pa.Table:
        tokens, fields = [], []
        for classes, block in zip(table.column("classes").to_pylist(), table.column("tokens").to_pylist(), strict=True):
            *columns, counts, step = unpack(classes)
            fields.append([*(np.repeat(c.view(np.int64), counts.view(np.int64)) for c in columns), step])
            tokens.append(np.frombuffer(block, np.uint64))
        token = np.concatenate(tokens)
        cls, group, size, n, step = (np.concatenate(c) for c in zip(*fields, strict=True))
        # All that a pair shares lies from its first shared token on, in both sets.
        left = n - -(-step.astype(np.int64) * n // _STEPS)
        order = np.lexsort((cls, group, token))
        token, cls, group, size, n, left = (x[order] for x in (token, cls, group, size, n, left))
        head = np.ones(len(token), bool)
        head[1:] = (token[1:] != token[:-1]) | (group[1:] != group[:-1])
        at = np.flatnonzero(head)
        if not len(at):
            return pa.table({"cls": pa.array([], pa.int64()), "group": pa.array([], pa.int64())})
        least, most, rest = np.minimum.reduceat(n, at), np.maximum.reduceat(n, at), np.maximum.reduceat(left, at)
        groups, sizes = group[at], size[at]
        wanted = [np.zeros((0, 2), np.int64)]
        edges = np.flatnonzero(np.diff(token)) + 1
        bounds = np.concatenate([[0], edges, [len(token)]])
        firsts = np.searchsorted(at, bounds)
        for lo, hi, low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
            if high - low < 2:
                continue
            for g in range(low, high):
                if sizes[g] < 2 and not alone:
                    continue
                asks = (size[lo:hi] < sizes[g]) | ((size[lo:hi] == sizes[g]) & (group[lo:hi] < groups[g]))
                near = (100 * most[g] >= percent * n[lo:hi]) & (percent * least[g] <= 100 * n[lo:hi])
                enough = (100 + percent) * np.minimum(left[lo:hi], rest[g]) >= percent * (n[lo:hi] + least[g])
                found = cls[lo:hi][asks & near & enough]
                if len(found):
                    wanted.append(np.stack([found, np.full(len(found), groups[g])], axis=1))
            if len(wanted) > 10_000:
                wanted = [np.unique(np.concatenate(wanted), axis=0)]
        pairs = np.unique(np.concatenate(wanted), axis=0)
        return pa.table({"cls": pairs[:, 0], "group": pairs[:, 1]})

    return run


def linked(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The documents' keys (_id, _check) with ``n_shingles``, ``component_id`` and _class, the component's number (null: empty set)."""
    spark = docs.sparkSession
    rows = P.keyed(docs.select(id_column, text), id_column, text).select(F.col(text).alias("text"), "_id", "_check")
    order = spark.sparkContext.broadcast(token_order(rows.select("text"), words, "text"))  # COUNTERS numbers
    sets = durable(rows.mapInArrow(_described(words, percent, "text", order), _SET_FIELDS))
    same_set = ["n", "d1", "d2"]
    first = F.struct("_id", "_check")
    own_id = F.when(F.col("_check") >= 0, F.col("_id"))
    classes = sets.filter("n > 0").groupBy(*same_set).agg(
        F.min(first).alias("rep"), F.min_by(F.struct("keys", "prefix"), first).alias("of"), F.min(own_id).alias("low"))
    # Numbered once, in the written table.
    classes = durable(classes.select(
        *same_set, "rep._id", "rep._check", "of.keys", "of.prefix", "low", F.monotonically_increasing_id().alias("cls")))

    def with_texts(asked: DataFrame) -> DataFrame:
        """Add the text of each row's class. The keys asked for are broadcast if their table is small."""
        keys = durable(asked.join(classes.select("_id", "_check", "cls"), "cls"))
        return rows.join(broadcast_if_small(keys), ["_id", "_check"])

    # Near sets agree in most min-hashes; candidates share two with a leader and are near in size.
    keys = classes.select("cls", "n", F.posexplode("keys").alias("k", "key"))
    leaders = keys.groupBy("k", "key").agg(F.min(F.struct("cls", "n")).alias("x"), F.max(F.struct("cls", "n")).alias("y")).filter("x.cls < y.cls")
    stars = keys.join(leaders, ["k", "key"]).select("cls", "n", F.explode(F.array("x", "y")).alias("lead")).filter("cls <> lead.cls")
    near = 100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n")
    stars = durable(stars.filter(near).groupBy("cls", F.col("lead.cls").alias("lead")).count().filter("count > 1").select("cls", "lead"))
    sizes = stars.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    part = F.pmod(F.hash("cls"), F.col("parts")).alias("part")
    dealt = stars.join(sizes, "lead").select("lead", "cls", part)
    dealt = dealt.union(dealt.select("lead", F.col("lead").alias("cls"), "part").distinct())
    edges = durable(with_texts(dealt).groupBy("lead", "part").applyInArrow(_held_against_leader(words, percent), "a long, b long"))

    # Classes that a leader has missed ask the groups first; only those that no group
    # takes are then held against each other.
    buckets = bucket_count(rows, "text")
    for alone in (False, True):
        grouped = components(edges)
        group_sizes = grouped.groupBy(F.col("component").alias("group")).agg(F.count("*").alias("size"))
        grouped = durable(grouped.select(F.col("node").alias("cls"), F.col("component").alias("group")).join(group_sizes, "group"))
        of_group = [F.coalesce("group", "cls").alias("group"), F.coalesce("size", F.lit(1)).alias("size")]
        classes_in = classes.select("cls", "n", "prefix").join(grouped, "cls", "left").select("cls", *of_group, "n", "prefix")
        asked = durable(
            classes_in.mapInArrow(_prefix_rows(buckets), "bucket int, classes binary, tokens binary")
            .groupBy("bucket").applyInArrow(_queries(percent, alone), "cls long, group long").distinct())
        block = F.pmod(F.hash("cls"), F.ceil(F.col("size") / BLOCK).cast("int")).alias("block")
        members = classes.select("cls").join(grouped, "cls", "left").select("cls", *of_group).join(asked.select("group").distinct(), "group")
        blocks = members.select("group", block).distinct()
        matrix = members.select("group", "cls", block, F.lit(False).alias("query")).union(
            asked.join(blocks, "group").select("group", "cls", "block", F.lit(True)))
        across = durable(with_texts(matrix).groupBy("group", "block").applyInArrow(_opened(words, percent), "a long, b long"))
        edges = edges.union(across)
    # A group is named by one of its members.
    everything = components(edges)
    named = classes.join(everything.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    found = named.select(*same_set, "component").join(lowest, "component").select(*same_set, "component_id", F.col("component").alias("_class"))
    out = sets.select("_id", "_check", *same_set).join(found, same_set, "left")
    component_id = F.when(F.col("n") > 0, F.col("component_id")).otherwise(own_id)
    return out.select("_id", "_check", F.col("n").cast("long").alias("n_shingles"), component_id.alias("component_id"), "_class")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The documents without near copies: of each component the one with the smallest id stays.

    Documents with an empty set stay. Rows equal in id and text are one document.
    """
    found = linked(docs, words, percent, text, id_column).select("_id", "_check", "_class")
    first = found.filter("_class IS NOT NULL").groupBy("_class").agg(F.min(F.struct("_id", "_check")).alias("rep")).select("rep.*")
    stay = first.union(found.filter("_class IS NULL").select("_id", "_check"))
    rows = P.keyed(docs, id_column, text).join(stay, ["_id", "_check"], "left_semi").dropDuplicates(["_id", "_check"])
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linked(documents(spark, sf_dir, "doc_id", "text"), words=4, percent=85)
    return found.select(F.when(F.col("_check") >= 0, F.col("_id")).alias("doc_id"), "n_shingles", "component_id")


QUERIES = {"op3_ngram_jaccard": op3_ngram_jaccard}
ORACLES: dict[str, str] = {}
