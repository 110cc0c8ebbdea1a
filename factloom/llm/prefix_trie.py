"""Operator 11: the prefix trie of conversations, as ternary search trees over range shards.

Turns (role, text) become dense ids of a dictionary that is built by their SHA-256;
texts themselves never move. Conversations, now lists of ids, are dealt to ranges of
(ids, conversation) by sampled splitters, so a group of copies is split as well. Each
shard builds a ternary search tree from its distinct lists, the median one first, and
one pass over its nodes from the last made to the first adds up members, leaves and
savings.

A node can reach into the next shard only if it is a prefix of the splitter between
them. Such boundary nodes have a name that every shard finds alone, (first splitter
with the prefix, depth), are merged by it, and get what lies below them from running
sums over splitters: boundary nodes are in preorder by (first splitter, depth), so a
subtree is the rest of its own splitter's path and all paths up to its last splitter.

Defined results: null role or text is empty. Turns are ordered by number, null first,
then by role and by SHA-256 where numbers tie; a row given twice is two turns. Rows
without a conversation id belong to no conversation and take no part. A conversation
without turns is a member of the root; an empty table has no nodes. One list of ids is
one record of a task: 12 bytes a turn, whatever the texts' lengths. Only the four
columns are read, other columns, whatever their names, are left aside.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.skew import broadcast_if_small
from factloom.session import durable

# A shard's share of turns, and rows sampled for each splitter.
SHARD_TURNS, SAMPLED = 200_000, 40
# Length of the pieces in which lists of members travel to be hashed.
PIECE = 16_000
GROUP, HEADS = 100, 6

Key = tuple[tuple[int, ...], int]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def turn_lists(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, ids, chars): the turns of every conversation in order, as dictionary ids and text lengths."""
    given = conversations.filter(F.col(_quoted(conv)).isNotNull()).select(
        F.col(_quoted(conv)).cast("long").alias("conv_id"), F.col(_quoted(turn)).alias("turn"),
        F.coalesce(F.col(_quoted(role)), F.lit("")).alias("role"), F.coalesce(F.col(_quoted(text)), F.lit("")).alias("text"))
    plain = given.select(
        "conv_id", "turn", "role", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest"),
        F.length("text").alias("chars"))
    dictionary = durable(plain.select("digest").distinct().withColumn("id", F.monotonically_increasing_id()))
    coded = plain.join(dictionary, "digest")
    listed = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "digest", "id", "chars"))).alias("turns"))
    return listed.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.chars").alias("chars"))


def with_shared_heads(lists: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """Every conversation c with its first crc32(c) % heads turns replaced by those of c - c % group."""
    share = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    base = lists.filter(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), *[F.slice(c, 1, heads - 1).alias(f"head_{c}") for c in ("ids", "chars")])
    dealt = lists.withColumn("h", share).withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(base, "base", "left")

    def joined(c: str) -> Column:
        head = F.slice(F.coalesce(f"head_{c}", F.slice(c, 1, 0)), F.lit(1), F.col("h"))
        return F.concat(head, F.slice(c, F.col("h") + 1, F.size(c))).alias(c)

    return dealt.select("conv_id", joined("ids"), joined("chars"))


def splitters_of(lists: DataFrame, shards: int, turns: int, rows: int) -> list[Key]:
    """Keys that part the lists into ranges of about equal numbers of turns, from a random sample."""
    if shards < 2:
        return []
    sampled = lists.sample(min(1.0, SAMPLED * shards / max(rows, 1)), 1).select("ids", "conv_id").collect()
    keys = sorted((tuple(r["ids"]), r["conv_id"]) for r in sampled)
    total = sum(len(ids) + 1 for ids, _ in keys)
    found, seen = [], 0
    for ids, conv in keys:
        seen += len(ids) + 1
        if seen * shards >= total * (len(found) + 1) and len(found) < shards - 1:
            found.append((ids, conv))
    return found


def _common(a: Sequence[int], b: Sequence[int]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def paths(splitters: list[Key]) -> tuple[list[list[int]], list[list[int]]]:
    """For every splitter and length of prefix: the first and the last splitter of the run that has the prefix."""
    shared = [_common(a[0], b[0]) for a, b in zip(splitters, splitters[1:])]
    first: list[list[int]] = []
    for k, (ids, _) in enumerate(splitters):
        kept = first[-1][:shared[k - 1] + 1] if k else []
        first.append(kept + [k] * (len(ids) + 1 - len(kept)))
    last: list[list[int]] = []
    for k in range(len(splitters) - 1, -1, -1):
        kept = last[-1][:shared[k] + 1] if last else []
        last.append(kept + [k] * (len(splitters[k][0]) + 1 - len(kept)))
    return first, last[::-1]


class TernaryTree:
    """Lists of ids by a tree of (label, lower, equal, higher); every node but the root is one prefix."""

    def __init__(self) -> None:
        self.label, self.lower, self.equal, self.higher = [-1], [-1], [-1], [-1]
        self.parent, self.depth, self.chars = [-1], [0], [0]

    def add(self, ids: Sequence[int], chars: Sequence[int]) -> int:
        """The node of the whole list."""
        label, lower, equal, higher = self.label, self.lower, self.equal, self.higher
        node = 0
        for depth, wanted in enumerate(ids):
            above, links, at = node, equal, equal[node]
            while at >= 0 and label[at] != wanted:
                above, links = at, lower if wanted < label[at] else higher
                at = links[at]
            if at < 0:
                at = links[above] = len(label)
                label.append(wanted)
                for new in (lower, equal, higher):
                    new.append(-1)
                self.parent.append(node)
                self.depth.append(depth + 1)
                self.chars.append(chars[depth])
            node = at
        return node

    def add_balanced(self, lists: list[tuple[Sequence[int], Sequence[int]]]) -> list[int]:
        """The nodes of sorted lists, of which the median goes in first and then those of both halves."""
        nodes, waiting = [0] * len(lists), [(0, len(lists))]
        while waiting:
            start, end = waiting.pop()
            if start < end:
                middle = (start + end) // 2
                nodes[middle] = self.add(*lists[middle])
                waiting += [(start, middle), (middle + 1, end)]
        return nodes

    def walk(self, ids: Sequence[int]) -> list[int]:
        """The nodes along a list, from the root as far as they exist."""
        found = [0]
        for wanted in ids:
            at = self.equal[found[-1]]
            while at >= 0 and self.label[at] != wanted:
                at = self.lower[at] if wanted < self.label[at] else self.higher[at]
            if at < 0:
                break
            found.append(at)
        return found


_NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends_sha256 string, first int, last int, parent_first int, chars int, shard int, ends array<string>")
_FIELDS = [f.split()[0] for f in _NODE.split(", ")]
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
_ARROW = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in _NODE.split(", ")])


def _pieces(convs: list[int]) -> list[str]:
    """The comma-joined ids in pieces; a later piece starts with its comma."""
    step = PIECE // 20
    parts = [",".join(map(str, convs[i:i + step])) for i in range(0, len(convs), step)]
    return parts[:1] + ["," + p for p in parts[1:]]


def shard_nodes(rows: pa.Table, splitters: list[Key], runs: tuple[list[list[int]], list[list[int]]]) -> pa.Table:
    """All nodes of one shard; those on the paths of its two splitters are left open, with sums of what is closed."""
    shard = rows.column("shard")[0].as_py()
    ids, chars, convs = (rows.column(c).to_pylist() for c in ("ids", "chars", "conv_id"))
    order = sorted(range(len(ids)), key=lambda i: (ids[i], convs[i]))
    lists, members_of = [], []
    for i in order:
        if not lists or lists[-1][0] != ids[i]:
            lists.append((ids[i], chars[i]))
            members_of.append([])
        members_of[-1].append(convs[i])
    tree = TernaryTree()
    ends = dict(zip(tree.add_balanced(lists), members_of, strict=True))

    open_: dict[int, tuple[int, int, int | None]] = {}
    for k in (shard - 1, shard):
        if 0 <= k < len(splitters):
            first, last = runs[0][k], runs[1][k]
            for d, node in enumerate(tree.walk(splitters[k][0])):
                open_[node] = (first[d], last[d], first[d - 1] if d else None)

    size = len(tree.label)
    members, least = [0] * size, [1 << 63] * size
    for node, found in ends.items():
        members[node], least[node] = len(found), found[0]
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for node in range(size - 1, -1, -1):  # a node is made after its parent
        if node not in open_:
            leaves[node] += not children[node]
            saved[node] += (members[node] - 1) * tree.chars[node]
        above = tree.parent[node]
        if above >= 0:
            members[above] += members[node]
            least[above] = min(least[above], least[node])
            children[above] += node not in open_
            leaves[above] += leaves[node]
            saved[above] += saved[node]

    columns: dict[str, list] = {f: [] for f in _FIELDS}
    for node in range(size):
        above, mark = tree.parent[node], open_.get(node)
        by_parent = open_.get(above)
        found = ends.get(node, [])
        row = {
            "conv_id": least[node], "depth": tree.depth[node], "n_convs": members[node], "n_children": children[node],
            "parent_conv_id": least[above] if above >= 0 and not by_parent else None,
            "n_leaves": leaves[node], "saved_tokens": saved[node],
            "ends_sha256": None if mark else hashlib.sha256(",".join(map(str, found)).encode()).hexdigest(),
            "first": mark[0] if mark else None, "last": mark[1] if mark else None,
            "parent_first": mark[2] if mark else by_parent[0] if by_parent else None,
            "chars": tree.chars[node] if mark else None, "shard": shard, "ends": _pieces(found) if mark else None,
        }
        for f in _FIELDS:
            columns[f].append(row[f])
    return pa.table(columns, _ARROW)


def _hashed_ends(open_: DataFrame) -> DataFrame:
    """(first, depth, ends_sha256): pieces of one node in order, hashed as they stream by."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"first": pa.array([key[0]], pa.int32()), "depth": pa.array([key[1]], pa.int64()),
                                               "ends_sha256": [state.hexdigest()]})

        for batch in batches:
            for first, depth, shard, place, piece in zip(*(batch.column(c).to_pylist() for c in ("first", "depth", "shard", "place", "piece")), strict=True):
                if (first, depth) != key:
                    if key:
                        yield out()
                    key, state = (first, depth), hashlib.sha256()
                elif place == 0:
                    state.update(b",")
                state.update(piece.encode())
        if key:
            yield out()

    pieces = open_.select("first", "depth", "shard", F.posexplode("ends").alias("place", "piece"))
    return pieces.repartition("first", "depth").sortWithinPartitions("first", "depth", "shard", "place").mapInArrow(
        run, "first int, depth long, ends_sha256 string")


def merged_boundaries(open_: DataFrame, splitters: int) -> DataFrame:
    """One finished row per boundary node; ``open_`` has one per shard that holds it."""
    once = durable(open_.groupBy("first", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.max("last").alias("last"), F.max("parent_first").alias("parent_first"),
        F.max("chars").alias("chars"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]))
    below = once.groupBy(F.col("parent_first").alias("first"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("more"))
    full = once.join(below, ["first", "depth"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own = full.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("save", (F.col("n_convs") - 1) * F.col("chars"))
    path = Window.partitionBy("first").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    own = durable(own.select("*", F.sum("leaf").over(path).alias("path_leaf"), F.sum("save").over(path).alias("path_save")))
    # One row per splitter, also for those that are nobody's first.
    upto = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    of_path = own.groupBy(F.col("first").alias("at")).agg(F.sum("leaf").alias("leaf"), F.sum("save").alias("save"))
    runs = durable(open_.sparkSession.range(splitters).select(F.col("id").cast("int").alias("at")).join(of_path, "at", "left").select(
        "at", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in ("leaf", "save")]))
    start = runs.select(F.col("at").alias("first"), F.col("leaf").alias("leaf_0"), F.col("save").alias("save_0"))
    end = runs.select(F.col("at").alias("last"), F.col("leaf").alias("leaf_1"), F.col("save").alias("save_1"))
    summed = own.join(broadcast_if_small(start), "first").join(broadcast_if_small(end), "last")
    total = summed.select(
        "first", "depth", "conv_id", "parent_first", "n_convs", "n_children",
        (F.col("n_leaves") + F.col("path_leaf") + F.col("leaf_1") - F.col("leaf_0")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("path_save") + F.col("save_1") - F.col("save_0")).alias("saved_tokens"))
    nothing = hashlib.sha256(b"").hexdigest()
    return total.join(_hashed_ends(open_), ["first", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing)))


NODE_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(lists: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per distinct prefix of ``lists`` (conv_id, ids, chars), the root included."""
    spark = lists.sparkSession
    lists = durable(lists)
    rows, turns = lists.agg(F.count("*"), F.coalesce(F.sum(F.size("ids") + 1), F.lit(0))).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns // shard_turns + 1)
    splitters = splitters_of(lists, shards, turns, rows)
    shipped = spark.sparkContext.broadcast((splitters, paths(splitters)))  # one list of ids per shard

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shipped.value[0]
        for batch in batches:
            found = [bisect.bisect_right(keys, (tuple(ids), conv)) for ids, conv in zip(
                batch.column("ids").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=[*batch.schema.names, "shard"])

    dealt = lists.mapInArrow(deal, "conv_id long, ids array<long>, chars array<int>, shard int")
    nodes = durable(dealt.groupBy("shard").applyInArrow(lambda t: shard_nodes(t, *shipped.value), _NODE))
    closed, open_ = nodes.filter("first IS NULL"), nodes.filter("first IS NOT NULL")
    inner = closed.filter("parent_first IS NULL").select(*NODE_COLUMNS)
    if not splitters:
        return inner
    merged = durable(merged_boundaries(open_, len(splitters)))
    above = broadcast_if_small(merged.select(F.col("first").alias("parent_first"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("found")))
    hanging = closed.filter("parent_first IS NOT NULL").drop("parent_conv_id").join(above, ["parent_first", "depth"])
    boundary = merged.join(above, ["parent_first", "depth"], "left")
    return inner.unionByName(hanging.withColumnRenamed("found", "parent_conv_id").select(*NODE_COLUMNS)).unionByName(
        boundary.withColumnRenamed("found", "parent_conv_id").select(*NODE_COLUMNS))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = turn_lists(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return prefix_trie(with_shared_heads(durable(lists)))


_ORACLE = """
WITH o AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(
    length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT conv_id, s, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda k, z: CASE WHEN k & 1 = 1 THEN xor(k >> 1, 3988292384) ELSE k >> 1 END))) % 6 AS h
  FROM o),
r AS (
  SELECT h.conv_id, list_concat(coalesce(b.s, [])[1:h.h], h.s[h.h + 1:]) AS s
  FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM r),
n AS (
  SELECT d, s[1:d] AS p, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = d), '')) AS ends_sha256
  FROM p GROUP BY 1, 2),
c AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
f AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d > 0 THEN (n_convs - 1) * length(n.p[n.d].t) ELSE 0 END AS saved
  FROM n LEFT JOIN c ON n.d = c.d AND n.p = c.p),
t AS (
  SELECT unnest(range(d + 1)) AS top, p, n_children, saved FROM f),
u AS (
  SELECT top, p[1:top] AS p, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM t GROUP BY 1, 2)
SELECT f.conv_id, f.d AS depth, above.conv_id AS parent_conv_id, f.n_convs, f.n_children, u.n_leaves, u.saved_tokens, f.ends_sha256
FROM f JOIN u ON u.top = f.d AND u.p = f.p LEFT JOIN n above ON above.d = f.d - 1 AND above.p = f.p[1:f.d - 1]
"""

QUERIES = {"op11_prefix_trie": op11_prefix_trie}
ORACLES = {"op11_prefix_trie": _ORACLE}
