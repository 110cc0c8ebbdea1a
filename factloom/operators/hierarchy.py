"""Ordered ancestor chains for every class and module at once.

A chain is an in-order walk: prepends (latest first, each expanded), the type
itself, includes (latest first, each expanded), then the superclass chain. Two
tables are built and joined instead of walking once per root:

* ``supers``: every (type, distance, superclass), by pointer doubling, so a
  chain a thousand links deep takes ten rounds;
* ``blocks``: what the mixins of one type expand to, once per type, with a sort
  key. Only nested mixins add rounds.

A chain is then ``supers JOIN blocks``, ordered by key, first occurrence kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import names as N
from factloom.operators.resolve import TypeIndex, resolve_nested, resolve_types
from factloom.session import durable, spread_by

# The ancestors every class ends in, and what a class object and a
# module object answer through.
ROOT_SUPERCLASSES = ("Object", "::Object")
OBJECT_TAIL = (("Object", "class"), ("Kernel", "module"), ("BasicObject", "class"))
CLASS_OBJECT_TAIL = (
    ("Object", "class", "singleton_of"),
    ("BasicObject", "class", "singleton_of"),
    ("Class", "class", "class_object"),
    ("Module", "class", "class_object"),
    ("Object", "class", "class_object"),
    ("Kernel", "module", "class_object"),
    ("BasicObject", "class", "class_object"),
)
MODULE_OBJECT_TAIL = (
    ("Module", "class", "class_object"),
    ("Object", "class", "class_object"),
    ("Kernel", "module", "class_object"),
    ("BasicObject", "class", "class_object"),
)
CONCERN_MARKER = "ActiveSupport::Concern"
INSTANCE_SIDE_ORIGINS = ("extend", "class_object")
SYNTHESISED_ORIGINS = ("default", "class_object", "singleton_of")

_AFTER_ALL = 2_000_000_000  # slot of whatever follows the last superclass


def declaration_side(origin: Column, singleton: Column) -> Column:
    """Which kind of method a chain entry contributes."""
    return F.when(singleton & ~origin.isin(*INSTANCE_SIDE_ORIGINS), "singleton_method").otherwise("instance_method")


@dataclass(frozen=True)
class Hierarchy:
    """Resolved links, ready to be expanded."""

    types: DataFrame  # name, kind
    superclass: DataFrame  # node -> parent (identified only)
    ends: DataFrame  # node -> what follows it: 'object' or 'unidentified'
    mixins: DataFrame  # owner, slot, target (null when unidentified), origin
    extends: DataFrame  # the same for the singleton side
    class_methods: Callable[[], DataFrame]  # what reached concerns add to the singleton side, made when asked for


def latest_superclass(links: DataFrame) -> DataFrame:
    """The last superclass fact of an owner wins."""
    return (
        links.filter(F.col("relation") == "superclass")
        .groupBy("owner")
        .agg(F.max_by(F.struct("target", "resolved", "is_guessed"), F.struct("ordinal", "uri")).alias("t"))
        .select("owner", "t.*")
    )


def _slots(links: DataFrame) -> DataFrame:
    """Number the links of an owner so that ascending slot is walking order."""
    latest_first = Window.partitionBy("owner", "relation").orderBy(F.desc("ordinal"), F.desc("uri"))
    rank = F.row_number().over(latest_first)
    n = F.count(F.lit(1)).over(Window.partitionBy("owner", "relation"))
    return links.withColumn(
        "slot", F.when(F.col("relation") == "prepend", rank - n - 1).otherwise(rank).cast("int")
    )


def resolve_links(facts: DataFrame, index: TypeIndex) -> DataFrame:
    """Ancestor facts with their targets resolved, in one pass over the facts:
    ``resolved`` for the name as written, ``linked`` for the name as the
    enclosing frames see it, null where it is ambiguous."""
    nested = resolve_nested(facts, index, "target", "nesting").withColumn("_t", F.coalesce("nested", "target"))
    seen = resolve_types(nested, index, "_t").select(
        "uri", "ordinal", "owner", "relation", "target",
        F.when(~F.coalesce("is_ambiguous", F.lit(False)), F.coalesce("resolved", "_t")).alias("linked"),
    )
    return resolve_types(seen, index, "target").select(
        "uri", "ordinal", "owner", "relation", "target", "linked",
        F.coalesce("resolved", "target").alias("resolved"), F.coalesce("is_guessed", F.lit(False)).alias("is_guessed"),
    )


def build(facts: DataFrame, types: DataFrame, index: TypeIndex) -> Hierarchy:
    """``facts``: uri, ordinal, owner, relation, target, nesting(array)."""
    # Each of these is read in every round, so it is resolved once and kept.
    kinds = durable(types.groupBy("name").agg(F.min("kind").alias("kind")))
    links = durable(resolve_links(facts, index))

    how = (
        F.when(F.col("target").isNull() | F.col("is_guessed"), "unidentified")
        .when(F.col("target").isin(*ROOT_SUPERCLASSES), "object")
        .otherwise("parent")
    )
    sup = durable(latest_superclass(links).withColumn("how", how))
    superclass = sup.filter(F.col("how") == "parent").select(F.col("owner").alias("node"), F.col("resolved").alias("parent"))
    bare_classes = (
        kinds.filter(F.col("kind") == "class")
        .join(sup.select(F.col("owner").alias("name")), "name", "left_anti")
        .select(F.col("name").alias("node"), F.lit("object").alias("end"))
    )
    ends = sup.filter(F.col("how") != "parent").select(F.col("owner").alias("node"), F.col("how").alias("end"))
    ends = durable(ends.unionByName(bare_classes))

    mixed = links.filter(F.col("relation").isin("prepend", "include", "extend"))
    slotted = _slots(mixed).select("owner", "slot", F.col("linked").alias("target"), F.col("relation").alias("origin"))
    slotted = durable(slotted)

    def class_methods() -> DataFrame:
        return (
            concern_targets(links)
            .withColumn("target", F.concat("concern", F.lit("::ClassMethods")))
            .join(kinds.select(F.col("name").alias("target")), "target", "left_semi")
            .select("owner", (F.col("ord") + 1_000_000).cast("int").alias("slot"), "target", F.lit("extend").alias("origin"))
        )

    return Hierarchy(
        types=kinds,
        superclass=superclass,
        ends=ends,
        mixins=slotted.filter(F.col("origin") != "extend"),
        extends=slotted.filter(F.col("origin") == "extend"),
        class_methods=class_methods,
    )


def concern_targets(links: DataFrame) -> DataFrame:
    """Concerns each owner reaches through includes and prepends, in walking
    order: owner, concern, ord. ``links`` comes from :func:`resolve_links`."""
    rank = F.row_number().over(
        Window.partitionBy("owner").orderBy(F.when(F.col("relation") == "include", 0).otherwise(1), "ordinal", "uri")
    )
    mixed = links.filter(F.col("relation").isin("include", "prepend")).select(
        "owner", N.qualify_owner("resolved").alias("concern"), rank.alias("r")
    )
    concerns = (
        links.filter(
            (F.col("relation") == "concern_class_methods")
            | ((F.col("relation") == "extend") & N.bare_name("resolved").endswith(CONCERN_MARKER))
        )
        .select(F.col("owner").alias("concern")).distinct()
    )
    edges = durable(mixed.join(concerns, "concern", "left_semi"))

    best = edges.groupBy("owner", "concern").agg(F.min(F.array("r")).alias("key"))
    frontier = best.withColumn("path", F.array("owner", "concern"))
    hops = edges.select(F.col("owner").alias("concern"), F.col("concern").alias("next"), "r")
    while True:
        step = (
            frontier.join(hops, "concern")
            .filter(~F.array_contains("path", F.col("next")))
            .select(
                "owner", F.col("next").alias("concern"), F.concat("key", F.array("r")).alias("key"),
                F.concat("path", F.array("next")).alias("path"),
            )
            .groupBy("owner", "concern")
            .agg(F.min(F.struct("key", "path")).alias("m"))
            .select("owner", "concern", "m.key", "m.path")
        )
        better = (
            step.join(best.withColumnRenamed("key", "old"), ["owner", "concern"], "left")
            .filter(F.col("old").isNull() | (F.col("key") < F.col("old")))
            .drop("old")
        )
        frontier = durable(better)
        if frontier.isEmpty():
            break
        best = durable(
            best.unionByName(frontier.select("owner", "concern", "key"))
            .groupBy("owner", "concern").agg(F.min("key").alias("key"))
        )
    order = F.row_number().over(Window.partitionBy("owner").orderBy("key"))
    return best.select("owner", "concern", order.alias("ord"))


def superclass_closure(superclass: DataFrame) -> DataFrame:
    """Every (node, dist, anc) along superclass links, the node itself at 0.

    Distances double each round. A cycle is walked once: an ancestor met again
    is dropped, and a jump that only leads back is not followed further.
    """
    nodes = superclass.select("node").union(superclass.select("parent")).distinct()
    pairs = durable(
        nodes.select("node", F.lit(0).alias("dist"), F.col("node").alias("anc"))
        .unionByName(superclass.select("node", F.lit(1).alias("dist"), F.col("parent").alias("anc")))
        .groupBy("node", "anc").agg(F.min("dist").alias("dist"))
    )
    jumps = superclass.select("node", F.col("parent").alias("to"))
    reach = 1
    while True:
        hop = jumps.select(F.col("node").alias("n"), F.col("to").alias("m"))
        extended = hop.join(
            pairs.filter(F.col("dist") > 0).select(F.col("node").alias("m"), "dist", "anc"), "m"
        ).select(F.col("n").alias("node"), (F.col("dist") + reach).alias("dist"), "anc")
        pairs = durable(
            pairs.unionByName(extended, allowMissingColumns=False)
            .groupBy("node", "anc").agg(F.min("dist").alias("dist"))
        )
        reach *= 2
        # A chain reaches as far as it can once nobody is that far from its start.
        jumps = pairs.filter(F.col("dist") == reach).select("node", F.col("anc").alias("to"))
        if jumps.isEmpty():
            return pairs


def superclass_lines(superclass: DataFrame, starts: DataFrame) -> DataFrame:
    """The rows of :func:`superclass_closure` for the types in ``starts`` (column ``node``).

    Only jumps of 1, 2, 4, ... links are made for every type; lines are kept for the
    starts. A type met again on a cycle keeps its smaller distance.
    """
    jumps = superclass.select("node", F.col("parent").alias("to"))
    lines = durable(starts.select("node").filter("node IS NOT NULL").distinct().select("node", F.lit(0).alias("dist"), F.col("node").alias("anc")))
    reach = 1
    while True:
        hop = jumps.select(F.col("node").alias("anc"), "to")
        longer = lines.join(hop, "anc").select("node", (F.col("dist") + reach).alias("dist"), F.col("to").alias("anc"))
        lines = durable(lines.unionByName(longer).groupBy("node", "anc").agg(F.min("dist").alias("dist")).select("node", "dist", "anc"))
        if lines.filter(F.col("dist") >= reach).isEmpty():
            return lines
        reach *= 2
        jumps = durable(jumps.withColumnRenamed("to", "anc").join(hop, "anc").select("node", "to"))


def _chains_of(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """Superclass chain as an array, only for the given mixin targets."""
    wanted = closure.join(nodes, "node", "left_semi")
    return wanted.groupBy("node").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dist", "anc"))), lambda e: e["anc"]).alias("chain")
    )


def expand_blocks(h: Hierarchy, start: DataFrame, closure: DataFrame, instance_path: bool) -> DataFrame:
    """Expand the mixin links in ``start`` (owner, slot, target, origin).

    Output: owner, key, name (null when unidentified), origin, parent, where
    ``parent`` is the type whose expansion put an unidentified entry there.
    ``instance_path`` says whether the owner itself is already being walked on
    the instance side (it is not, for the singleton walk).
    """
    targets = (
        h.mixins.select(F.col("target").alias("node")).union(start.select(F.col("target").alias("node")))
        .filter("node IS NOT NULL").distinct()
    )
    chains = durable(_chains_of(targets, closure))
    inner = h.mixins.select(
        F.col("owner").alias("anc"), F.col("slot").alias("s2"), F.col("target").alias("t2"), F.col("origin").alias("o2")
    )
    path0 = F.array("owner") if instance_path else F.array().cast("array<string>")
    lead = F.array(F.col("slot"))
    first = durable(start)
    unnamed = first.filter("target IS NULL").select(
        "owner", lead.alias("key"), F.lit(None).cast("string").alias("name"), "origin",
        F.lit(None).cast("string").alias("parent"), F.array(F.lit(0)).alias("parent_key"),
    )
    frontier = first.filter("target IS NOT NULL").select(
        "owner", lead.alias("key"), F.col("target").alias("node"), "origin", path0.alias("path")
    )
    known: DataFrame | None = None
    extra: list[DataFrame] = [unnamed]
    ends = h.ends.withColumnRenamed("node", "anc")
    while True:
        chained = frontier.join(chains, "node", "left").withColumn(
            "chain", F.coalesce("chain", F.array("node"))
        )
        # The walk along superclasses stops at the first type already under way.
        cut = chained.withColumn(
            "cut",
            F.array_min(
                F.filter(
                    F.transform("chain", lambda c, i: F.when(F.array_contains(F.col("path"), c), i)),
                    lambda i: i.isNotNull(),
                )
            ),
        ).withColumn("walk", F.when(F.col("cut").isNull(), F.col("chain")).otherwise(F.slice("chain", 1, F.col("cut"))))
        steps = cut.select(
            "owner", "key", "origin", "path", "walk", "cut", "node", F.posexplode("walk").alias("i", "anc")
        )
        entries = steps.select(
            "owner",
            F.concat("key", F.array("i", F.lit(0))).alias("key"),
            F.col("anc").alias("name"),
            F.when(F.col("i") == 0, F.col("origin")).otherwise(F.lit("superclass")).alias("origin"),
            F.concat("path", F.slice("walk", 1, F.col("i") + 1)).alias("path"),
            ((F.col("i") == F.size("walk") - 1) & F.col("cut").isNull()).alias("last"),
            F.col("key").alias("base"), "i",
        )
        best_new = entries.groupBy("owner", "name").agg(
            F.min(F.struct("key", "origin", "path", "last", "base", "i")).alias("m")
        ).select("owner", "name", "m.*")
        if known is not None:
            prior = known.select("owner", "name", F.col("key").alias("old"))
            best_new = best_new.join(prior, ["owner", "name"], "left").filter(
                F.col("old").isNull() | (F.col("key") < F.col("old"))
            ).drop("old")
        improved = durable(best_new)
        if improved.isEmpty():
            break
        tagged = improved.select("owner", "name", "key", "origin")
        known = tagged if known is None else durable(
            known.unionByName(tagged).groupBy("owner", "name").agg(F.min(F.struct("key", "origin")).alias("m"))
            .select("owner", "name", "m.key", "m.origin")
        )
        branch = improved.select(
            "owner", F.col("name").alias("anc"), "base", "i", "path", "last"
        )
        occurrence = F.concat("base", F.array("i", F.lit(0))).alias("parent_key")
        after = branch.filter("last").join(ends, "anc").withColumn(
            "key", F.concat("base", F.array(F.col("i"), F.lit(_AFTER_ALL)))
        )
        extra.append(
            after.filter(F.col("end") == "unidentified").select(
                "owner", "key", F.lit(None).cast("string").alias("name"),
                F.lit("superclass").alias("origin"), F.col("anc").alias("parent"), occurrence,
            )
        )
        extra.append(_object_tail(after.filter(F.col("end") == "object"), "owner", "anc"))
        opened = branch.join(inner, "anc").withColumn("key", F.concat("base", F.array("i", "s2")))
        extra.append(
            opened.filter("t2 IS NULL").select(
                "owner", "key", F.lit(None).cast("string").alias("name"), F.col("o2").alias("origin"),
                F.col("anc").alias("parent"), occurrence,
            )
        )
        frontier = durable(
            opened.filter("t2 IS NOT NULL")
            .filter(~F.array_contains("path", F.col("t2")))
            .select("owner", "key", F.col("t2").alias("node"), F.col("o2").alias("origin"), "path")
        )
        if frontier.isEmpty():
            break
    out = extra[0]
    for df in extra[1:]:
        out = out.unionByName(df)
    if known is not None:
        out = out.unionByName(known.select(
            "owner", "key", "name", "origin",
            F.lit(None).cast("string").alias("parent"), F.lit(None).cast("array<int>").alias("parent_key"),
        ))
    return durable(out)


def _object_tail(rows: DataFrame, root: str, parent: str) -> DataFrame:
    tail = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(name).alias("name")) for i, (name, _) in enumerate(OBJECT_TAIL)])
    return rows.select(root, "key", F.col(parent).alias("parent"), F.explode(tail).alias("t")).select(
        root, F.concat("key", F.array("t.n")).alias("key"), F.col("t.name").alias("name"),
        F.lit("default").alias("origin"), "parent", F.col("key").alias("parent_key"),
    )


def _order_chain(rows: DataFrame, n_rows: int, singleton: bool) -> DataFrame:
    """Keep first occurrences and number them. One shuffle, by root."""
    spread = spread_by(rows, n_rows, "root")
    walked = Window.partitionBy("root", "walk_side", "name").orderBy("key")
    named = F.col("name").isNotNull()
    # A default tail entry is not part of the walk and never marks it visited.
    kept = spread.withColumn("n", F.when(named, F.row_number().over(walked)).otherwise(1)).filter("n = 1")
    once = kept.withColumn("decl_side", declaration_side(F.col("origin"), F.lit(singleton)))
    if singleton:
        # On the instance side all is one walk of one side, so names are distinct by now.
        by_side = Window.partitionBy("root", "decl_side", "name").orderBy("key")
        once = once.withColumn("d", F.when(named, F.row_number().over(by_side)).otherwise(1)).filter("d = 1")
    pos = F.row_number().over(Window.partitionBy("root").orderBy("key")) - 1
    return once.select(F.col("root").alias("owner"), pos.alias("pos"), "name", "origin", "decl_side", "kind")


def _first_unnamed(rows: DataFrame) -> DataFrame:
    """Unidentified entries are kept for the first occurrence of their parent only."""
    by_parent = Window.partitionBy("root", "walk_side", "parent").orderBy("parent_key")
    return rows.withColumn("u", F.dense_rank().over(by_parent)).filter("u = 1").drop("u")


def _with_kinds(entries: DataFrame, kinds: DataFrame) -> DataFrame:
    tails = {name: kind for name, kind in OBJECT_TAIL} | {n: k for n, k, _ in CLASS_OBJECT_TAIL}
    fixed = F.create_map(*[F.lit(x) for pair in tails.items() for x in pair])
    known = kinds.select(F.col("name").alias("_n"), F.col("kind").alias("_k"))
    joined = entries.join(known, F.col("name") == F.col("_n"), "left")
    kind = F.when(F.col("origin").isin(*SYNTHESISED_ORIGINS), F.try_element_at(fixed, F.col("name"))).otherwise(F.col("_k"))
    return joined.withColumn("kind", kind).drop("_n", "_k")


def linearize(h: Hierarchy, roots: DataFrame | None = None, singleton: bool = False, closure: DataFrame | None = None) -> DataFrame:
    """Ancestor chains: owner, pos, name (null when unidentified), kind, origin,
    decl_side. ``roots`` (column ``name``) limits the chains that are built."""
    if closure is None and roots is not None:
        targets = h.mixins.unionByName(h.extends) if singleton else h.mixins
        starts = roots.select(F.col("name").alias("node")).union(targets.select("target").distinct())
        if singleton:
            starts = starts.union(h.class_methods().select("target").distinct())
        closure = superclass_lines(h.superclass, starts)
    closure = closure if closure is not None else superclass_closure(h.superclass)
    wanted = (roots if roots is not None else h.types).select(F.col("name").alias("node")).distinct()
    # Types without superclass links still start a chain of their own. Every part of
    # the chain starts from these rows, so they are made once.
    lines = durable(
        wanted.join(closure, "node", "left")
        .select(
            F.col("node").alias("root"), F.coalesce("dist", F.lit(0)).alias("dist"), F.coalesce("anc", "node").alias("anc")
        )
    )
    start = h.extends.unionByName(h.class_methods()) if singleton else h.mixins
    if roots is not None:
        # Mixins are expanded for the types that some line passes.
        start = start.join(lines.select(F.col("anc").alias("owner")).distinct(), "owner", "left_semi").select(*start.columns)
    blocks = expand_blocks(h, start, closure, instance_path=not singleton)

    # What a chain has from one type of its line, whatever the chain: the type itself, its
    # mixins and, where it is the last of its line, what follows. So kinds are found once a
    # type, and one join makes the chains.
    none, no_key = F.lit(None).cast("string"), F.lit(None).cast("array<int>")
    passed = lines.select("anc") if roots is not None else wanted.union(h.superclass.select("node")).union(h.superclass.select("parent"))
    passed = passed.toDF("node").distinct()
    own = passed.select(
        F.col("node").alias("anc"), F.array(F.lit(0)).alias("key"), F.col("node").alias("name"), none.alias("origin"),
        none.alias("parent"), no_key.alias("parent_key"), F.lit("own").alias("walk_side"),
    )
    block_side = F.lit("mixin") if singleton else F.lit("own")
    mixed = blocks.select(
        F.col("owner").alias("anc"), "key", "name", "origin", F.coalesce("parent", "owner").alias("parent"), "parent_key",
        # A link of the chain type itself belongs to that type's own walk.
        F.when(F.col("name").isNull() & F.col("parent").isNull(), "own").otherwise(block_side).alias("walk_side"),
    )
    # What has an end has no superclass link, so it is the last of its line.
    after = h.ends.select(F.col("node").alias("anc"), "end", F.array(F.lit(_AFTER_ALL)).alias("key"))
    unnamed = after.filter(F.col("end") == "unidentified").select(
        "anc", "key", none.alias("name"), F.lit("superclass").alias("origin"),
        F.col("anc").alias("parent"), F.array(F.lit(0)).alias("parent_key"), F.lit("own").alias("walk_side"),
    )
    entries = own.unionByName(mixed).unionByName(unnamed)
    if not singleton:
        last = after.filter(F.col("end") == "object").withColumn("root", F.col("anc"))
        tail = _object_tail(last, "root", "anc").withColumnRenamed("root", "anc").withColumn("walk_side", F.lit("own"))
        entries = entries.unionByName(tail)
    entries = durable(_with_kinds(entries, h.types))
    sizes = entries.groupBy("anc").agg(F.count(F.lit(1)).alias("n"))
    n_rows = lines.groupBy("anc").agg(F.count(F.lit(1)).alias("m")).join(sizes, "anc").agg(F.sum(F.col("m") * F.col("n"))).first()[0] or 0

    def placed(some: DataFrame, dealt: DataFrame = lines) -> DataFrame:
        return dealt.join(some, "anc").select(
            "root", F.concat(F.array("dist"), "key").alias("key"), "name",
            F.coalesce("origin", F.when(F.col("dist") == 0, "self").otherwise("superclass")).alias("origin"),
            "parent", F.concat(F.array("dist"), "parent_key").alias("parent_key"), "walk_side", "kind",
        )

    # A type without a name is all its chain has, and unidentified.
    nameless = lines.filter("anc IS NULL").select(
        "root", F.array("dist", F.lit(0)).alias("key"), none.alias("name"), F.lit("self").alias("origin"), none.alias("parent"),
        no_key.alias("parent_key"), F.lit("own").alias("walk_side"), none.alias("kind"),
    )
    open_ends = durable(placed(entries.filter("name IS NULL")).unionByName(nameless))
    # A line makes several rows, so the join is dealt by these and not by the lines' bytes.
    rows = placed(entries.filter("name IS NOT NULL"), spread_by(lines, n_rows, "anc")).unionByName(_first_unnamed(open_ends)).drop("parent", "parent_key")
    # Written, so that the task of a type that most lines pass does not hold all its rows for the next shuffle.
    rows = durable(rows)
    if not singleton:
        return _order_chain(rows, n_rows, singleton)

    open_roots = open_ends.select("root").distinct()
    closed = (
        wanted.join(h.types.withColumnRenamed("name", "node"), "node")
        .withColumnRenamed("node", "root").join(open_roots, "root", "left_anti")
    )
    def tail_array(tail):
        return F.array(*[
            F.struct(F.lit(i).alias("n"), F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(origin).alias("origin"))
            for i, (name, kind, origin) in enumerate(tail)
        ])
    tails = closed.select(
        "root",
        F.explode(F.when(F.col("kind") == "class", tail_array(CLASS_OBJECT_TAIL)).otherwise(tail_array(MODULE_OBJECT_TAIL))).alias("t"),
    ).select(
        "root", F.array(F.lit(_AFTER_ALL), F.col("t.n")).alias("key"), F.col("t.name").alias("name"),
        F.col("t.origin").alias("origin"), F.concat(F.lit("tail"), F.col("t.n").cast("string")).alias("walk_side"), F.col("t.kind").alias("kind"),
    )
    n_rows += len(CLASS_OBJECT_TAIL) * wanted.count()
    return _order_chain(rows.unionByName(tails), n_rows, singleton)


def lookup_owners(chain: DataFrame) -> DataFrame:
    """Identified entries with the kind of method each contributes."""
    return chain.filter("name IS NOT NULL").select("owner", "pos", "name", "decl_side")


def unidentified_links(chain: DataFrame) -> DataFrame:
    """Whether a chain has an entry nobody could name."""
    return chain.groupBy("owner").agg(F.bool_or(F.col("name").isNull()).alias("has_unidentified"))
