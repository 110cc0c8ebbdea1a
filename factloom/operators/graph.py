"""Iterative jobs over dependency edges and nesting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import names as N
from factloom.functions import typeexpr as X
from factloom.session import durable

MAX_DEPTH = 12


def affected(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """symbol_id, distance: everything that depends on a changed symbol.

    Breadth first over reverse edges; a symbol enters the frontier once, so the
    work is bounded by the edges however the graph loops.
    """
    back = durable(edges.select(F.col("callee").alias("symbol_id"), "caller").distinct())
    reached = durable(changed.select("symbol_id").distinct().withColumn("distance", F.lit(0)))
    frontier = reached
    step = 0
    while True:
        step += 1
        ahead = frontier.join(back, "symbol_id").select(F.col("caller").alias("symbol_id")).distinct()
        frontier = durable(ahead.join(reached, "symbol_id", "left_anti").withColumn("distance", F.lit(step)))
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)
        if step % 4 == 0:
            reached = durable(reached)


def propagate_return_types(
    methods: DataFrame, edges: DataFrame, literals: DataFrame, max_depth: int = MAX_DEPTH
) -> DataFrame:
    """Return type of every method from what it returns and what it calls.

    ``methods``: symbol_id, n_sites; ``edges``: caller, callee; ``literals``:
    symbol_id, type. A call back into a method under way and a call at
    ``max_depth`` widen to Unknown; so does a callee nobody declares.

    State per method is the small set of facts it can see, each with the least
    number of calls to it, so paths are never listed. Recursion is a method's
    being reachable from itself: those methods are found first.
    """
    known = methods.select("symbol_id").distinct()
    links = durable(edges.select("caller", "callee").distinct())
    inside = durable(links.join(known.select(F.col("symbol_id").alias("callee")), "callee", "left_semi"))
    gone = links.join(known.select(F.col("symbol_id").alias("callee")), "callee", "left_anti")
    looping = _on_cycles(inside)

    # What one method sees without leaving itself: literals, missing callees and
    # the point where its own recursion is cut.
    back_edges = (
        inside.join(looping.select(F.col("symbol_id").alias("caller"), F.col("cycle").alias("c1")), "caller")
        .join(looping.select(F.col("symbol_id").alias("callee"), F.col("cycle").alias("c2")), "callee")
        .filter("c1 = c2")
    )
    seed = (
        literals.join(known, "symbol_id", "left_semi").select("symbol_id", "type", F.lit("").alias("flag"))
        .unionByName(gone.select(F.col("caller").alias("symbol_id"), F.lit(X.UNKNOWN).alias("type"), F.lit("partial").alias("flag")))
        .unionByName(back_edges.select(F.col("caller").alias("symbol_id"), F.lit(X.UNKNOWN).alias("type"), F.lit("recursive_widened").alias("flag")))
        .distinct()
    )
    seen = durable(seed.withColumn("hops", F.lit(0)))
    fresh = seen
    # Depth of the longest way down, capped: a way of max_depth calls is cut.
    # Calls inside a recursion are cut already and do not count.
    onward = durable(inside.join(back_edges.select("caller", "callee"), ["caller", "callee"], "left_anti"))
    alive = onward.select(F.col("caller").alias("symbol_id")).distinct()
    for hop in range(1, max_depth):
        lifted = (
            inside.join(fresh.select(F.col("symbol_id").alias("callee"), "type", "flag"), "callee")
            .select(F.col("caller").alias("symbol_id"), "type", "flag").distinct()
            .join(seen, ["symbol_id", "type", "flag"], "left_anti").withColumn("hops", F.lit(hop))
        )
        fresh = durable(lifted)
        alive = durable(
            onward.join(alive.select(F.col("symbol_id").alias("callee")), "callee", "left_semi")
            .select(F.col("caller").alias("symbol_id")).distinct()
        )
        if fresh.isEmpty() and alive.isEmpty():
            break
        seen = seen.unionByName(fresh)
    # Whoever can still make max_depth calls in a row runs into the limit.
    timed_out = alive.select(
        "symbol_id", F.lit(X.UNKNOWN).alias("type"), F.lit("timeout").alias("flag"), F.lit(max_depth).alias("hops")
    )
    facts = seen.unionByName(timed_out)
    types = X.union_agg(facts, ["symbol_id"], "type", "return_type")
    flags = facts.groupBy("symbol_id").agg(
        F.bool_or(F.col("flag") == "timeout").alias("t"), F.bool_or(F.col("flag") == "recursive_widened").alias("r"),
        F.bool_or(F.col("flag") != "").alias("bad"),
    )
    status = F.when(F.col("t"), "timeout").when(F.col("r"), "recursive_widened").otherwise("complete")
    low = F.coalesce("bad", F.lit(False)) | (F.col("n_sites") > 1)
    return (
        methods.join(types, "symbol_id", "left").join(flags, "symbol_id", "left")
        .select(
            "symbol_id", F.coalesce("return_type", F.lit(X.UNKNOWN)).alias("return_type"), status.alias("status"),
            F.when(low, "low").otherwise("high").alias("confidence"),
        )
    )


def _on_cycles(edges: DataFrame) -> DataFrame:
    """symbol_id, cycle: methods that can reach themselves, labelled by the
    strongly connected part they form."""
    # Peel off what has no callers or no callees; what stays is on or between
    # cycles. A long chain is not worth a round per link, hence the limit.
    core = edges.filter("caller <> callee")
    selfish = edges.filter("caller = callee").select(F.col("caller").alias("symbol_id"))
    left = core.count()
    for _ in range(MAX_DEPTH):
        callers = core.select(F.col("caller").alias("callee")).distinct()
        callees = core.select(F.col("callee").alias("caller")).distinct()
        core = durable(core.join(callers, "callee", "left_semi").join(callees, "caller", "left_semi"))
        before, left = left, core.count()
        if left == before:
            break
    parts: DataFrame | None = None
    remaining = core
    while not remaining.isEmpty():
        nodes = remaining.select(F.col("caller").alias("symbol_id")).union(remaining.select("callee")).distinct()
        ahead = _least_reaching(nodes, remaining, "caller", "callee")
        behind = _least_reaching(nodes, remaining, "callee", "caller")
        # A part is settled when its least member reaches and is reached.
        both = ahead.withColumnRenamed("least", "f").join(behind.withColumnRenamed("least", "b"), "symbol_id").filter("f = b")
        part = durable(both.select("symbol_id", F.col("f").alias("cycle")))
        parts = part if parts is None else parts.unionByName(part)
        done = part.select("symbol_id")
        remaining = durable(
            remaining.join(done.withColumnRenamed("symbol_id", "caller"), "caller", "left_anti")
            .join(done.withColumnRenamed("symbol_id", "callee"), "callee", "left_anti")
        )
    alone = selfish if parts is None else selfish.join(parts, "symbol_id", "left_anti")
    labelled = alone.select("symbol_id", F.col("symbol_id").alias("cycle"))
    if parts is None:
        return durable(labelled)
    sizes = parts.groupBy("cycle").count().filter("count > 1").select("cycle")
    real = parts.join(sizes, "cycle", "left_semi").unionByName(
        parts.join(sizes, "cycle", "left_anti").join(selfish, "symbol_id", "left_semi")
    )
    return durable(real.unionByName(labelled))


def _least_reaching(nodes: DataFrame, edges: DataFrame, src: str, dst: str) -> DataFrame:
    """The least symbol that can reach each node (the node itself included)."""
    label = durable(nodes.withColumn("least", F.col("symbol_id")))
    while True:
        moved = (
            edges.select(F.col(src).alias("symbol_id"), F.col(dst).alias("to")).join(label, "symbol_id")
            .groupBy(F.col("to").alias("symbol_id")).agg(F.min("least").alias("new"))
        )
        nxt = durable(
            label.join(moved, "symbol_id", "left")
            .select("symbol_id", F.least("least", F.coalesce("new", "least")).alias("least"), (F.col("new") < F.col("least")).alias("changed"))
        )
        stop = nxt.filter("changed").isEmpty()
        label = nxt.drop("changed")
        if stop:
            return label


# Outline codes of each kind.
OUTLINE_KINDS = {"module": 2, "class": 5, "instance_method": 6, "singleton_method": 6, "constant": 14}
OUTLINE_OTHER = 13


def outline(declarations: DataFrame) -> DataFrame:
    """uri, line, name, kind_code, depth, path: declarations nested by owner.

    Levels are joined one after another within their file, from the roots down.
    """
    codes = F.create_map(*[F.lit(x) for p in OUTLINE_KINDS.items() for x in p])
    rows = durable(
        declarations.select(
            "uri", "line", "owner", F.col("name").alias("full"), "kind",
            F.coalesce(F.try_element_at(codes, F.col("kind")), F.lit(OUTLINE_OTHER)).alias("kind_code"),
        )
    )
    level = rows.filter("owner IS NULL").select("uri", "line", "full", "kind", "kind_code", F.col("full").alias("path"))
    out = level.withColumn("depth", F.lit(0))
    depth = 0
    while True:
        # A reopened type lists its members once per opening; openings with the
        # same path collapse so that members are not multiplied.
        parents = (
            level.filter(F.col("kind").isin("class", "module"))
            .select("uri", F.col("full").alias("owner"), F.col("path").alias("parent")).distinct()
        )
        depth += 1
        level = durable(
            rows.join(parents, ["uri", "owner"])
            .select("uri", "line", "full", "kind", "kind_code", F.concat("parent", F.lit("/"), "full").alias("path"))
        )
        if level.isEmpty():
            break
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))
    return out.select("uri", "line", N.simple_name("full").alias("name"), "kind_code", "depth", "path")
