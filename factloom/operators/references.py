"""Resolve call sites to symbols, find references, plan renames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import names as N
from factloom.functions import typeexpr as X
from factloom.functions.skew import broadcast_if_small, pick_first
from factloom.operators.resolve import TypeIndex, resolve_types

_SYMBOL = ("sym_kind", "sym_owner", "sym_name", "confidence", "origin")
_PLACE = ("uri", "line", "col")


def model_symbols(members: DataFrame) -> DataFrame:
    """model, name, sym_kind: a column before an association of one name."""
    order = F.when(F.col("kind") == "active_record_column", 0).otherwise(1)
    return pick_first(members.withColumnRenamed("member", "name"), ["model", "name"], [order], ["kind"]).withColumnRenamed("kind", "sym_kind")


def route_names(routes: DataFrame) -> DataFrame:
    return routes.filter(F.length("name") > 0).select(F.col("name").alias("base")).distinct()


def resolve_references(
    candidates: DataFrame, index: TypeIndex, methods: DataFrame, members: DataFrame, routes: DataFrame
) -> DataFrame:
    """Adds sym_kind, sym_owner, sym_name, confidence, origin to every candidate
    that resolves; the others are dropped.

    ``methods``: the lookup answer per (receiver_type, name), one row each with
    ``conditional``. Method calls fall through: methods, model members, routes.
    """
    kind = F.col("kind")
    local = candidates.filter(kind == "local_variable").select(
        *_PLACE, "kind", F.lit("local_variable").alias("sym_kind"),
        F.concat_ws("#", "receiver_type", "scope_id").alias("sym_owner"), F.col("name").alias("sym_name"),
        F.lit("high").alias("confidence"), F.lit("source").alias("origin"),
    )
    variable = candidates.filter(kind.isin("ivar", "cvar")).select(
        *_PLACE, "kind", kind.alias("sym_kind"), F.col("receiver_type").alias("sym_owner"), F.col("name").alias("sym_name"),
        F.lit("high").alias("confidence"), F.lit("source").alias("origin"),
    )
    constant = resolve_types(candidates.filter(kind == "constant").withColumnRenamed("kind", "cand_kind"), index).filter(
        "resolved IS NOT NULL"
    ).select(
        *_PLACE, F.col("cand_kind").alias("kind"), F.col("kind").alias("sym_kind"), F.lit(None).cast("string").alias("sym_owner"),
        F.col("resolved").alias("sym_name"), F.lit("high").alias("confidence"), F.lit("source").alias("origin"),
    )
    call = resolve_calls(candidates.filter(kind == "method_call"), methods, members, routes).filter("sym_kind IS NOT NULL")
    call = call.select(*_PLACE, "kind", *_SYMBOL)
    return local.unionByName(variable).unionByName(constant).unionByName(call)


def resolve_calls(
    calls: DataFrame, methods: DataFrame, members: DataFrame, routes: DataFrame, carried: Sequence[str] = (),
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Every call with its symbol, null when nothing answers.

    The distinct (receiver_type, name) pairs are answered first, so that a
    method called everywhere is joined once and not once per call. Where calls say
    whether they are made on the class itself (``singleton``), that is part of the pair.
    Columns of ``methods`` named in ``carried`` come along. ``pairs``: the distinct
    pairs, where a caller has them.
    """
    keys = ["receiver_type", "name", *(c for c in ("singleton",) if c in calls.columns)]
    pairs = pairs.select(*keys) if pairs is not None else calls.select(*keys).distinct()
    source = methods.select(
        *keys, F.col("sym_kind").alias("k1"), F.col("sym_owner").alias("o1"), F.col("sym_name").alias("n1"), "conditional", *carried
    )
    # A type is taken apart once, not once for every name it is asked for.
    nominal = F.when(X.is_nominal("receiver_type"), N.bare_name("receiver_type"))
    types = pairs.select("receiver_type").distinct().select("receiver_type", nominal.alias("model"))
    model = types.join(model_symbols(members), "model").select("receiver_type", "name", F.col("sym_kind").alias("k2"))
    answered = pairs.join(source, keys, "left").join(model, ["receiver_type", "name"], "left")
    by_source = F.col("k1").isNotNull()
    answers = answered.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.coalesce("k1", "k2").alias("sym_kind"),
        F.when(by_source, F.col("o1")).when(F.col("k2").isNotNull(), F.col("receiver_type")).alias("sym_owner"),
        F.when(by_source, F.col("n1")).when(F.col("k2").isNotNull(), F.col("name")).alias("sym_name"),
        F.when(by_source & F.col("conditional"), "low").when(F.coalesce("k1", "k2").isNotNull(), "high").alias("confidence"),
        F.when(by_source, "source").when(F.col("k2").isNotNull(), "active_record").alias("origin"), *carried,
    ).filter("sym_kind IS NOT NULL")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    routed = calls.join(answers, reduce(Column.__and__, same), "left").drop(*[f"_{k}" for k in keys])
    return route_fallback(routed, routes)


def route_fallback(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Receiverless calls nothing else answered may name a route helper."""
    helpers = broadcast_if_small(route_names(routes))
    bare = F.when(F.col("sym_kind").isNull() & (F.col("receiver_form") == "none"), N.route_base_name("name"))
    j = calls.withColumn("_b", bare).join(helpers, F.col("_b") == F.col("base"), "left")
    hit = F.col("base").isNotNull()
    return j.withColumns({
        "sym_kind": F.when(hit, "route_helper").otherwise(F.col("sym_kind")),
        "sym_name": F.when(hit, F.col("base")).otherwise(F.col("sym_name")),
        "confidence": F.when(hit, "high").otherwise(F.col("confidence")),
        "origin": F.when(hit, "route_helper").otherwise(F.col("origin")),
    }).drop("_b", "base")


def find_references(references: DataFrame, symbols: DataFrame, minimum_confidence: str = "high") -> DataFrame:
    """References of the given symbols (sym_kind, sym_owner, sym_name)."""
    kept = references.filter(F.col("confidence") == "high") if minimum_confidence == "high" else references
    key = lambda d: F.struct(F.coalesce(d["sym_owner"], F.lit("")).alias("o"), d["sym_kind"].alias("k"), d["sym_name"].alias("n"))
    wanted = symbols.select(key(symbols).alias("_key")).distinct()
    return kept.withColumn("_key", key(kept)).join(wanted, "_key", "left_semi").drop("_key")


def route_helper_lookup(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Receiverless calls with the route they name."""
    named = calls.filter(F.col("receiver_form") == "none").withColumn("base", N.route_base_name("name"))
    return named.join(broadcast_if_small(route_names(routes)), "base", "left_semi")


def route_table(routes: DataFrame) -> DataFrame:
    """One row per helper: its parts from the first fact, its distinct targets
    with GET first and then in input order."""
    named = routes.filter(F.length("name") > 0)
    target = ["name", "controller", "action", "verb"]
    firsts = named.groupBy(*target).agg(F.min("ordinal").alias("ordinal"))
    ranked = F.array_sort(F.collect_list(F.struct(
        F.when(F.col("verb") == "GET", 0).otherwise(1).alias("rank"), "ordinal", "controller", "action", "verb"
    )))
    targets = firsts.groupBy("name").agg(
        F.transform(ranked, lambda t: F.struct(t["controller"].alias("controller"), t["action"].alias("action"), t["verb"].alias("verb"))).alias("targets")
    )
    parts = named.groupBy("name").agg(F.min_by("part", "ordinal").alias("part"))
    return parts.join(targets, "name").select(
        "name", F.concat("name", F.lit("_path")).alias("path_helper"), F.concat("name", F.lit("_url")).alias("url_helper"), "part", "targets"
    )


def route_helpers(facts: DataFrame) -> DataFrame:
    """One row per helper: name, path_helper, url_helper, required_parts, optional_parts,
    place and targets.

    ``facts`` (decoded routes): ordinal, name, verb, required_parts, optional_parts,
    controller, action, path, line. Parts and place are those of the first fact of a
    name, the place null unless it has a path and a line; the targets are distinct,
    GET first and then in input order.
    """
    placed = F.when((F.length("path") > 0) & F.col("line").isNotNull(), F.struct("path", "line"))
    empty = F.array().cast("array<string>")
    first = F.struct(F.coalesce("required_parts", empty).alias("required_parts"), F.coalesce("optional_parts", empty).alias("optional_parts"), placed.alias("place"))
    heads = facts.filter(F.length("name") > 0).groupBy("name").agg(F.min_by(first, "ordinal").alias("f"))
    tables = route_table(facts.withColumn("part", F.lit(None).cast("string"))).drop("part")
    return tables.join(heads, "name").select("name", "path_helper", "url_helper", "f.*", "targets")


def route_definitions(table: DataFrame, methods: DataFrame, sources: DataFrame) -> DataFrame:
    """name, uri, line: where a helper is defined and the actions it leads to.

    ``sources``: name, uri, line of the route itself."""
    actions = table.select("name", F.explode("targets").alias("t")).select(
        "name", N.controller_path_to_owner("t.controller").alias("owner"), F.col("t.action").alias("method")
    )
    found = actions.join(
        methods.filter(F.col("kind") == "instance_method").select("owner", F.col("name").alias("method"), "uri", "line"), ["owner", "method"]
    )
    return sources.select("name", "uri", "line").union(found.select("name", "uri", "line")).distinct()


def rename_plan(
    requests: DataFrame, declarations: DataFrame, references: DataFrame, type_names: DataFrame, method_symbols: DataFrame
) -> DataFrame:
    """request_id, status, warning, uri, line, col, new_text.

    Requests: request_id, kind, owner, name, new_name. A refused request is one
    row without a place; an accepted one has a row per distinct place among its
    declarations and its high-confidence references.
    """
    refused_kinds = ("route_helper", "active_record_column", "active_record_association")
    generated = declarations.filter(F.col("origin") == "generated").groupBy("kind", "owner", "name").agg(
        F.min(F.struct("uri", "line")).alias("_g")
    )
    own = lambda c: F.coalesce(c, F.lit(""))
    is_type = F.col("kind").isin("class", "module", "constant")
    is_method = F.col("kind").isin("instance_method", "singleton_method")
    full = F.when(is_type, F.concat(F.regexp_replace("name", r"[^:]+\z", ""), F.col("new_name")))
    taken_types = type_names.select(F.col("name").alias("_full")).distinct().withColumn("_type", F.lit(True))
    taken_methods = method_symbols.select(
        F.col("kind").alias("_k"), F.col("owner").alias("_o"), F.col("name").alias("_n")
    ).distinct().withColumn("_method", F.lit(True))
    g = generated.select(F.col("kind").alias("gk"), F.col("owner").alias("go"), F.col("name").alias("gn"), "_g")
    judged = (
        requests.withColumn("_f", full)
        .join(g, (F.col("kind") == F.col("gk")) & (own(F.col("owner")) == own(F.col("go"))) & (F.col("name") == F.col("gn")), "left")
        .join(taken_types, F.col("_f") == F.col("_full"), "left")
        .join(taken_methods, is_method & (F.col("kind") == F.col("_k")) & (F.col("owner") == F.col("_o")) & (F.col("new_name") == F.col("_n")), "left")
    )
    warning = (
        F.when(F.col("kind").isin(*refused_kinds), "generated by the framework")
        .when(~N.identifier_valid("kind", "new_name"), F.concat(F.lit("not a valid "), F.col("kind"), F.lit(" name")))
        .when(F.col("_g").isNotNull(), "declared by a macro")
        .when(F.col("_type"), F.concat(F.lit("type exists: "), F.col("_f")))
        .when(F.col("_method"), F.concat(F.lit("already declared: "), F.col("owner"), F.lit("#"), F.col("new_name")))
    )
    planned = judged.select("request_id", "kind", "owner", "name", "new_name", warning.alias("warning"))
    refused = planned.filter("warning IS NOT NULL").select(
        "request_id", F.lit("refused").alias("status"), "warning", F.lit(None).cast("string").alias("uri"),
        F.lit(None).cast("bigint").alias("line"), F.lit(None).cast("bigint").alias("col"), F.lit(None).cast("string").alias("new_text"),
    )
    accepted = planned.filter("warning IS NULL").select("request_id", "kind", own(F.col("owner")).alias("_ow"), "name", "new_name")
    places = declarations.select("kind", own(F.col("owner")).alias("_ow"), "name", *_PLACE).unionByName(
        references.filter(F.col("confidence") == "high").select(
            F.col("sym_kind").alias("kind"), own(F.col("sym_owner")).alias("_ow"), F.col("sym_name").alias("name"), *_PLACE
        )
    ).distinct()
    edits = accepted.join(places, ["kind", "_ow", "name"]).select(
        "request_id", F.lit("planned").alias("status"), F.lit(None).cast("string").alias("warning"), *_PLACE, F.col("new_name").alias("new_text")
    )
    return refused.unionByName(edits)


def union_locations(declarations: DataFrame, references: DataFrame) -> DataFrame:
    """Distinct places among declarations and references."""
    return declarations.select(*_PLACE).union(references.select(*_PLACE)).distinct()


def symbol_fanout(declarations: DataFrame, key: Column) -> DataFrame:
    """key, n_sites, n_symbols: how much hangs on one lookup key."""
    per_symbol = declarations.groupBy(key.alias("key"), "kind", "owner", "name").agg(F.count(F.lit(1)).alias("n"))
    return per_symbol.groupBy("key").agg(F.sum("n").alias("n_sites"), F.count(F.lit(1)).alias("n_symbols"))
