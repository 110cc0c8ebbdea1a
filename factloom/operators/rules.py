"""Diagnostics as anti-joins. Every rule yields uri, line, col, code, message,
severity, confidence; what is not known for certain is never reported."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import names as N
from factloom.functions import typeexpr as X
from factloom.functions.skew import broadcast_if_small
from factloom.operators.references import route_names
from factloom.operators.resolve import TypeIndex, resolve_types
from factloom.session import durable

FINDING = ("uri", "line", "col", "code", "message", "severity", "confidence")
_PLACE = ["uri", "line", "col"]
# What a lookup says of the arguments, and when it says so for certain.
COUNTED = ("n_sites", "n_required", "n_optional", "has_rest", "has_keywords", "origin")
SINGLE = "_n = 1 AND n_sites = 1 AND NOT has_rest AND origin <> 'class_object'"
# How much a mode reports, and the order rules report in.
MODES = {"safe": 0, "standard": 1, "strict": 2}
RULE_ORDER = (
    "syntax-error", "unknown-method", "unresolved-constant", "unknown-route-helper", "argument-count", "argument-type", "unassigned-ivar",
)
# What an argument may become, what everything is, what is no class.
COERCIONS = {"Integer": ("Float", "Complex", "Rational")}
UNIVERSAL = ("Object", "Kernel", "BasicObject")
NOT_A_CLASS = ("Boolean",)


def _finding(df: DataFrame, code: str, message, severity: str = "warning", confidence: str = "high") -> DataFrame:
    return df.select(
        *_PLACE, F.lit(code).alias("code"), message.alias("message"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence")
    )


def syntax_errors(errors: DataFrame) -> DataFrame:
    """``errors``: uri, line, col, message."""
    return _finding(errors, "syntax-error", F.col("message"), severity="error")


def certain_receivers(candidates: DataFrame, index: TypeIndex, signature_types: DataFrame) -> DataFrame:
    """Receivers a rule may trust. ``receiver_type`` becomes Unknown where the
    name was guessed, where it resolves to another type than a signature means
    by it, and where a rooted name is really answered elsewhere."""
    nominal = F.when(X.is_nominal("receiver_type"), F.col("receiver_type"))
    named = candidates.withColumn("_n", nominal).withColumn("_bare", N.bare_name("_n"))
    guesses = resolve_types(named.select("_n").filter("_n IS NOT NULL").distinct(), index, "_n").select(
        F.col("_n").alias("_g"), F.col("is_guessed").alias("_guessed")
    )
    named = named.join(guesses, F.col("_n") == F.col("_g"), "left")
    answers = resolve_types(named.select("_bare").filter("_bare IS NOT NULL").distinct(), index, "_bare").select(
        F.col("_bare").alias("_b"), N.bare_name("resolved").alias("_answer")
    )
    signed = signature_types.select(N.bare_name("name").alias("_s")).distinct()
    j = named.join(answers, F.col("_bare") == F.col("_b"), "left").join(signed, F.col("_bare") == F.col("_s"), "left")
    other = F.col("_answer").isNotNull() & (F.col("_answer") != F.col("_bare"))
    shadowed = other & ~F.col("_bare").contains("::") & F.col("_s").isNotNull()
    rooted = F.coalesce(F.col("receiver").startswith("::"), F.lit(False)) & other
    doubtful = F.coalesce(F.col("_guessed"), F.lit(False)) | F.coalesce(shadowed, F.lit(False)) | F.coalesce(rooted, F.lit(False))
    return j.withColumn("receiver_type", F.when(doubtful, F.lit(X.UNKNOWN)).otherwise(F.col("receiver_type"))).drop(
        "_n", "_g", "_bare", "_guessed", "_b", "_answer", "_s"
    )


def reportable_branches(receiver_type):
    """Classes of a receiver when every member but nil is one; else empty."""
    members = F.filter(X.union_members(receiver_type), lambda m: m != X.NIL)
    sound = ~F.exists(members, lambda m: ~X.is_nominal(m)) & (F.col(receiver_type) != X.NIL)
    return F.when(sound, members).otherwise(F.array().cast("array<string>"))


def unknown_methods(
    calls: DataFrame, closed: DataFrame, models: DataFrame, members: DataFrame, signature_hits: DataFrame
) -> DataFrame:
    """Calls no branch of the receiver can answer."""
    return unanswered(unknown_method_suspects(calls, closed, models, members, signature_hits), calls)


def unanswered(suspects: DataFrame, calls: DataFrame) -> DataFrame:
    """Findings at whose place no call resolves. The suspects are written first: Spark would
    else push the join into a union of them and go over the calls once for each part."""
    return durable(suspects).join(calls.filter("sym_kind IS NOT NULL").select(*_PLACE), _PLACE, "left_anti").select(*FINDING)


def unknown_method_suspects(
    calls: DataFrame, closed: DataFrame, models: DataFrame, members: DataFrame, signature_hits: DataFrame
) -> DataFrame:
    """What :func:`unknown_methods` reports, also where another call at the place resolves.

    ``calls``: all method calls with ``sym_kind`` (null when unresolved);
    ``closed``: receiver, closed; ``models``: model, partial; ``members``: model,
    member; ``signature_hits``: receiver, name a signature declares on the chain.
    """
    # Judged once per (receiver, name); the calls only pick up the verdict.
    pairs = calls.filter("sym_kind IS NULL").select("receiver_type", "name").distinct()
    # A type is taken apart once, not once for every name it is asked for.
    parts = calls.select("receiver_type").distinct().select("receiver_type", F.explode(reportable_branches("receiver_type")).alias("receiver"))
    branches = pairs.join(parts, "receiver_type")
    m = models.select(N.qualify_owner("model").alias("receiver"), (~F.col("partial")).alias("_model_closed"))
    own = members.select(N.qualify_owner("model").alias("receiver"), F.col("member").alias("name")).distinct().withColumn("_member", F.lit(True))
    sig = signature_hits.select("receiver", "name").distinct().withColumn("_sig", F.lit(True))
    judged = (
        branches.join(closed, "receiver", "left").join(m, "receiver", "left")
        .join(own, ["receiver", "name"], "left").join(sig, ["receiver", "name"], "left")
        .withColumn(
            "_absent",
            (F.coalesce("closed", F.lit(False)) | F.coalesce("_model_closed", F.lit(False)))
            & F.col("_member").isNull() & F.col("_sig").isNull(),
        )
    )
    verdict = judged.groupBy("receiver_type", "name").agg(
        F.bool_and("_absent").alias("absent"), F.count(F.lit(1)).alias("n"), F.min("receiver").alias("only")
    ).filter("absent").select(
        "receiver_type", "name", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("receiver_type")).alias("reported")
    )
    bad = calls.filter("sym_kind IS NULL").join(verdict, ["receiver_type", "name"])
    message = F.concat(F.col("reported"), F.lit(" has no method named `"), F.col("name"), F.lit("`"))
    return _finding(bad, "unknown-method", message)


def unresolved_constants(candidates: DataFrame, index: TypeIndex, signature_types: DataFrame) -> DataFrame:
    constants = candidates.filter(F.col("kind") == "constant").drop("kind")
    signed = signature_types.select(N.bare_name("name").alias("_s")).distinct()
    missing = resolve_types(constants, index).filter("resolved IS NULL").join(signed, N.bare_name("name") == F.col("_s"), "left_anti")
    message = F.concat(F.lit("cannot resolve constant `"), F.col("name"), F.lit("`"))
    return _finding(missing, "unresolved-constant", message, confidence="low")


def unknown_route_helpers(calls: DataFrame, routes: DataFrame, loaded: DataFrame) -> DataFrame:
    """``loaded``: one row, one boolean; routes nobody loaded report nothing."""
    return unanswered(unknown_route_suspects(calls, routes, loaded), calls)


def unknown_route_suspects(calls: DataFrame, routes: DataFrame, loaded: DataFrame) -> DataFrame:
    """What :func:`unknown_route_helpers` reports, also where another call at the place resolves."""
    named = calls.filter("sym_kind IS NULL AND receiver_form = 'none'").withColumn("base", N.route_base_name("name")).filter("base IS NOT NULL")
    bad = named.filter(loaded.scalar()).join(broadcast_if_small(route_names(routes)), "base", "left_anti")
    message = F.concat(F.lit("no route named `"), F.col("base"), F.lit("` (`"), F.col("name"), F.lit("` is unresolved)"))
    return _finding(bad, "unknown-route-helper", message)


def argument_counts(calls: DataFrame, found: DataFrame) -> DataFrame:
    """Calls whose number of arguments the only declaration cannot take.

    ``found``: lookup rows with n_sites, n_required, n_optional, has_rest,
    has_keywords."""
    single = found.groupBy("receiver", "name").agg(
        F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in COUNTED]
    ).filter(SINGLE)
    return miscounted(calls.join(
        single.withColumnRenamed("receiver", "receiver_type").drop("origin"), ["receiver_type", "name"]
    ))


def nearest_and_single(found: DataFrame) -> DataFrame:
    """What the calls of a (receiver, name) need to know, in one pass over the lookup: the
    nearest symbol (sym_kind, sym_owner, sym_name, rank) and, where it is the only
    declaration and its arguments can be counted, n_required, n_optional and has_keywords."""
    pair = found.groupBy("receiver", "name").agg(
        F.min_by(F.struct("sym_kind", "sym_owner", "sym_name", "rank"), "rank").alias("_near"),
        F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in COUNTED],
    )
    countable = ("n_required", "n_optional", "has_keywords")
    return pair.select("receiver", "name", "_near.*", *[F.when(F.expr(SINGLE), F.col(c)).alias(c) for c in countable])


def miscounted(sized: DataFrame) -> DataFrame:
    """Findings of calls that know what their only declaration takes (null: not known)."""
    sized = sized.filter("NOT splat")
    maximum = F.col("n_required") + F.col("n_optional")
    passed = F.col("n_positional") + F.when(F.col("keywords") & ~F.col("has_keywords"), 1).otherwise(0)
    bad = sized.withColumn("_max", maximum).withColumn("_passed", passed).filter(
        (F.col("_passed") < F.col("n_required")) | (F.col("_passed") > F.col("_max"))
    )
    span = F.when(F.col("n_required") == F.col("_max"), F.col("n_required").cast("string")).otherwise(
        F.concat(F.col("n_required").cast("string"), F.lit(".."), F.col("_max").cast("string"))
    )
    message = F.concat(
        F.lit("`"), F.col("name"), F.lit("` takes "), span, F.lit(" argument"), F.when(F.col("_max") == 1, "").otherwise("s"),
        F.lit(", but "), F.col("_passed").cast("string"), F.lit(" given"),
    )
    return _finding(bad, "argument-count", message)


def reachable_names(chain: DataFrame, signature_ancestors: DataFrame) -> DataFrame:
    """actual, target: every name an instance of ``actual`` also goes by.

    ``signature_ancestors``: name, ancestor."""
    own = chain.filter("name IS NOT NULL").select(N.bare_name("owner").alias("actual"), "name")
    workspace = own.select("actual", "name").union(own.select("actual", N.simple_name("name")))
    signed = own.withColumn("_q", N.bare_name("name")).join(
        signature_ancestors.select(N.bare_name("name").alias("_q"), "ancestor"), "_q"
    ).select("actual", "ancestor")
    direct = signature_ancestors.select(N.bare_name("name").alias("actual"), "ancestor")
    return workspace.union(signed).union(direct).select("actual", N.bare_name("name").alias("target")).distinct()


def incompatible(pairs: DataFrame, reachable: DataFrame) -> DataFrame:
    """The (actual, expected) pairs where one cannot stand for the other."""
    distinct = pairs.select("actual", "expected").distinct().withColumns({
        "_a": N.bare_name("actual"), "_t": N.bare_name("expected"),
    })
    coerced = F.lit(False)
    for source, targets in COERCIONS.items():
        coerced = coerced | ((F.col("_a") == source) & F.col("_t").isin(*targets))
    open_ = durable(distinct.filter(~F.col("_t").isin(*UNIVERSAL) & ~coerced & (F.col("_a") != F.col("_t")) & (N.simple_name("_a") != F.col("_t"))))
    # Few of the names that chains go by are ever expected; the others need not be made distinct.
    names = reachable.select(F.col("actual").alias("_a"), F.col("target").alias("_t")).join(open_.select("_t").distinct(), "_t", "left_semi")
    return open_.join(names, ["_a", "_t"], "left_anti").select("actual", "expected")


def expected_slots(required, optional, trailing, count):
    """Expected type per positional argument; null when too many are passed."""
    taken = count - F.size(required) - F.size(trailing)
    return F.when(taken < 0, F.slice(required, F.lit(1), F.greatest(count, F.lit(0)))).when(
        taken <= F.size(optional), F.concat(required, F.slice(optional, F.lit(1), F.greatest(taken, F.lit(0))), trailing)
    )


def argument_types(arguments: DataFrame, overloads: DataFrame, reachable: DataFrame) -> DataFrame:
    """Arguments of a class the only overload does not accept.

    ``arguments``: uri, line, col, receiver_type, name, arg_types(array, null
    where not inferred); ``overloads``: receiver, name, required, optional,
    trailing (arrays) of methods with one overload and no rest."""
    return mistyped(arguments.join(overloads.withColumnRenamed("receiver", "receiver_type"), ["receiver_type", "name"]), reachable)


def mistyped(arguments: DataFrame, reachable: DataFrame) -> DataFrame:
    """The same for arguments that have the columns of their overload already."""
    joined = arguments.filter(F.col("name").rlike(r"^[A-Za-z_]\w*[?!]?\z"))
    slots = expected_slots(F.col("required"), F.col("optional"), F.col("trailing"), F.size("arg_types"))
    pairs = durable(
        joined.withColumn("_s", slots).filter("_s IS NOT NULL")
        .select(*_PLACE, "name", F.posexplode(F.arrays_zip(F.col("arg_types").alias("actual"), F.col("_s").alias("expected"))).alias("position", "p"))
        .select(*_PLACE, "name", "position", "p.actual", "p.expected")
        .filter("actual IS NOT NULL AND expected IS NOT NULL AND actual <> expected")
    )
    # Each pair of types is judged once, not once for every argument.
    judged = pairs.select("actual", "expected").distinct().filter(
        X.is_nominal("expected") & X.is_nominal("actual") & N.simple_name("expected").rlike("^[A-Z]")
        & ~F.col("expected").isin(*NOT_A_CLASS) & ~F.col("actual").isin(*NOT_A_CLASS)
    )
    bad = pairs.join(broadcast_if_small(incompatible(judged, reachable)), ["actual", "expected"])
    message = F.concat(
        F.lit("`"), F.col("name"), F.lit("` expects "), F.col("expected"), F.lit(" here, but "), F.col("actual"), F.lit(" is given")
    )
    return _finding(bad, "argument-type", message)


def unassigned_ivars(reads: DataFrame, gates: DataFrame, local: DataFrame, tested: DataFrame, assigned: DataFrame) -> DataFrame:
    """Reads in views of variables nothing assigns.

    ``gates``: uri, computable; a view whose assigned set cannot be computed
    stays silent. ``local``, ``tested``, ``assigned``: uri, name."""
    known = local.select("uri", "name").union(tested.select("uri", "name")).union(assigned.select("uri", "name")).distinct()
    judged = reads.join(gates.filter("computable").select("uri"), "uri", "left_semi").join(known, ["uri", "name"], "left_anti")
    message = F.concat(F.lit("`"), F.col("name"), F.lit("` is never assigned before this is read"))
    return _finding(judged, "unassigned-ivar", message)


def combine(syntax: DataFrame, rules: list[DataFrame], mode: str = "safe") -> DataFrame:
    """All findings; a file with syntax errors reports only those, constants
    are reported from standard mode on."""
    if not rules:
        return syntax
    # Written first, or the join below would be pushed into the union and done for each rule.
    out = durable(reduce(DataFrame.unionByName, rules))
    kept = out if MODES[mode] >= MODES["standard"] else out.filter(F.col("code") != "unresolved-constant")
    return syntax.unionByName(kept.join(syntax.select("uri").distinct(), "uri", "left_anti"))


def within_budget(findings: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` findings of each file in rule order; the window is
    limited before the shuffle."""
    order = F.create_map(*[F.lit(x) for i, c in enumerate(RULE_ORDER) for x in (c, i)])
    rank = F.row_number().over(Window.partitionBy("uri").orderBy(order[F.col("code")], "line", "col", "message"))
    return findings.withColumn("rank", rank).filter(F.col("rank") <= budget)


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def compare_summaries(before: DataFrame, after: DataFrame) -> DataFrame:
    """code, n_before, n_after of two runs."""
    return before.withColumnRenamed("n", "n_before").join(after.withColumnRenamed("n", "n_after"), "code", "full_outer").select(
        "code", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after")
    )
