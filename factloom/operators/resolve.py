"""Type-name resolution.

A written name may match thousands of types that share its last segment. The
rule "exact, else namespace suffix, else first in order" only ever needs one
winner per lookup key, so candidates are reduced to one row per key before the
join and no name is ever paired with all of its namesakes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import names as N
from factloom.session import durable


def _winner() -> Column:
    # Text order of (name, kind, owner); types have no owner.
    return F.min(F.struct("name", "kind"))


@dataclass(frozen=True)
class TypeIndex:
    """Lookup tables over the declared types, one row per key each."""

    exact: DataFrame  # name -> kind
    by_suffix: DataFrame  # a::b tail -> first type ending in it
    by_simple: DataFrame  # last segment -> first type, number of types


def type_index(types: DataFrame, keep: bool = False) -> TypeIndex:
    """``types``: name (qualified), kind in class/module; duplicates allowed.
    ``keep`` writes the tables once, for callers that look up more than once."""
    distinct = types.filter(F.col("kind").isin("class", "module")).select("name", "kind").distinct()
    exact = distinct.groupBy("name").agg(F.min("kind").alias("kind"))
    suffix = (
        distinct.select("name", "kind", F.explode(N.namespace_suffixes("name")).alias("suffix"))
        .groupBy("suffix")
        .agg(_winner().alias("w"))
        .select("suffix", F.col("w.name").alias("name"), F.col("w.kind").alias("kind"))
    )
    # Names and symbols are counted from the distinct list, so a popular last
    # segment costs one partial row per task, not one shuffled row per type.
    per_name = distinct.groupBy("name").agg(
        F.count(F.lit(1)).alias("symbols"), F.min(F.struct("name", "kind")).alias("w")
    )
    simple = (
        per_name.groupBy(N.simple_name("name").alias("simple"))
        .agg(F.min("w").alias("w"), F.count(F.lit(1)).alias("n_names"), F.sum("symbols").alias("n_symbols"))
        .select(
            "simple", F.col("w.name").alias("name"), F.col("w.kind").alias("kind"), "n_names", "n_symbols"
        )
    )
    return TypeIndex(*[durable(t) if keep else t for t in (exact, suffix, simple)])


def resolve_types(written: DataFrame, index: TypeIndex, col: str = "name") -> DataFrame:
    """Resolve every written name.

    Adds ``resolved``, ``kind``, ``match_class`` (exact/suffix/first/null),
    ``is_ambiguous`` and ``is_guessed``. Names repeat heavily, so each distinct
    one is resolved once and joined back.
    """
    distinct = written.select(F.col(col).alias("_w")).filter("_w IS NOT NULL").distinct()
    has_namespace = N.bare_name("_w").contains("::")
    rooted = F.col("_w").startswith("::")
    exact = index.exact.select(N.bare_name("name").alias("_k"), F.col("name").alias("x_name"), F.col("kind").alias("x_kind"))
    suffix = index.by_suffix.select(F.col("suffix").alias("_s"), F.col("name").alias("s_name"), F.col("kind").alias("s_kind"))
    simple = index.by_simple.select(
        F.col("simple").alias("_m"), F.col("name").alias("m_name"), F.col("kind").alias("m_kind"), "n_names", "n_symbols"
    )
    joined = (
        distinct.join(exact, N.bare_name("_w") == F.col("_k"), "left")
        # A rooted or bare name never takes the suffix; its key stays null.
        .join(suffix, F.when(~rooted & has_namespace, F.col("_w")) == F.col("_s"), "left")
        .join(simple, N.simple_name("_w") == F.col("_m"), "left")
    )
    bare = ~rooted & ~has_namespace
    exact_hit = F.col("x_name").isNotNull()
    match_class = (
        F.when(exact_hit, "exact")
        .when(F.col("s_name").isNotNull(), "suffix")
        .when(bare & F.col("m_name").isNotNull(), "first")
    )
    answers = joined.select(
        "_w",
        F.coalesce("x_name", "s_name", F.when(bare, F.col("m_name"))).alias("resolved"),
        F.coalesce("x_kind", "s_kind", F.when(bare, F.col("m_kind"))).alias("kind"),
        match_class.alias("match_class"),
        (~has_namespace & (F.coalesce("n_names", F.lit(0)) > 1)).alias("is_ambiguous"),
        (
            ~exact_hit
            & (F.coalesce("n_symbols", F.lit(0)) > 0)
            & (has_namespace | (F.coalesce("n_symbols", F.lit(0)) > 1))
        ).alias("is_guessed"),
    )
    return written.join(answers, F.col(col) == F.col("_w"), "left").drop("_w")


def resolve_nested(written: DataFrame, index: TypeIndex, col: str = "name", nesting: str = "nesting") -> DataFrame:
    """Adds ``nested``: the type the innermost lexical frame makes of the name."""
    distinct = written.select(F.col(col).alias("_w"), F.col(nesting).alias("_n")).distinct()
    frames = (
        distinct.filter(~F.col("_w").startswith("::"))
        .select("_w", "_n", F.posexplode("_n").alias("pos", "frame"))
        .withColumn("_k", F.concat(N.bare_name("frame"), F.lit("::"), F.col("_w")))
    )
    exact = index.exact.select(N.bare_name("name").alias("_k"), F.col("name").alias("nested"))
    hits = (
        frames.join(exact, "_k")
        .groupBy("_w", "_n")
        .agg(F.min_by("nested", "pos").alias("nested"))
    )
    return written.join(
        hits, (F.col(col) == F.col("_w")) & (F.col(nesting) == F.col("_n")), "left"
    ).drop("_w", "_n")


def constant_receivers(candidates: DataFrame, index: TypeIndex) -> DataFrame:
    """``receiver_type`` of each call: the enclosing owner when there is no
    receiver, the exactly matching type of the innermost frame for a constant
    (else the name as written), and the given inferred type for an expression.
    """
    # Only constants meet the types; the other calls stay where they are.
    exact = index.exact.select(N.bare_name("name").alias("_k"), F.col("name").alias("_top"))
    is_constant = F.col("receiver_form").eqNullSafe("constant")
    written = candidates.filter(is_constant).select("receiver", "nesting").distinct()
    nested = resolve_nested(written, index, "receiver", "nesting")
    topped = nested.join(exact, F.when(~F.col("receiver").startswith("::"), F.col("receiver")) == F.col("_k"), "left")
    seen = topped.filter("nested IS NOT NULL OR _top IS NOT NULL").select(
        F.col("receiver").alias("_r"), F.col("nesting").alias("_f"), F.coalesce("nested", "_top").alias("_seen"))
    constants = candidates.filter(is_constant).join(seen, (F.col("receiver") == F.col("_r")) & F.col("nesting").eqNullSafe(F.col("_f")), "left")
    constants = constants.withColumn("receiver_type", F.coalesce("_seen", "receiver")).drop("_r", "_f", "_seen")
    rest = candidates.filter(~is_constant).withColumn(
        "receiver_type", F.when(F.col("receiver_form") == "none", F.col("owner")).otherwise(F.col("inferred_type")))
    return constants.unionByName(rest)
