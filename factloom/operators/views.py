"""Views, the actions that render them and the variables they may read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import names as N
from factloom.functions import typeexpr as X
from factloom.functions.skew import pick_first


def view_controllers(views: DataFrame, types: DataFrame) -> DataFrame:
    """view_uri, owner, action, view_key, controller_uri of every view whose
    controller class exists."""
    parts = views.select(
        "view_uri", N.controller_path_to_owner(N.view_dir("view_uri")).alias("owner"), N.view_action("view_uri").alias("action"),
        F.concat(N.view_dir("view_uri"), F.lit("/"), N.view_action("view_uri")).alias("view_key"),
    ).filter("owner IS NOT NULL")
    first = types.filter(F.col("kind").isin("class", "module")).groupBy(N.qualify_owner("name").alias("owner")).agg(F.min("uri").alias("controller_uri"))
    return parts.join(first, "owner")


def contributing_actions(views: DataFrame, chain: DataFrame, heads: DataFrame, renders: DataFrame) -> DataFrame:
    """view_uri, action: public methods of the controller chain that are the
    view's own action or statically render it.

    ``renders``: owner, name, target. The two ways to match are two equi-joins.
    """
    classes = chain.filter((F.col("kind") == "class") & F.col("origin").isin("self", "superclass")).select(
        F.col("owner").alias("root"), "pos", F.col("name").alias("owner")
    )
    declared = classes.join(heads.filter(F.col("kind") == "instance_method").select("owner", "name", "visibility"), "owner")
    nearest = pick_first(declared, ["root", "name"], [F.col("pos")], ["owner", "visibility"]).filter(F.col("visibility") == "public")
    own = views.join(nearest.select(F.col("root").alias("owner"), F.col("name").alias("action")), ["owner", "action"]).select("view_uri", "action")
    targets = nearest.join(renders, ["owner", "name"]).select(
        F.col("root").alias("owner"), "name", F.when(F.col("target").contains("/"), F.regexp_replace("target", "^/", "")).otherwise(F.col("target")).alias("target"),
        F.col("target").contains("/").alias("keyed"),
    )
    wanted = views.select("view_uri", "owner", F.col("view_key").alias("target"), F.lit(True).alias("keyed")).union(
        views.select("view_uri", "owner", F.col("action"), F.lit(False))
    )
    rendered = wanted.join(targets, ["owner", "target", "keyed"]).select("view_uri", F.col("name").alias("action"))
    return own.union(rendered).distinct()


def merge_environments(environments: DataFrame) -> DataFrame:
    """view_uri, ivar, type over the actions that may come before a view: types
    joined, ``nil`` added where some action leaves the variable unset.

    ``environments``: view_uri, action, ivar (null for an action that sets
    none), type."""
    actions = environments.select("view_uri", "action").distinct().groupBy("view_uri").agg(F.count(F.lit(1)).alias("n"))
    named = environments.filter("ivar IS NOT NULL")
    have = named.select("view_uri", "ivar", "action").distinct().groupBy("view_uri", "ivar").agg(F.count(F.lit(1)).alias("have"))
    types = X.union_agg(named, ["view_uri", "ivar"], "type", "type")
    return types.join(have, ["view_uri", "ivar"]).join(actions, "view_uri").select(
        "view_uri", "ivar", F.when(F.col("have") < F.col("n"), X.or_nil("type")).otherwise(F.col("type")).alias("type")
    )


def assigned_union(view: DataFrame, controllers: DataFrame, helpers: DataFrame) -> DataFrame:
    """uri, name: what the view's actions, its controller chain or any helper
    assigns. ``helpers``: name only; they serve every view, so they are kept
    apart as their own rows with a null uri."""
    local = view.select("uri", "name").union(controllers.select("uri", "name")).distinct()
    return local.union(helpers.select(F.lit(None).cast("string").alias("uri"), "name").distinct())


# Class-body calls that are understood.
MODELLED_CALLS = ("private", "protected", "public", "before_action", "skip_before_action")


def computable_views(views: DataFrame) -> DataFrame:
    """uri, computable from one row per view and its gates: dynamic, chain_read,
    declared_once, mixed_in, unmodelled_calls, renders, n_actions."""
    ok = (
        ~F.col("dynamic") & F.col("chain_read") & F.col("declared_once") & ~F.col("mixed_in")
        & (F.size(F.array_except("unmodelled_calls", F.array(*[F.lit(c) for c in MODELLED_CALLS]))) == 0)
        & ~F.col("renders") & (F.col("n_actions") > 0)
    )
    return views.select("uri", F.coalesce(ok, F.lit(False)).alias("computable"))
