"""Column expressions over qualified names, paths and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a name of each kind must be spelled.
IDENTIFIER_PATTERNS = {
    "local_variable": r"^[a-z_][a-zA-Z0-9_]*\z",
    "instance_method": r"^[a-z_][a-zA-Z0-9_]*[?!=]?\z",
    "singleton_method": r"^[a-z_][a-zA-Z0-9_]*[?!=]?\z",
    "ivar": r"^@[a-zA-Z_][a-zA-Z0-9_]*\z",
    "cvar": r"^@@[a-zA-Z_][a-zA-Z0-9_]*\z",
    "class": r"^[A-Z][a-zA-Z0-9_]*\z",
    "module": r"^[A-Z][a-zA-Z0-9_]*\z",
    "constant": r"^[A-Z][a-zA-Z0-9_]*\z",
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bare_name(name: Column | str) -> Column:
    c = _c(name)
    return F.when(c.startswith("::"), F.substr(c, F.lit(3))).otherwise(c)


def qualify_owner(name: Column | str) -> Column:
    """Null stays null; everything else gets exactly one leading ``::``."""
    c = _c(name)
    return F.when(c.startswith("::"), c).otherwise(F.concat(F.lit("::"), c))


def simple_name(name: Column | str) -> Column:
    return F.element_at(F.split(_c(name), "::"), -1)


def simple_name_key(name: Column | str) -> Column:
    return F.lower(simple_name(name))


def namespace_suffixes(name: Column | str) -> Column:
    """Every proper tail of a qualified name with two or more segments."""
    parts = F.split(bare_name(name), "::")
    n = F.size(parts)
    tails = F.transform(
        F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>")),
        lambda k: F.array_join(F.slice(parts, n - k + 1, k), "::"),
    )
    return tails


def camelize(segment: Column | str) -> Column:
    return F.array_join(
        F.transform(
            F.split(_c(segment), "_"),
            lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))),
        ),
        "",
    )


def camelize_path(path: Column | str) -> Column:
    return F.array_join(F.transform(F.split(_c(path), "/"), camelize), "::")


def underscore(segment: Column | str) -> Column:
    return F.lower(F.regexp_replace(_c(segment), "([a-z0-9])([A-Z])", "$1_$2"))


def controller_path_to_owner(path: Column | str) -> Column:
    """``admin/user_posts`` to ``::Admin::UserPostsController``."""
    return F.when(F.length(_c(path)) > 0, F.concat(F.lit("::"), camelize_path(path), F.lit("Controller")))


def owner_to_view_dir(owner: Column | str) -> Column:
    trimmed = F.regexp_replace(bare_name(owner), "Controller$", "")
    return F.array_join(F.transform(F.split(trimmed, "::"), underscore), "/")


VIEW_PATH = r"app/views/(.+)/([^/.]+)\.[^/]*\.erb$"


def view_dir(path: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(path), VIEW_PATH, 1), F.lit(""))


def view_action(path: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(path), VIEW_PATH, 2), F.lit(""))


def model_name_from_path(path: Column | str) -> Column:
    relative = F.regexp_extract(_c(path), r"app/models/(.+)\.rb$", 1)
    return F.when(F.length(relative) > 0, camelize_path(relative))


def classify_change(path: Column | str) -> Column:
    p = _c(path)
    return (
        F.when(p.endswith("config/routes.rb"), "routes")
        .when(p.endswith("Gemfile.lock") | p.contains("config/initializers/"), "restart")
        .when(p.rlike(r"db/schema\.rb$") | p.rlike(r"db/structure\.sql$") | p.rlike("db/migrate/"), "schema")
    )


def route_base_name(method: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(method), r"^(.+)_(?:path|url)$", 1), F.lit(""))


def identifier_valid(kind: Column | str, name: Column | str) -> Column:
    """Whether ``name`` is spelled as a symbol of ``kind`` must be."""
    expr = F.lit(True)
    for k, pattern in IDENTIFIER_PATTERNS.items():
        expr = F.when(_c(kind) == k, _c(name).rlike(pattern)).otherwise(expr)
    return expr
