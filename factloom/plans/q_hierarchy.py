"""Ancestor chains, nesting and dependency graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import graph as G
from factloom.operators import hierarchy as H
from factloom.operators.resolve import type_index
from factloom.plans.facts import CHECK_SQL
from factloom.plans.registry import query
from factloom.session import durable


def hierarchy(f):
    """The hierarchy of the derived types."""

    def build():
        facts = f["ancestor_facts"].withColumn("nesting", F.array(F.col("owner")))
        types = f["types"]
        return H.build(facts, types, type_index(types, keep=True))

    return f.derived("hierarchy", build)


def chain(f, singleton: bool = False):
    """Every ancestor chain of one side, kept for the queries that follow."""
    closure = f.derived("closure", lambda: H.superclass_closure(hierarchy(f).superclass))
    name = "chain_s" if singleton else "chain_i"
    return f.derived(name, lambda: durable(H.linearize(hierarchy(f), singleton=singleton, closure=closure)))


_CHAIN = ["owner", "pos", "name", "origin", "decl_side"]


@query("d1_instance_ancestors", "SELECT owner, pos, name, origin, decl_side FROM chain_i")
def instance_ancestors(f):
    return chain(f).select(*_CHAIN)


@query("d2_singleton_ancestors", "SELECT owner, pos, name, origin, decl_side FROM chain_s")
def singleton_ancestors(f):
    return chain(f, singleton=True).select(*_CHAIN)


@query(
    "d3_concern_closure",
    """WITH r AS (SELECT c_custkey AS k, c_nationkey AS m, 0 AS p FROM customer WHERE c_nationkey % 8 = 0
      UNION ALL SELECT c_custkey, (c_nationkey + 7) % 25, 1 FROM customer WHERE c_custkey % 5 = 0 AND ((c_nationkey + 7) % 25) % 8 = 0)
    SELECT '::K' || k AS owner, '::M' || m AS concern, row_number() OVER (PARTITION BY k ORDER BY p) AS ord FROM r""",
)
def concern_closure(f):
    facts = f["ancestor_facts"].withColumn("nesting", F.array(F.col("owner")))
    return H.concern_targets(H.resolve_links(facts, type_index(f["types"])))


@query("d4_unidentified_links", "SELECT owner, bool_or(name IS NULL) AS has_unidentified FROM chain_i GROUP BY owner")
def unidentified_links(f):
    return H.unidentified_links(chain(f))


@query(
    "d5_dedupe_chain",
    "SELECT owner, count(*) AS n, count(DISTINCT name || decl_side) AS n_named, count(*) FILTER (name IS NULL) AS n_unnamed FROM chain_s GROUP BY owner",
)
def dedupe_chain(f):
    rows = chain(f, singleton=True)
    return rows.groupBy("owner").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("name").isNotNull(), 1)).alias("n_named"),
        F.count(F.when(F.col("name").isNull(), 1)).alias("n_unnamed"),
    )


@query("d6_declaration_side", "SELECT origin, decl_side, count(*) AS n FROM chain_s GROUP BY 1, 2")
def declaration_side(f):
    return chain(f, singleton=True).groupBy("origin", "decl_side").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d7_latest_superclass",
    """SELECT '::K' || k AS owner, CASE WHEN k % 97 = 50 THEN NULL ELSE '::K' || CAST(floor(k / 3.0) AS BIGINT) END AS target
    FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey > 0)""",
)
def latest_superclass(f):
    links = f["ancestor_facts"].withColumns({"resolved": F.col("target"), "is_guessed": F.lit(False)})
    return H.latest_superclass(links).select("owner", "target")


@query(
    "d8_lookup_owners",
    "SELECT name, decl_side, count(*) AS n, min(pos) AS nearest FROM chain_s WHERE name IS NOT NULL GROUP BY 1, 2",
)
def lookup_owners(f):
    owners = H.lookup_owners(chain(f, singleton=True))
    return owners.groupBy("name", "decl_side").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("nearest"))


@query(
    "d10_invalidate_dependents",
    """WITH RECURSIVE changed AS (SELECT 'p' || p_partkey AS s FROM part WHERE p_size = 50 AND p_partkey % 50 = 3),
    e AS (SELECT DISTINCT caller, callee FROM call_edges),
    b AS (SELECT s AS symbol_id, 0 AS distance FROM changed UNION
      SELECT caller, distance + 1 FROM b JOIN e ON callee = symbol_id WHERE distance < 12)
    SELECT symbol_id, min(distance) AS distance FROM b GROUP BY 1""",
)
def invalidate_dependents(f):
    changed = f["part"].filter("p_size = 50 AND p_partkey % 50 = 3").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("symbol_id"))
    return G.affected(changed, f["call_edges"])


# Call trees for propagation: a method calls the one a third of its number, so
# the check can walk them; methods at the bottom return a literal.
_TREE_EDGES = """SELECT 'p' || p_partkey AS caller, 'p' || CAST(floor(p_partkey / 3.0) AS BIGINT) AS callee FROM part
  WHERE p_partkey > 8 AND p_size % 7 <> 0
  UNION ALL SELECT 'p' || p_partkey, 'p' || p_partkey FROM part WHERE p_size = 49
  UNION ALL SELECT 'p' || p_partkey, 'gone' || p_partkey FROM part WHERE p_size = 35"""
_TREE_LITERALS = """SELECT 'p' || p_partkey AS symbol_id, CASE p_partkey % 3 WHEN 0 THEN 'String' WHEN 1 THEN 'Integer' ELSE 'nil' END AS type
  FROM part WHERE p_partkey <= 8 OR p_size % 7 = 0 OR p_size % 5 = 0"""
_TREE_METHODS = "SELECT 'p' || p_partkey AS symbol_id, CAST(1 + p_size % 2 AS BIGINT) AS n_sites FROM part"


CHECK_SQL["o_returns"] = f"""WITH RECURSIVE e AS ({_TREE_EDGES}), l AS ({_TREE_LITERALS}), m AS ({_TREE_METHODS}),
    w AS (SELECT symbol_id AS root, symbol_id AS cur, 0 AS depth, [symbol_id] AS path, CAST(NULL AS VARCHAR) AS why FROM m
      UNION ALL SELECT root, callee, depth + 1, list_append(path, callee),
        CASE WHEN list_contains(path, callee) THEN 'recursive_widened' WHEN depth + 1 >= 12 THEN 'timeout'
             WHEN callee LIKE 'gone%' THEN 'partial' END
      FROM w JOIN e ON caller = cur WHERE why IS NULL),
    t AS (SELECT root, type FROM w JOIN l ON symbol_id = cur WHERE why IS NULL UNION SELECT root, 'Unknown' FROM w WHERE why IS NOT NULL),
    u AS (SELECT root, string_agg(type, ' | ' ORDER BY type) AS return_type FROM t GROUP BY root),
    s AS (SELECT root, bool_or(why = 'timeout') AS to_, bool_or(why = 'recursive_widened') AS rec, count(why) AS bad FROM w GROUP BY root)
    SELECT m.symbol_id, coalesce(return_type, 'Unknown') AS return_type,
      CASE WHEN coalesce(to_, false) THEN 'timeout' WHEN coalesce(rec, false) THEN 'recursive_widened' ELSE 'complete' END AS status,
      CASE WHEN bad > 0 OR n_sites > 1 THEN 'low' ELSE 'high' END AS confidence
    FROM m JOIN s ON s.root = symbol_id LEFT JOIN u ON u.root = symbol_id"""


def returns(f):
    """What methods return, by propagation over the call trees."""
    build = lambda: durable(G.propagate_return_types(f.sql(_TREE_METHODS), f.sql(_TREE_EDGES), f.sql(_TREE_LITERALS)))
    return f.derived("returns", build)


@query("d11_return_type_propagation", "SELECT symbol_id, return_type, status, confidence FROM o_returns")
def return_type_propagation(f):
    return returns(f)


@query(
    "d12_document_outline",
    """WITH d AS (SELECT uri, line, kind, name, owner FROM (SELECT uri, line, kind, name, CAST(NULL AS VARCHAR) AS owner FROM types
        UNION ALL SELECT uri, line, kind, name, owner FROM declarations))
    SELECT c.uri, c.line, string_split(c.name, '::')[-1] AS name, CASE c.kind WHEN 'module' THEN 2 WHEN 'class' THEN 5 WHEN 'constant' THEN 14 ELSE 6 END AS kind_code,
      CASE WHEN c.owner IS NULL THEN 0 ELSE 1 END AS depth,
      CASE WHEN c.owner IS NULL THEN '' ELSE p.name || '/' END || c.name AS path
    FROM d c LEFT JOIN (SELECT DISTINCT uri, name FROM d WHERE kind IN ('class','module')) p ON p.uri = c.uri AND p.name = c.owner
    WHERE c.owner IS NULL OR p.name IS NOT NULL""",
)
def document_outline(f):
    declarations = f.sql("""SELECT uri, line, kind, name, CAST(NULL AS STRING) AS owner FROM types
      UNION ALL SELECT uri, line, kind, name, owner FROM declarations""")
    return G.outline(declarations)
