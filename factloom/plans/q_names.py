"""Key derivations, predicates and small lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import names as N
from factloom.functions import typeexpr as X
from factloom.operators import lookup as L
from factloom.plans.registry import query

_NAMES = """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '::Ab' || o_custkey || '::Cd' || o_orderkey
  WHEN 2 THEN 'Ef' || o_custkey ELSE 'Gh::Ij::K' || o_custkey END AS name FROM orders"""


@query("b1_qualify_owner", f"SELECT id, CASE WHEN name LIKE '::%' THEN name ELSE '::' || name END AS owner FROM ({_NAMES})")
def qualify_owner(f):
    return f.sql(_NAMES).select("id", N.qualify_owner("name").alias("owner"))


@query("b2_simple_name", f"SELECT id, string_split(name, '::')[-1] AS simple FROM ({_NAMES})")
def simple_name(f):
    return f.sql(_NAMES).select("id", N.simple_name("name").alias("simple"))


@query("b3_simple_name_key", "SELECT lower(string_split(name, '::')[-1]) AS key, count(*) AS n FROM types GROUP BY 1")
def simple_name_key(f):
    return f["types"].groupBy(N.simple_name_key("name").alias("key")).agg(F.count(F.lit(1)).alias("n"))


_METHOD_TABLE = """WITH twins AS (SELECT 'singleton_method' AS kind, d.owner, d.name, d.uri, d.line FROM declarations d
      JOIN (SELECT DISTINCT owner, name FROM module_functions) m USING (owner, name) WHERE d.kind = 'instance_method'),
    direct AS (SELECT kind, owner, name, uri, line FROM declarations)"""


@query(
    "b4_declarations_for_symbol",
    f"""{_METHOD_TABLE} SELECT * FROM direct UNION ALL SELECT * FROM twins t
    WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.kind = t.kind AND d.owner = t.owner AND d.name = t.name)""",
)
def declarations_for_symbol(f):
    return L.method_table(f["declarations"], f["module_functions"]).select("kind", "owner", "name", "uri", "line")


@query("b5_declarations_for_uri", "SELECT uri, count(*) AS n, min(line) AS first_line FROM declarations WHERE uri LIKE 'app/%' GROUP BY uri")
def declarations_for_uri(f):
    return (
        f["declarations"].filter(F.col("uri").startswith("app/"))
        .groupBy("uri").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"))
    )


@query(
    "b6_method_symbols_of_owner",
    f"{_METHOD_TABLE} SELECT DISTINCT kind, owner, name FROM (SELECT * FROM direct UNION ALL SELECT * FROM twins)",
)
def method_symbols_of_owner(f):
    return L.method_symbols(f["declarations"], f["module_functions"])


@query("b7_class_declarations", "SELECT name, count(*) AS n_sites, min(uri) AS first_uri FROM types WHERE kind IN ('class','module') GROUP BY name")
def class_declarations(f):
    return L.class_declarations(f["types"]).groupBy("name").agg(
        F.count(F.lit(1)).alias("n_sites"), F.min("uri").alias("first_uri")
    )


@query("b8_open_surface_flag", "SELECT owner, side, count(*) AS n FROM open_surfaces GROUP BY 1, 2")
def open_surface_flag(f):
    return L.open_surface_counts(f["open_surfaces"])


_REFS = """SELECT l_orderkey AS id, l_linenumber, CASE WHEN l_discount < 0.05 THEN 'high' ELSE 'low' END AS confidence FROM lineitem"""


@query("b9_confidence_filter", f"SELECT id, l_linenumber FROM ({_REFS}) WHERE confidence = 'high'")
def confidence_filter(f):
    return L.with_confidence(f.sql(_REFS), "high").select("id", "l_linenumber")


_TYPES = """SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'nil' WHEN 2 THEN 'U' || o_custkey
  WHEN 3 THEN 'Array[U' || o_custkey || ']' WHEN 4 THEN 'ClassOf[U' || o_custkey || ']' WHEN 5 THEN 'A' || o_custkey || ' | Array[B | nil] | nil'
  ELSE 'Relation[U] | Hash[X]' END AS type FROM orders"""


@query(
    "b10_union_members",
    """SELECT o_orderkey AS id, unnest(CASE o_orderkey % 7 WHEN 2 THEN ['U' || o_custkey] WHEN 3 THEN ['Array']
      WHEN 5 THEN ['A' || o_custkey, 'Array'] WHEN 6 THEN ['Hash'] ELSE [] END) AS member FROM orders""",
)
def union_members(f):
    return f.sql(_TYPES).select("id", F.explode(X.nominal_members("type")).alias("member"))


@query(
    "b11_base_nominal",
    "SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 2 THEN 'U' || o_custkey WHEN 3 THEN 'Array' END AS base FROM orders",
)
def base_nominal(f):
    return f.sql(_TYPES).select("id", X.base_nominal("type").alias("base"))


@query(
    "b12_normalize_class_receiver",
    f"""SELECT id, CASE WHEN type LIKE 'ClassOf[%' THEN regexp_extract(type, '^ClassOf\\[(.*)\\]$', 1) ELSE type END AS type,
      type LIKE 'ClassOf[%' AS singleton FROM ({_TYPES})""",
)
def normalize_class_receiver(f):
    return f.sql(_TYPES).select("id", X.class_receiver("type").alias("r")).select("id", "r.type", "r.singleton")


_PATHS = """SELECT o_orderkey AS id, 'admin/user_posts/p' || o_custkey || '_items' AS path FROM orders"""


@query("b13_controller_path_to_owner", "SELECT o_orderkey AS id, '::Admin::UserPosts::P' || o_custkey || 'ItemsController' AS owner FROM orders")
def controller_path_to_owner(f):
    return f.sql(_PATHS).select("id", N.controller_path_to_owner("path").alias("owner"))


@query("b14_owner_to_view_dir", "SELECT o_orderkey AS id, 'admin/user_posts/p' || o_custkey || '_items' AS view_dir FROM orders")
def owner_to_view_dir(f):
    owners = f.sql("SELECT o_orderkey AS id, '::Admin::UserPosts::P' || o_custkey || 'ItemsController' AS owner FROM orders")
    return owners.select("id", N.owner_to_view_dir("owner").alias("view_dir"))


_FILES = """SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN 'app/views/admin/c' || o_custkey || '/show.html.erb'
  WHEN 1 THEN 'app/models/shop/order_item' || o_custkey || '.rb' WHEN 2 THEN 'config/routes.rb' WHEN 3 THEN 'Gemfile.lock'
  WHEN 4 THEN 'config/initializers/x' || o_custkey || '.rb' WHEN 5 THEN 'db/schema.rb' WHEN 6 THEN 'db/migrate/' || o_custkey || '_a.rb'
  ELSE 'lib/z' || o_custkey || '.rb' END AS path FROM orders"""


@query(
    "b15_view_path_parts",
    "SELECT o_orderkey AS id, 'admin/c' || o_custkey AS dir, 'show' AS action FROM orders WHERE o_orderkey % 8 = 0",
)
def view_path_parts(f):
    return f.sql(_FILES).select("id", N.view_dir("path").alias("dir"), N.view_action("path").alias("action")).filter("dir IS NOT NULL")


@query("b16_model_name_from_path", "SELECT o_orderkey AS id, 'Shop::OrderItem' || o_custkey AS model FROM orders WHERE o_orderkey % 8 = 1")
def model_name_from_path(f):
    return f.sql(_FILES).select("id", N.model_name_from_path("path").alias("model")).filter("model IS NOT NULL")


@query(
    "b17_classify_change",
    """SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 2 THEN 'routes' WHEN 3 THEN 'restart' WHEN 4 THEN 'restart' WHEN 5 THEN 'schema'
      WHEN 6 THEN 'schema' END AS change FROM orders""",
)
def classify_change(f):
    return f.sql(_FILES).select("id", N.classify_change("path").alias("change"))


@query(
    "b18_route_base_name",
    """SELECT name, CASE WHEN regexp_matches(name, '^.+_(path|url)$') THEN regexp_extract(name, '^(.+)_(?:path|url)$', 1) END AS base, count(*) AS n
    FROM candidates WHERE kind = 'method_call' GROUP BY 1, 2""",
)
def route_base_name(f):
    calls = f["candidates"].filter("kind = 'method_call'")
    return calls.groupBy("name", N.route_base_name("name").alias("base")).agg(F.count(F.lit(1)).alias("n"))


_RENAMED = """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'instance_method' WHEN 1 THEN 'class' WHEN 2 THEN 'ivar' ELSE 'local_variable' END AS kind,
  CASE p_size % 5 WHEN 0 THEN 'ok_name?' WHEN 1 THEN 'Const' WHEN 2 THEN '@iv' WHEN 3 THEN 'bad name' ELSE p_brand END AS name FROM part"""


@query(
    "b19_identifier_valid",
    f"""SELECT id, CASE kind WHEN 'instance_method' THEN regexp_matches(name, '^[a-z_][a-zA-Z0-9_]*[?!=]?$')
      WHEN 'class' THEN regexp_matches(name, '^[A-Z][a-zA-Z0-9_]*$') WHEN 'ivar' THEN regexp_matches(name, '^@[a-zA-Z_][a-zA-Z0-9_]*$')
      ELSE regexp_matches(name, '^[a-z_][a-zA-Z0-9_]*$') END AS valid FROM ({_RENAMED})""",
)
def identifier_valid(f):
    return f.sql(_RENAMED).select("id", N.identifier_valid("kind", "name").alias("valid"))


# --- type algebra ------------------------------------------------------------------

_OBSERVED = """SELECT o_custkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'nil' WHEN 1 THEN 'Array' WHEN 2 THEN 'Array[Unknown]'
  WHEN 3 THEN 'User' WHEN 4 THEN 'Zed | nil' ELSE 'B' || (o_custkey % 3) END AS type FROM orders"""


@query(
    "e2_type_union",
    f"""WITH m AS (SELECT DISTINCT k, unnest(string_split(type, ' | ')) AS t FROM ({_OBSERVED})),
    k AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.k = m.k AND o.t = m.t || '[Unknown]'))
    SELECT k, string_agg(t, ' | ' ORDER BY t) AS type FROM k GROUP BY k""",
)
def type_union(f):
    return X.union_agg(f.sql(_OBSERVED), ["k"], "type", "type")


@query(
    "e3_remove_nil",
    "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'U' || o_custkey ELSE 'A | B' END AS type FROM orders",
)
def remove_nil(f):
    given = f.sql("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'nil' WHEN 1 THEN 'U' || o_custkey || ' | nil' ELSE 'B | A | nil' END AS type FROM orders")
    return given.select("id", X.remove_nil("type").alias("type"))


@query(
    "e4_substitute_types",
    """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'Array[T' || o_custkey || ']' WHEN 1 THEN 'T' || o_custkey || ' | nil'
      ELSE 'Array[Unknown]' END AS type FROM orders""",
)
def substitute_types(f):
    given = f.sql("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'Array[T]' WHEN 1 THEN 'nil | T' ELSE 'Array[U]' END AS template, 'T' || o_custkey AS t FROM orders")
    bindings = F.create_map(F.lit("T"), F.col("t"), F.lit("U"), F.lit(None).cast("string"))
    return given.select("id", X.substitute("template", bindings).alias("type"))


@query(
    "s8_normalize_observed_value",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'nil' WHEN 'click' THEN 'ClassOf[U' || user_id || ']' WHEN 'view' THEN 'Unknown'
      ELSE 'U' || user_id END AS type FROM events""",
)
def normalize_observed_value(f):
    seen = f.sql("""SELECT event_id, CASE event_type WHEN 'error' THEN 'nil' WHEN 'click' THEN 'module' ELSE 'object' END AS value_kind,
      CASE WHEN event_type = 'view' THEN NULL ELSE 'U' || user_id END AS class_name FROM events""")
    return seen.select("event_id", X.observed_type("value_kind", "class_name").alias("type"))
