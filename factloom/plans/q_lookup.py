"""Method lookup, availability and member lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import names as N
from factloom.functions import typeexpr as X
from factloom.operators import hierarchy as H
from factloom.operators import lookup as L
from factloom.plans.facts import CHECK_SQL
from factloom.plans.q_hierarchy import chain, hierarchy
from factloom.plans.registry import query
from factloom.session import durable

# Check-side tables of this module.
CHECK_SQL.update({
    "o_methods": """
        SELECT kind, owner, name, visibility, uri, line, col, n_required, n_optional, has_rest, has_keywords, origin FROM declarations
        UNION ALL SELECT 'singleton_method', d.owner, d.name, visibility, uri, line, col, n_required, n_optional, has_rest, has_keywords, origin
        FROM declarations d JOIN (SELECT DISTINCT owner, name FROM module_functions) m ON d.owner = m.owner AND d.name = m.name
        WHERE kind = 'instance_method' AND NOT EXISTS (SELECT 1 FROM declarations x WHERE x.kind = 'singleton_method' AND x.owner = d.owner AND x.name = d.name)""",
    "o_heads": """
        SELECT kind, owner, name, count(*) AS n_sites, arg_min(visibility, uri || lpad(CAST(line AS VARCHAR), 20, '0')) AS visibility,
          min(uri) AS uri, arg_min(line, uri || lpad(CAST(line AS VARCHAR), 20, '0')) AS line,
          arg_min(n_required, uri || lpad(CAST(line AS VARCHAR), 20, '0')) AS n_required, arg_min(n_optional, uri || lpad(CAST(line AS VARCHAR), 20, '0')) AS n_optional,
          bool_or(has_rest) AS has_rest, bool_or(has_keywords) AS has_keywords FROM o_methods GROUP BY 1, 2, 3""",
    "o_alias": """
        SELECT owner, new_name, CASE WHEN singleton THEN 'singleton_method' ELSE 'instance_method' END AS side, arg_min(old_name, ordinal) AS old_name
        FROM alias_facts GROUP BY 1, 2, 3""",
    "o_requests": "SELECT DISTINCT receiver_type AS receiver, name FROM candidates WHERE kind = 'method_call' AND receiver_form = 'expression'",
    "o_found_i": """
        SELECT q.receiver, q.name, c.pos AS rank, h.kind AS sym_kind, h.owner AS sym_owner, h.name AS sym_name, c.origin, h.visibility, h.n_sites, h.uri, h.line,
          h.n_required, h.n_optional, h.has_rest, h.has_keywords
        FROM o_requests q JOIN chain_i c ON c.owner = q.receiver
        LEFT JOIN o_alias a ON a.owner = '::' || ltrim(c.name, ':') AND a.new_name = q.name AND a.side = c.decl_side
        JOIN o_heads h ON h.kind = c.decl_side AND h.owner = '::' || ltrim(c.name, ':') AND h.name = coalesce(a.old_name, q.name)""",
    "o_signed": "SELECT unnest(['::Object', '::Kernel', '::BasicObject', '::Class', '::Module', '::Ext0']) AS q",
    "o_reason_i": """
        SELECT c.owner AS receiver, CASE WHEN bool_or(c.name IS NULL) OR NOT bool_or(coalesce(c.name = 'BasicObject', false)) THEN 'ancestor_not_identified'
          WHEN bool_or(m.owner IS NOT NULL) THEN 'responds_at_call_time'
          WHEN bool_or(s.owner IS NOT NULL AND c.origin <> 'default') THEN 'surface_open'
          WHEN bool_or(c.name IS NOT NULL AND t.name IS NULL AND c.origin <> 'default' AND g.q IS NULL) THEN 'ancestor_not_declared_anywhere' END AS reason
        FROM chain_i c LEFT JOIN (SELECT DISTINCT owner FROM declarations WHERE name = 'method_missing' AND kind = 'instance_method') m ON m.owner = c.name
        LEFT JOIN (SELECT DISTINCT owner FROM open_surfaces WHERE side = 'instance') s ON s.owner = c.name
        LEFT JOIN (SELECT DISTINCT name FROM types) t ON t.name = c.name LEFT JOIN o_signed g ON g.q = '::' || ltrim(c.name, ':') GROUP BY c.owner""",
    "o_runtime": """
        SELECT 'K' || c_custkey AS name, c_custkey % 19 <> 3 AS present, c_custkey % 23 <> 4 AS local,
          CASE WHEN c_custkey % 29 = 5 THEN 'Gem' || c_custkey ELSE 'M' || c_nationkey END AS extra FROM customer WHERE c_custkey % 31 <> 6""",
})


def heads(f):
    return f.derived("heads", lambda: durable(L.method_heads(L.method_table(f["declarations"], f["module_functions"]))))


def candidates(f):
    """The call sites, joined from the base tables once for all the queries that read them."""
    return f.derived("candidates", lambda: durable(f["candidates"]))


def requests(f):
    return candidates(f).filter("kind = 'method_call' AND receiver_form = 'expression'").select(F.col("receiver_type").alias("receiver"), "name")


# Types of two positional arguments per call.
ARGS = """SELECT uri, line, col, receiver_type, name, CASE col % 4 WHEN 0 THEN 'Integer' WHEN 1 THEN 'K' || col WHEN 2 THEN 'Array[User]' ELSE 'Float' END AS a1,
  CASE col % 3 WHEN 0 THEN 'K' || (col % 100) ELSE 'String' END AS a2, n_positional FROM candidates WHERE kind = 'method_call' AND receiver_form = 'expression'"""


def asked_types(f):
    """The declared types that calls are made on or pass as arguments: name."""
    made_on = candidates(f).filter("kind = 'method_call'").select("receiver_type").distinct()
    made_on = made_on.select(F.explode(F.array_union(F.array("receiver_type"), X.union_members("receiver_type"))).alias("name"))
    passed = f.spark.sql(ARGS.replace("FROM candidates", "FROM {candidates}"), candidates=candidates(f))
    passed = passed.select(F.explode(F.array("a1", "a2")).alias("name")).distinct()
    asked = made_on.union(passed).select(N.qualify_owner("name").alias("_q")).distinct()
    types = hierarchy(f).types
    return types.join(asked, N.qualify_owner("name") == F.col("_q"), "left_semi").select("name")


def asked_chain(f):
    """The instance chains of :func:`asked_types`; those of all types serve where they are made already."""
    def build():
        return durable(H.linearize(hierarchy(f), roots=durable(asked_types(f))))

    return chain(f) if f.has_derived("chain_i") else f.derived("chain_asked", build)


def found(f):
    """Lookup of every call of the corpus on its receiver."""
    return f.derived("found_i", lambda: durable(L.lookup(requests(f), asked_chain(f), heads(f), f["alias_facts"])))


def signature_types(f):
    return f["signature_types"]


def symbols(f):
    return L.method_symbols(f["declarations"], f["module_functions"])


def reasons(f):
    build = lambda: durable(L.chain_reasons(chain(f), chain(f), False, symbols(f), f["open_surfaces"], signature_types(f)))
    return f.derived("reasons_i", build)


def asked_reasons(f):
    """Reasons of the receivers that calls ask; those of all types serve where they are made already."""
    def build():
        return durable(L.chain_reasons(asked_chain(f), asked_chain(f), False, symbols(f), f["open_surfaces"], signature_types(f)))

    return reasons(f) if f.has_derived("reasons_i") else f.derived("reasons_asked", build)


@query("c6_resolve_alias", """WITH r AS (SELECT owner, name, kind AS decl_side FROM declarations UNION SELECT owner, new_name,
    CASE WHEN singleton THEN 'singleton_method' ELSE 'instance_method' END FROM alias_facts)
  SELECT r.owner, r.name, r.decl_side, coalesce(a.old_name, r.name) AS resolved_name FROM r LEFT JOIN o_alias a
    ON a.owner = r.owner AND a.new_name = r.name AND a.side = r.decl_side""")
def resolve_alias(f):
    asked = f["declarations"].select("owner", "name", F.col("kind").alias("decl_side")).union(
        f["alias_facts"].select("owner", "new_name", F.when(F.col("singleton"), "singleton_method").otherwise("instance_method"))
    ).distinct()
    return L.resolve_aliases(asked, f["alias_facts"])


_FOUND = ["receiver", "name", "rank", "sym_kind", "sym_owner", "sym_name", "origin", "visibility", "n_sites", "uri", "line"]


@query("c7_method_lookup", f"SELECT {', '.join(_FOUND)} FROM o_found_i")
def method_lookup(f):
    return found(f).select(*_FOUND)


_UNIONS = """SELECT DISTINCT '::K' || (l_suppkey % 50) || ' | ::K' || (l_partkey % 40 + 50) || CASE WHEN l_linenumber % 2 = 0 THEN ' | nil' ELSE '' END AS receiver_type,
  replace(p_name, ' ', '_') || CASE WHEN l_linenumber = 3 THEN '_old' ELSE '' END AS name FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION SELECT DISTINCT '::K' || (l_suppkey % 50) || CASE WHEN l_linenumber % 2 = 0 THEN ' | nil' ELSE '' END,
  replace(p_name, ' ', '_') || CASE WHEN l_linenumber > 4 THEN '_old' ELSE '' END FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber > 3"""


@query(
    "c8_method_lookup_union",
    f"""WITH l AS (SELECT receiver_type, name, list_filter(string_split(receiver_type, ' | '), lambda x: x <> 'nil') AS ms FROM ({_UNIONS})),
    u AS (SELECT receiver_type, name, unnest(ms) AS receiver, generate_subscripts(ms, 1) AS k FROM l),
    x AS (SELECT u.receiver_type, u.name, u.receiver, u.k * 1000000 + c.pos AS place, c.pos AS rank, h.kind AS sym_kind, h.owner AS sym_owner, h.name AS sym_name, h.visibility
      FROM u JOIN chain_i c ON c.owner = u.receiver
      LEFT JOIN o_alias a ON a.owner = '::' || ltrim(c.name, ':') AND a.new_name = u.name AND a.side = c.decl_side
      JOIN o_heads h ON h.kind = c.decl_side AND h.owner = '::' || ltrim(c.name, ':') AND h.name = coalesce(a.old_name, u.name)),
    p AS (SELECT receiver_type, name, count(DISTINCT receiver) AS n FROM x WHERE sym_name = name GROUP BY 1, 2),
    s AS (SELECT receiver_type, name, count(*) AS total FROM u GROUP BY 1, 2)
    SELECT x.receiver_type, x.name, sym_kind, sym_owner, sym_name, arg_min(rank, place) AS rank, arg_min(visibility, place) AS visibility,
      min(s.total) > 1 AND coalesce(min(p.n), 0) < min(s.total) AS conditional
    FROM x JOIN s USING (receiver_type, name) LEFT JOIN p USING (receiver_type, name) GROUP BY 1, 2, 3, 4, 5""",
)
def method_lookup_union(f):
    return L.lookup_union(f.sql(_UNIONS), chain(f), heads(f), f["alias_facts"])


_ASKED = """SELECT receiver_type, name FROM candidates WHERE kind = 'method_call' AND receiver_form = 'expression'
  UNION ALL SELECT 'Unknown', name FROM candidates WHERE kind = 'ivar'"""


@query(
    "c9_member_availability",
    """SELECT q.receiver AS receiver_type, q.name, CASE WHEN h.name IS NOT NULL THEN 'present' WHEN reason IS NOT NULL THEN 'unknown' ELSE 'absent' END AS state,
      CASE WHEN h.name IS NULL THEN reason END AS reason FROM o_requests q
    LEFT JOIN (SELECT DISTINCT receiver, name FROM o_found_i) h ON h.receiver = q.receiver AND h.name = q.name
    LEFT JOIN o_reason_i r ON r.receiver = q.receiver
    UNION ALL SELECT DISTINCT 'Unknown', name, 'unknown', 'receiver_not_nominal' FROM candidates WHERE kind = 'ivar'""",
)
def member_availability(f):
    return L.availability(f.sql(_ASKED), found(f), reasons(f))


@query("c9_chain_reasons", "SELECT receiver, reason FROM o_reason_i")
def chain_reasons(f):
    return reasons(f)


_SYNTHESISED = "('default', 'class_object', 'singleton_of')"
CHECK_SQL["o_reason_s"] = f"""
        SELECT c.owner AS receiver, CASE WHEN bool_or(c.name IS NULL) OR min(un) OR NOT min(ro) THEN 'ancestor_not_identified'
          WHEN bool_or(m.owner IS NOT NULL) THEN 'responds_at_call_time'
          WHEN bool_or(s.owner IS NOT NULL AND c.origin NOT IN {_SYNTHESISED}) THEN 'surface_open'
          WHEN min(ud) OR bool_or(c.name IS NOT NULL AND t.name IS NULL AND c.origin NOT IN {_SYNTHESISED} AND g.q IS NULL) THEN 'ancestor_not_declared_anywhere' END AS reason
        FROM chain_s c JOIN (SELECT x.owner, bool_or(x.name IS NULL) AS un, bool_or(coalesce(x.name = 'BasicObject', false)) AS ro,
            bool_or(x.name IS NOT NULL AND y.name IS NULL AND x.origin <> 'default' AND z.q IS NULL) AS ud
          FROM chain_i x LEFT JOIN (SELECT DISTINCT name FROM types) y ON y.name = x.name LEFT JOIN o_signed z ON z.q = '::' || ltrim(x.name, ':') GROUP BY 1) i ON i.owner = c.owner
        LEFT JOIN (SELECT DISTINCT kind, owner FROM o_methods WHERE name = 'method_missing') m ON m.owner = '::' || ltrim(c.name, ':') AND m.kind = c.decl_side
        LEFT JOIN (SELECT DISTINCT owner, side FROM open_surfaces) s ON s.owner = c.name AND s.side = CASE WHEN c.origin = 'extend' THEN 'instance' ELSE 'singleton' END
        LEFT JOIN (SELECT DISTINCT name FROM types) t ON t.name = c.name LEFT JOIN o_signed g ON g.q = '::' || ltrim(c.name, ':') GROUP BY c.owner"""


def class_reasons(f):
    def build():
        return durable(L.chain_reasons(chain(f), chain(f, singleton=True), True, symbols(f), f["open_surfaces"], signature_types(f)))

    return f.derived("reasons_s", build)


@query("c9_class_chain_reasons", "SELECT receiver, reason FROM o_reason_s")
def class_chain_reasons(f):
    return class_reasons(f)


def registry(f):
    """What a running process reported about the derived types."""
    seen = f.sql(CHECK_SQL["o_runtime"]).select(
        "name", F.col("present").alias("exists"), "local",
        F.array(F.col("name"), F.col("extra"), F.lit("Object"), F.lit("Kernel"), F.lit("BasicObject")).alias("ancestors"),
    )
    return L.foreign_ancestors(seen, F.array(F.lit("Object"), F.lit("Kernel"), F.lit("BasicObject")))


@query(
    "c20_foreign_ancestors",
    """SELECT name, CASE WHEN NOT present THEN 'absent' WHEN NOT local THEN 'external' ELSE 'loaded' END AS status,
      CASE WHEN present AND local THEN extra ELSE '' END AS foreign_names FROM o_runtime""",
)
def foreign_ancestors(f):
    return registry(f).select("name", "status", F.array_join("foreign", ",").alias("foreign_names"))


_NAMES = "SELECT DISTINCT ltrim(name, ':') AS name FROM chain_i WHERE name IS NOT NULL AND origin <> 'default'"
CHECK_SQL["o_reopened"] = f"""
        SELECT n.name, CASE WHEN r.name IS NULL THEN true WHEN NOT present THEN false WHEN NOT local THEN true ELSE extra LIKE 'Gem%' END AS reopened
        FROM ({_NAMES}) n LEFT JOIN o_runtime r ON r.name = n.name"""


@query("c21_reopened_elsewhere", "SELECT name, reopened FROM o_reopened")
def reopened_elsewhere(f):
    return L.reopened(chain(f), registry(f), f["types"], signature_types(f))


@query(
    "d9_chain_closed",
    """SELECT r.receiver, reason IS NULL AND NOT EXISTS (SELECT 1 FROM chain_i c JOIN o_reopened o ON o.name = ltrim(c.name, ':')
      WHERE c.owner = r.receiver AND o.reopened AND c.origin <> 'default') AS closed FROM o_reason_i r""",
)
def chain_closed(f):
    names = L.reopened(chain(f), registry(f), f["types"], signature_types(f))
    return L.closed_chains(reasons(f), chain(f), names)


_CLASS_NAMES = f"SELECT DISTINCT ltrim(name, ':') AS name FROM chain_s WHERE name IS NOT NULL AND origin NOT IN {_SYNTHESISED}"


@query(
    "d9_class_chain_closed",
    f"""WITH o AS (SELECT n.name, CASE WHEN r.name IS NULL THEN true WHEN NOT present THEN false WHEN NOT local THEN true ELSE extra LIKE 'Gem%' END AS reopened
      FROM ({_CLASS_NAMES}) n LEFT JOIN o_runtime r ON r.name = n.name)
    SELECT r.receiver, reason IS NULL AND NOT EXISTS (SELECT 1 FROM chain_s c JOIN o ON o.name = ltrim(c.name, ':')
      WHERE c.owner = r.receiver AND o.reopened AND c.origin NOT IN {_SYNTHESISED}) AS closed FROM o_reason_s r""",
)
def class_chain_closed(f):
    links = chain(f, singleton=True)
    return L.closed_chains(class_reasons(f), links, L.reopened(links, registry(f), f["types"], signature_types(f)))


@query("d13_pending_questions", f"SELECT name FROM ({_NAMES}) WHERE name NOT IN (SELECT name FROM o_runtime)")
def pending_questions(f):
    return L.pending_questions(chain(f), registry(f))


CHECK_SQL["o_visible"] = """
        SELECT c.owner AS receiver, o.name, min(c.pos) AS rank FROM chain_i c JOIN (
          SELECT kind, owner, name FROM o_heads WHERE visibility NOT IN ('private', 'protected')
          UNION SELECT a.side, a.owner, a.new_name FROM o_alias a LEFT JOIN o_heads h ON h.kind = a.side AND h.owner = a.owner AND h.name = a.old_name
            WHERE coalesce(h.visibility, 'public') NOT IN ('private', 'protected')
              AND NOT EXISTS (SELECT 1 FROM o_heads x WHERE x.kind = a.side AND x.owner = a.owner AND x.name = a.new_name)) o
        ON o.kind = c.decl_side AND o.owner = '::' || ltrim(c.name, ':') GROUP BY 1, 2"""


def visible(f):
    build = lambda: durable(L.visible_names(chain(f), heads(f), f["alias_facts"], symbols(f)))
    return f.derived("visible", build)


_RECEIVERS = """SELECT DISTINCT '::K' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN ' | ::K' || (c_custkey + 1) ELSE '' END AS receiver_type FROM customer"""


@query(
    "g3_completion_members",
    f"""WITH m AS (SELECT receiver_type, unnest(string_split(receiver_type, ' | ')) AS receiver FROM ({_RECEIVERS})),
    s AS (SELECT receiver_type, count(*) AS n FROM m GROUP BY 1),
    v AS (SELECT receiver_type, name, count(*) AS have FROM m JOIN o_visible USING (receiver) GROUP BY 1, 2),
    r AS (SELECT v.receiver_type, v.name, have < n AS conditional, row_number() OVER (PARTITION BY v.receiver_type ORDER BY have < n, v.name) AS rank FROM v JOIN s USING (receiver_type))
    SELECT receiver_type, name, conditional, rank FROM r WHERE rank <= 50""",
)
def completion_members(f):
    return L.completion_members(f.sql(_RECEIVERS), visible(f))


@query(
    "g3_all_members",
    f"""WITH m AS (SELECT receiver_type, unnest(string_split(receiver_type, ' | ')) AS receiver FROM ({_RECEIVERS})),
    s AS (SELECT receiver_type, count(*) AS n FROM m GROUP BY 1)
    SELECT receiver_type, name, count(*) < min(n) AS conditional FROM m JOIN o_visible USING (receiver) JOIN s USING (receiver_type) GROUP BY 1, 2""",
)
def all_members(f):
    """Every name a receiver offers, uncut."""
    return L.offered_members(f.sql(_RECEIVERS), visible(f))


_MEMBERS = """SELECT '::K' || c_custkey AS receiver, n AS name, o AS origin, c_custkey % 7 = 0 AS conditional FROM customer,
  (SELECT 'id' AS n, 'model_column' AS o UNION ALL SELECT 'name', 'model_column' UNION ALL SELECT 'orders', 'model_association' UNION ALL SELECT 'orders', 'model_column'
   UNION ALL SELECT 'save', 'model_api' UNION ALL SELECT 'id', 'model_api' UNION ALL SELECT 'to_s', 'signature' UNION ALL SELECT 'name', 'signature') v"""


@query(
    "e6_merge_members",
    f"""WITH m AS (SELECT receiver, name, 'source' AS origin, false AS conditional FROM o_visible UNION ALL {_MEMBERS}),
    f AS (SELECT *, row_number() OVER (PARTITION BY receiver, name ORDER BY CASE origin WHEN 'source' THEN 0 WHEN 'model_column' THEN 1
      WHEN 'model_association' THEN 2 WHEN 'model_api' THEN 3 ELSE 4 END) AS k FROM m)
    SELECT receiver, name, origin, conditional, row_number() OVER (PARTITION BY receiver ORDER BY conditional,
      CASE origin WHEN 'source' THEN 0 WHEN 'model_column' THEN 1 WHEN 'model_association' THEN 1 WHEN 'signature' THEN 2 ELSE 3 END, name) AS position
    FROM f WHERE k = 1""",
)
def merge_members(f):
    extra = f["customer"].select(
        F.concat(F.lit("::K"), F.col("c_custkey").cast("string")).alias("receiver"), (F.col("c_custkey") % 7 == 0).alias("conditional"),
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("name"), F.lit(o).alias("origin"))
            for n, o in (("id", "model_column"), ("name", "model_column"), ("orders", "model_association"), ("orders", "model_column"), ("save", "model_api"),
                         ("id", "model_api"), ("to_s", "signature"), ("name", "signature"))
        ])).alias("m"),
    ).select("receiver", "m.name", "m.origin", "conditional")
    source = visible(f).select("receiver", "name", F.lit("source").alias("origin"), F.lit(False).alias("conditional"))
    return L.merge_members(source.unionByName(extra))


@query(
    "e7_merge_names_union",
    f"""WITH m AS (SELECT receiver_type, unnest(string_split(receiver_type, ' | ')) AS receiver FROM ({_RECEIVERS}))
    SELECT receiver_type, name, count(DISTINCT receiver) < 2 AS conditional FROM m JOIN o_visible USING (receiver)
    WHERE contains(receiver_type, ' | ') GROUP BY 1, 2""",
)
def merge_names_union(f):
    members = f.sql(_RECEIVERS).filter(X.is_union("receiver_type")).select("receiver_type", F.explode(X.nominal_members("receiver_type")).alias("receiver"))
    return L.union_conditionals(members.join(visible(f), "receiver"), F.lit(2))
