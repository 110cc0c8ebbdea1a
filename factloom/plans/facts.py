"""Fact tables derived from the base tables.

One SQL text per table, valid for Spark and for the reference check in DuckDB.
Every table reads its base tables whole, so facts grow with them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from factloom.sources.tables import BASE_TABLES, table

N_CUST = "(SELECT count(*) FROM customer)"
N_PART = "(SELECT count(*) FROM part)"

FACT_SQL: dict[str, str] = {
    # --- types and their links ------------------------------------------------
    "types": """
        SELECT '::K' || c_custkey AS name, 'class' AS kind,
               'app/k' || CAST(floor(c_custkey / 50.0) AS BIGINT) || '.rb' AS uri, c_custkey % 50 AS line
        FROM customer
        UNION ALL
        SELECT '::N' || c_nationkey || '::C' || (c_custkey % 40), 'class',
               'app/n' || c_nationkey || '.rb', c_custkey
        FROM customer
        UNION ALL
        SELECT '::M' || n_nationkey, 'module', 'lib/m.rb', CAST(n_nationkey AS BIGINT) FROM nation
        UNION ALL
        SELECT '::M' || n_nationkey || '::ClassMethods', 'module', 'lib/m.rb', CAST(n_nationkey + 100 AS BIGINT)
        FROM nation WHERE n_nationkey % 8 = 0""",
    "ancestor_facts": """
        SELECT 'app/k' || CAST(floor(c_custkey / 50.0) AS BIGINT) || '.rb' AS uri, c_custkey * 10 AS ordinal,
               '::K' || c_custkey AS owner, 'superclass' AS relation,
               CASE WHEN c_custkey % 97 = 50 THEN NULL
                    ELSE '::K' || CAST(floor(c_custkey / 3.0) AS BIGINT) END AS target
        FROM customer WHERE c_custkey > 0
        UNION ALL
        SELECT 'app/k' || CAST(floor(c_custkey / 50.0) AS BIGINT) || '.rb', c_custkey * 10 + 1,
               '::K' || c_custkey, 'include', 'M' || c_nationkey
        FROM customer
        UNION ALL
        SELECT 'app/k' || CAST(floor(c_custkey / 50.0) AS BIGINT) || '.rb', c_custkey * 10 + 2,
               '::K' || c_custkey, 'include', 'C' || (c_custkey % 40)
        FROM customer WHERE c_custkey % 89 = 2
        UNION ALL
        SELECT 'app/k' || CAST(floor(c_custkey / 50.0) AS BIGINT) || '.rb', c_custkey * 10 + 5,
               '::K' || c_custkey, 'include', 'Ext' || (c_custkey % 2)
        FROM customer WHERE c_custkey % 83 = 4
        UNION ALL
        SELECT 'app/k' || CAST(floor(c_custkey / 50.0) AS BIGINT) || '.rb', c_custkey * 10 + 3,
               '::K' || c_custkey, 'prepend', '::M' || ((c_nationkey + 7) % 25)
        FROM customer WHERE c_custkey % 5 = 0
        UNION ALL
        SELECT 'app/k' || CAST(floor(c_custkey / 50.0) AS BIGINT) || '.rb', c_custkey * 10 + 4,
               '::K' || c_custkey, 'extend', 'M' || ((c_nationkey + 3) % 25)
        FROM customer WHERE c_custkey % 4 = 0
        UNION ALL
        SELECT 'lib/m.rb', CAST(n_nationkey * 10 AS BIGINT), '::M' || n_nationkey, 'include', 'M' || (n_nationkey - 10)
        FROM nation WHERE n_nationkey >= 20
        UNION ALL
        SELECT 'lib/m.rb', CAST(n_nationkey * 10 + 1 AS BIGINT), '::M' || n_nationkey, 'concern_class_methods', NULL
        FROM nation WHERE n_nationkey % 8 = 0""",
    # --- methods --------------------------------------------------------------
    "declarations": f"""
        SELECT CASE WHEN p_size % 7 = 0 THEN 'singleton_method' ELSE 'instance_method' END AS kind,
               '::K' || (p_partkey % {N_CUST}) AS owner,
               CASE WHEN p_partkey % 211 = 5 THEN 'method_missing' ELSE replace(p_name, ' ', '_') END AS name,
               CASE WHEN p_size % 5 = 0 THEN 'private' WHEN p_size % 5 = 1 THEN 'protected' ELSE 'public' END AS visibility,
               'app/k' || CAST(floor((p_partkey % {N_CUST}) / 50.0) AS BIGINT) || '.rb' AS uri,
               p_partkey AS line, CAST(p_size AS BIGINT) AS col,
               CASE WHEN p_partkey % 13 = 0 THEN 'generated' ELSE 'source' END AS origin,
               CAST(p_size % 3 AS BIGINT) AS n_required, CAST(p_size % 2 AS BIGINT) AS n_optional,
               p_size % 10 = 9 AS has_rest, p_size % 4 = 3 AS has_keywords
        FROM part
        UNION ALL
        SELECT 'instance_method', '::M' || s_nationkey, 'mod_' || (s_suppkey % 7), 'public', 'lib/m.rb',
               s_suppkey, CAST(0 AS BIGINT), 'source', s_suppkey % 2, CAST(0 AS BIGINT), FALSE, FALSE
        FROM supplier""",
    "alias_facts": f"""
        SELECT '::K' || (p_partkey % {N_CUST}) AS owner, replace(p_name, ' ', '_') || '_old' AS new_name,
               replace(p_name, ' ', '_') AS old_name, p_size % 7 = 0 AS singleton, p_partkey AS ordinal
        FROM part WHERE p_partkey % 11 = 0""",
    "open_surfaces": """
        SELECT 'lib/m.rb' AS uri, '::M' || n_nationkey AS owner, 'instance' AS side
        FROM nation WHERE n_nationkey % 12 = 0
        UNION ALL
        SELECT 'app/k' || CAST(floor(c_custkey / 50.0) AS BIGINT) || '.rb', '::K' || c_custkey, 'singleton'
        FROM customer WHERE c_custkey % 61 = 9""",
    "module_functions": """
        SELECT '::M' || n_nationkey AS owner, 'mod_' || (n_nationkey % 7) AS name FROM nation""",
    # --- call sites -----------------------------------------------------------
    "candidates": f"""
        SELECT 'o' || l_orderkey AS uri, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS col,
               CASE WHEN l_linenumber = 7 THEN 'constant' WHEN l_linenumber = 6 THEN 'ivar'
                    WHEN l_linenumber = 5 THEN 'local_variable' ELSE 'method_call' END AS kind,
               CASE WHEN l_linenumber = 7 THEN CASE WHEN l_partkey % 3 = 0 THEN 'K' || l_partkey
                                                    WHEN l_partkey % 3 = 1 THEN 'C' || (l_partkey % 50)
                                                    ELSE 'N' || (l_partkey % 30) || '::C' || (l_partkey % 40) END
                    WHEN l_linenumber = 6 THEN '@v' || (l_partkey % 9)
                    WHEN l_linenumber = 5 THEN 'x' || (l_partkey % 9)
                    WHEN l_returnflag = 'R' THEN replace(p_name, ' ', '_') || '_missing'
                    WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 'mod_' || (l_partkey % 7)
                    WHEN l_returnflag = 'A' AND l_linenumber = 2 THEN 'nation_' || (l_suppkey % 40) || '_path'
                    WHEN l_returnflag = 'A' AND l_linenumber = 3 THEN replace(p_name, ' ', '_') || '_old'
                    ELSE replace(p_name, ' ', '_') END AS name,
               CASE WHEN l_returnflag = 'A' AND l_linenumber = 2 THEN 'none' ELSE 'expression' END AS receiver_form,
               '::K' || (l_suppkey % {N_CUST}) AS receiver_type, 's' || l_orderkey AS scope_id,
               CAST(l_quantity AS BIGINT) % 4 AS n_positional, l_linestatus = 'F' AS keywords,
               l_discount > 0.095 AS splat
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    # Calls of every form: on self, on a constant as an enclosing frame sees it, on a
    # class object, on unions with and without nil or a class object, on a query.
    "call_sites": f"""
        SELECT 'o' || l_orderkey AS uri, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS col, 'method_call' AS kind,
               CASE WHEN l_returnflag = 'R' AND l_linenumber <= 4 THEN replace(p_name, ' ', '_') || '_old'
                    WHEN l_returnflag = 'A' AND l_quantity > 40 THEN 'mod_' || (l_partkey % 7)
                    WHEN l_returnflag = 'A' AND l_linenumber = 1 AND l_quantity < 5 THEN 'nation_' || (l_suppkey % 40) || '_path'
                    WHEN l_returnflag = 'A' AND l_linenumber IN (1, 7) AND l_quantity < 20 THEN 'c_name'
                    ELSE replace(p_name, ' ', '_') END AS name,
               CASE WHEN l_linenumber = 1 THEN 'none' WHEN l_linenumber = 2 THEN 'constant' ELSE 'expression' END AS receiver_form,
               CASE WHEN l_linenumber = 2 THEN CASE WHEN l_suppkey % 3 = 0 THEN 'C' || (l_partkey % 40)
                                                    WHEN l_suppkey % 3 = 1 THEN '::K' || (l_partkey % {N_CUST}) ELSE 'K' || (l_partkey % {N_CUST}) END END AS receiver,
               '::K' || (l_partkey % {N_CUST}) AS owner, '::N' || (l_suppkey % 25) AS frame,
               CASE l_linenumber WHEN 3 THEN 'ClassOf[::K' || (l_partkey % {N_CUST}) || ']'
                    WHEN 4 THEN '::K' || (l_partkey % {N_CUST}) || ' | ::K' || CAST(floor((l_partkey % {N_CUST}) / 3.0) AS BIGINT) || CASE WHEN l_suppkey % 2 = 0 THEN ' | nil' ELSE '' END
                    WHEN 5 THEN 'ClassOf[::K' || (l_suppkey % 9) || '] | ::K' || (l_partkey % {N_CUST})
                    WHEN 6 THEN 'Relation[::K' || (l_partkey % {N_CUST}) || ']'
                    WHEN 7 THEN 'K' || (l_partkey % {N_CUST}) END AS inferred_type,
               l_linenumber = 2 OR (l_linenumber = 1 AND l_linestatus = 'F') AS singleton
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    # --- routes and models ----------------------------------------------------
    "routes": """
        SELECT CAST(n_nationkey * 2 AS BIGINT) AS ordinal, lower(n_name) AS name, 'POST' AS verb,
               lower(r_name) AS controller, 'create' AS action, 'id' AS part
        FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL
        SELECT CAST(n_nationkey * 2 + 1 AS BIGINT), lower(n_name), 'GET', lower(r_name), 'show', 'slug'
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "model_members": " UNION ALL ".join(
        f"SELECT 'K' || c_custkey AS model, {values} FROM customer WHERE c_custkey % 10 = 0"
        for values in (
            "'hot_gear' AS member, 'active_record_column' AS kind, 'String' AS type, TRUE AS nullable, "
            "CAST(NULL AS VARCHAR(9)) AS class_name, CAST(NULL AS VARCHAR(9)) AS macro, CAST(NULL AS BOOLEAN) AS optional",
            "'hot_gear_missing', 'active_record_column', 'Integer', FALSE, NULL, NULL, NULL",
            "'cold_rod', 'active_record_association', NULL, NULL, 'User', 'belongs_to', FALSE",
            "'cold_rod_missing', 'active_record_association', NULL, NULL, 'User', 'belongs_to', TRUE",
            "'new_rod_missing', 'active_record_association', NULL, NULL, 'Post', 'has_one', TRUE",
            "'old_rod_missing', 'active_record_association', NULL, NULL, 'Tag', 'has_many', TRUE",
        )
    ),
    "models": "SELECT 'K' || c_custkey AS model, c_custkey % 20 = 0 AS partial FROM customer WHERE c_custkey % 10 = 0",
    "signature_methods": """
        SELECT DISTINCT 'instance_method' AS kind, '::Kernel' AS owner, replace(p_name, ' ', '_') || '_missing' AS name
        FROM part WHERE p_name LIKE 'red%'
        UNION ALL SELECT 'instance_method', '::M' || n_nationkey, 'blue_bolt_missing' FROM nation""",
    # Types that signatures declare: the roots, and one outside library.
    "signature_types": "SELECT name FROM (VALUES ('Object'), ('Kernel'), ('BasicObject'), ('Class'), ('Module'), ('Ext0')) v(name)",
    # --- traces ---------------------------------------------------------------
    "trace_events": """
        SELECT user_id AS fiber, event_id AS seq, ts,
               CASE event_type WHEN 'click' THEN 'call' WHEN 'view' THEN 'call'
                               WHEN 'error' THEN 'raise' ELSE 'return' END AS event,
               CASE event_type WHEN 'click' THEN 'A' WHEN 'purchase' THEN 'A' ELSE 'B' END AS call_key,
               CASE WHEN value < 50 THEN 'Integer' ELSE 'Float' END AS arg_type,
               CASE WHEN value < 20 THEN NULL WHEN value < 60 THEN 'String' ELSE 'User' END AS return_type
        FROM events""",
    "call_edges": f"""
        SELECT 'p' || l_partkey AS caller, 'p' || ((l_partkey * 7 + l_linenumber) % {N_PART}) AS callee
        FROM lineitem""",
    # --- texts ----------------------------------------------------------------
    "log_lines": """
        SELECT doc_id, text || chr(10) || 'GET /home/user' || (doc_id % 9) || '/x by ' || chr(92) || 'Users' || chr(92) || 'ann' || chr(92) || 'y or /home/'
               || source || '/z' || chr(10) || CASE doc_id % 6
                 WHEN 0 THEN 'Authorization: bearer ab' || doc_id || 'cd=='
                 WHEN 1 THEN 'Authorization: Basic dXNlcjpw' || doc_id
                 WHEN 2 THEN 'postgres://app:p@ss#' || doc_id || '@db.example/x'
                 WHEN 3 THEN 'key AKIAABCDEFGH' || lpad(CAST(doc_id % 10000 AS VARCHAR(8)), 8, '0') || ' sk_live_abcdefghij' || doc_id
                 WHEN 4 THEN 'api_key = "v' || doc_id || '", secret:s' || doc_id
                 ELSE 'ghp_abcdefghijklmnopqrst' || doc_id || ' xoxb-1234567890-' || doc_id END AS text
        FROM documents""",
    "templates": """
        SELECT doc_id, '<p>' || source || '</p>' || chr(10) || '<%= user.name' || doc_id || ' %> <%# note %>'
               || '<% x = ' || (doc_id % 3) || ' -%>' || CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE '' END
               || '<%- y %>' || text || '<%=' || lang || '%>' || chr(10) || 'tail' AS text
        FROM documents""",
    "source_files": """
        SELECT 'lib/' || source || '/d' || doc_id || '.rb' AS uri,
               '# frozen_string_literal: true' || chr(10) || '# Doc of m' || (doc_id % 3) || chr(10)
               || '#  ' || lang || chr(10) || 'def m' || (doc_id % 3) || chr(10) || text || chr(10)
               || '  rescue Alpha' || chr(10) || 'rescue Beta' || chr(10) || 'end' || chr(10) || '# rubocop:disable X'
               || chr(10) || 'def self.q?' || chr(10) || 'rescue' || chr(10)
               || CASE WHEN doc_id % 4 = 0 THEN 'instance_variable_set(:@a, 1)' ELSE '' END AS text
        FROM documents""",
    # --- file snapshots -------------------------------------------------------
    "snapshot_prev": "SELECT 'd' || doc_id AS uri, text FROM documents",
    "snapshot_cur": """
        SELECT 'd' || doc_id AS uri, CASE WHEN doc_id % 5 = 0 THEN text || ' edited' ELSE text END AS text
        FROM documents WHERE doc_id % 7 <> 0
        UNION ALL
        SELECT 'd' || (doc_id + 1000000000000), text FROM documents WHERE doc_id % 10 = 1""",
}

# Tables only the SQL check uses: the ancestor chains of the derived types,
# spelled out for this data by recursion along the superclass numbers.
CHECK_SQL: dict[str, str] = {
    "o_sup": """
        SELECT c_custkey AS root, 0 AS d, c_custkey AS k FROM customer
        UNION ALL
        SELECT root, d + 1, CAST(floor(k / 3.0) AS BIGINT) FROM o_sup WHERE k > 0 AND k % 97 <> 50""",
    "o_walk_i": """
        SELECT root, d, 1 AS a, 0 AS b, '::M' || ((c_nationkey + 7) % 25) AS name, 'prepend' AS origin
        FROM o_sup JOIN customer ON k = c_custkey WHERE k % 5 = 0
        UNION ALL SELECT root, d, 1, 1, '::M' || ((c_nationkey + 7) % 25 - 10), 'include'
        FROM o_sup JOIN customer ON k = c_custkey WHERE k % 5 = 0 AND (c_nationkey + 7) % 25 >= 20
        UNION ALL SELECT root, d, 2, 0, '::K' || k, CASE WHEN d = 0 THEN 'self' ELSE 'superclass' END FROM o_sup
        UNION ALL SELECT root, d, 3, 0, 'Ext' || (k % 2), 'include' FROM o_sup WHERE k % 83 = 4
        UNION ALL SELECT root, d, 3, 1, NULL, 'include' FROM o_sup WHERE k % 89 = 2
        UNION ALL SELECT root, d, 4, 0, '::M' || c_nationkey, 'include' FROM o_sup JOIN customer ON k = c_custkey
        UNION ALL SELECT root, d, 4, 1, '::M' || (c_nationkey - 10), 'include'
        FROM o_sup JOIN customer ON k = c_custkey WHERE c_nationkey >= 20
        UNION ALL SELECT root, d, 9, 0, NULL, 'superclass' FROM o_sup WHERE k % 97 = 50
        UNION ALL SELECT root, d, 9, i, n, 'default' FROM o_sup,
          (VALUES (1, 'Object'), (2, 'Kernel'), (3, 'BasicObject')) v(i, n) WHERE k = 0""",
    "o_seen_i": """
        SELECT *, row_number() OVER (PARTITION BY root, name ORDER BY d, a, b) AS r FROM o_walk_i""",
    "chain_i": """
        SELECT '::K' || root AS owner, row_number() OVER (PARTITION BY root ORDER BY d, a, b) - 1 AS pos, name, origin,
          'instance_method' AS decl_side FROM o_seen_i WHERE r = 1 OR name IS NULL
        UNION ALL SELECT DISTINCT name, i, CASE i WHEN 0 THEN name WHEN 1 THEN 'Object' WHEN 2 THEN 'Kernel' ELSE 'BasicObject' END,
          CASE i WHEN 0 THEN 'self' ELSE 'default' END, 'instance_method'
        FROM types, (VALUES (0), (1), (2), (3)) v(i) WHERE name LIKE '::N%'
        UNION ALL SELECT name, 0, name, 'self', 'instance_method' FROM types WHERE kind = 'module'
        UNION ALL SELECT '::M' || n_nationkey, 1, '::M' || (n_nationkey - 10), 'include', 'instance_method'
        FROM nation WHERE n_nationkey >= 20""",
    "o_tail_s": """
        SELECT * FROM (VALUES (0, 'Object', 'singleton_of', 'singleton_method', false),
          (1, 'BasicObject', 'singleton_of', 'singleton_method', false), (2, 'Class', 'class_object', 'instance_method', false),
          (3, 'Module', 'class_object', 'instance_method', true), (4, 'Object', 'class_object', 'instance_method', true),
          (5, 'Kernel', 'class_object', 'instance_method', true), (6, 'BasicObject', 'class_object', 'instance_method', true))
          v(i, name, origin, decl_side, for_module)""",
    "o_walk_s": """
        SELECT root, d, 1 AS a, 0 AS b, '::K' || k AS name, CASE WHEN d = 0 THEN 'self' ELSE 'superclass' END AS origin FROM o_sup
        UNION ALL SELECT root, d, 2, 0, '::M' || ((c_nationkey + 3) % 25), 'extend'
        FROM o_sup JOIN customer ON k = c_custkey WHERE k % 4 = 0
        UNION ALL SELECT root, d, 2, 1, '::M' || ((c_nationkey + 3) % 25 - 10), 'include'
        FROM o_sup JOIN customer ON k = c_custkey WHERE k % 4 = 0 AND (c_nationkey + 3) % 25 >= 20
        UNION ALL SELECT root, d, 3, 0, '::M' || c_nationkey || '::ClassMethods', 'extend'
        FROM o_sup JOIN customer ON k = c_custkey WHERE c_nationkey % 8 = 0
        UNION ALL SELECT root, d, 4, 0, '::M' || ((c_nationkey + 7) % 25) || '::ClassMethods', 'extend'
        FROM o_sup JOIN customer ON k = c_custkey WHERE k % 5 = 0 AND ((c_nationkey + 7) % 25) % 8 = 0
        UNION ALL SELECT root, d, 9, 0, NULL, 'superclass' FROM o_sup WHERE k % 97 = 50
        UNION ALL SELECT root, d, 20, i, name, origin FROM o_sup, o_tail_s WHERE k = 0""",
    "o_mixed_s": """
        SELECT *, row_number() OVER (PARTITION BY root, name, origin IN ('extend', 'include') ORDER BY d, a, b) AS v
        FROM o_walk_s""",
    "o_sided_s": """
        SELECT *, CASE WHEN origin IN ('extend', 'class_object') THEN 'instance_method' ELSE 'singleton_method' END AS decl_side
        FROM o_mixed_s WHERE v = 1 OR name IS NULL OR a = 20""",
    "o_seen_s": """
        SELECT *, row_number() OVER (PARTITION BY root, name, decl_side ORDER BY d, a, b) AS r FROM o_sided_s""",
    "chain_s": """
        SELECT '::K' || root AS owner, row_number() OVER (PARTITION BY root ORDER BY d, a, b) - 1 AS pos, name, origin, decl_side
        FROM o_seen_s WHERE r = 1 OR name IS NULL
        UNION ALL SELECT DISTINCT name, 0, name, 'self', 'singleton_method' FROM types WHERE name NOT LIKE '::K%'
        UNION ALL SELECT DISTINCT t.name, i + 1, v.name, v.origin, v.decl_side FROM types t, o_tail_s v WHERE t.name LIKE '::N%'
        UNION ALL SELECT t.name, i - 2, v.name, v.origin, v.decl_side FROM types t, o_tail_s v WHERE t.kind = 'module' AND v.for_module""",
}


def _words(sql: str) -> set[str]:
    return set(re.findall(r"[a-z_0-9]+", sql))


def needed(sql: str, tables: dict[str, str], skip: str = "") -> list[str]:
    """Derived tables a text refers to, dependencies first."""
    found: list[str] = []
    words = _words(sql)
    for name, body in tables.items():
        if name in words and name != skip:
            for dep in needed(body, tables, name):
                if dep not in found:
                    found.append(dep)
            if name not in found:
                found.append(name)
    return found


def with_facts(sql: str, check: bool = True) -> str:
    """``sql`` with the derived tables it uses in front of it."""
    tables = {**FACT_SQL, **CHECK_SQL} if check else FACT_SQL
    ctes = [f"{name} AS ({tables[name]})" for name in needed(sql, tables)]
    if not ctes:
        return sql
    head = "WITH RECURSIVE " if check else "WITH "
    body = re.sub(r"^WITH(\s+RECURSIVE)?\b", "", sql.strip(), flags=re.I) if re.match(r"(?i)\s*WITH\b", sql) else None
    return head + ", ".join(ctes) + (", " + body if body is not None else " " + sql)


# Derived tables that several queries share are built once per data directory
# and read back from the checkpoint folder afterwards.
_DERIVED: dict[tuple[str, str, str], object] = {}


def forget_derived() -> None:
    """Drop the shared tables, so that the next query pays for its own."""
    _DERIVED.clear()


class Facts:
    """Base and derived tables of one data directory as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return table(self.spark, self.sf_dir, name)
        return self.sql(FACT_SQL[name])

    def derived(self, name: str, build):
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _DERIVED:
            _DERIVED[key] = build()
        return _DERIVED[key]

    def has_derived(self, name: str) -> bool:
        return (self.spark.sparkContext.applicationId, self.sf_dir, name) in _DERIVED

    def sql(self, text: str) -> DataFrame:
        """Run a text over the base tables and any derived ones it names."""
        full = with_facts(text, check=False)
        for base in BASE_TABLES:
            if base in _words(full):
                table(self.spark, self.sf_dir, base).createOrReplaceTempView(base)
        return self.spark.sql(full)
