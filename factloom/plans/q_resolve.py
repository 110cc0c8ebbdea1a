"""Type names and receivers."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import resolve as R
from factloom.plans.registry import query

# Written names of all four forms, one per order line.
_WRITTEN = """SELECT l_orderkey AS id, l_linenumber AS n, CASE l_partkey % 6 WHEN 0 THEN '::K' || l_partkey
  WHEN 1 THEN 'K' || l_partkey WHEN 2 THEN 'C' || (l_partkey % 50) WHEN 3 THEN 'N' || (l_partkey % 30) || '::C' || (l_partkey % 40)
  WHEN 4 THEN '::C' || (l_partkey % 40) ELSE 'M' || (l_partkey % 30) || '::ClassMethods' END AS name FROM lineitem"""
_T = "SELECT DISTINCT name, kind, string_split(name, '::')[-1] AS simple FROM types"
_RESOLVED = f"""WITH w AS (SELECT DISTINCT name FROM ({_WRITTEN})), t AS ({_T}),
  c AS (SELECT w.name AS w, t.name AS cand, t.kind AS k,
    CASE WHEN t.name = CASE WHEN w.name LIKE '::%' THEN w.name ELSE '::' || w.name END THEN 0
         WHEN w.name NOT LIKE '::%' AND contains(w.name, '::') AND t.name LIKE '%::' || w.name THEN 1
         WHEN NOT contains(w.name, '::') THEN 2 ELSE 9 END AS m
    FROM w JOIN t ON string_split(w.name, '::')[-1] = t.simple),
  r AS (SELECT w, cand, k, m, row_number() OVER (PARTITION BY w ORDER BY m, cand, k) AS n, count(*) OVER (PARTITION BY w) AS total,
    min(m) OVER (PARTITION BY w) AS best FROM c),
  a AS (SELECT w.name, CASE WHEN m < 9 THEN cand END AS resolved, CASE WHEN m < 9 THEN k END AS kind,
    CASE m WHEN 0 THEN 'exact' WHEN 1 THEN 'suffix' WHEN 2 THEN 'first' END AS match_class, coalesce(total, 0) AS total,
    coalesce(best, 9) AS best FROM w LEFT JOIN r ON r.w = w.name AND r.n = 1)"""


def _resolve(f):
    return R.resolve_types(f.sql(_WRITTEN), R.type_index(f["types"]))


@query("c1_resolve_type_name", f"{_RESOLVED} SELECT id, n, s.name, resolved, match_class FROM ({_WRITTEN}) s JOIN a ON a.name = s.name")
def resolve_type_name(f):
    return _resolve(f).select("id", "n", "name", "resolved", "match_class")


@query(
    "c2_ambiguous_type",
    f"""WITH t AS ({_T}) SELECT w.name, count(DISTINCT t.name) > 1 AND NOT contains(ltrim(w.name, ':'), '::') AS is_ambiguous
    FROM (SELECT DISTINCT name FROM ({_WRITTEN})) w LEFT JOIN t ON string_split(w.name, '::')[-1] = t.simple GROUP BY w.name""",
)
def ambiguous_type(f):
    return _resolve(f).select("name", "is_ambiguous").distinct()


@query(
    "c3_guessed_type",
    f"{_RESOLVED} SELECT name, total > 0 AND best > 0 AND (contains(ltrim(name, ':'), '::') OR total > 1) AS is_guessed FROM a",
)
def guessed_type(f):
    return _resolve(f).select("name", "is_guessed").distinct()


_NESTED = """SELECT c_custkey AS id, 'C' || (c_custkey % 40) AS name, '::N' || (c_nationkey + 1) AS f1, '::N' || c_nationkey AS f2 FROM customer"""


@query(
    "c4_nested_type_name",
    f"""WITH t AS (SELECT DISTINCT name FROM types) SELECT id, coalesce(a.name, b.name) AS nested FROM ({_NESTED}) n
    LEFT JOIN t a ON a.name = f1 || '::' || n.name LEFT JOIN t b ON b.name = f2 || '::' || n.name""",
)
def nested_type_name(f):
    written = f.sql(_NESTED).select("id", "name", F.array("f1", "f2").alias("nesting"))
    return R.resolve_nested(written, R.type_index(f["types"])).select("id", "nested")


@query("c5_type_kind", f"{_RESOLVED} SELECT kind, count(*) AS n FROM ({_WRITTEN}) s JOIN a ON a.name = s.name GROUP BY kind")
def type_kind(f):
    return _resolve(f).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_RECEIVERS = """SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS p, CASE l_partkey % 4 WHEN 0 THEN 'none' WHEN 3 THEN 'expression' ELSE 'constant' END AS receiver_form,
  CASE l_partkey % 4 WHEN 1 THEN 'C' || (l_partkey % 40) WHEN 2 THEN CASE WHEN l_partkey % 3 = 0 THEN '::' ELSE '' END || 'K' || l_partkey END AS receiver,
  '::N' || (l_suppkey % 25) AS owner, 'User' || l_suppkey AS inferred_type FROM lineitem"""


@query(
    "b20_receiver_type",
    f"""WITH t AS (SELECT DISTINCT name FROM types) SELECT id, n, p, CASE receiver_form WHEN 'none' THEN owner WHEN 'expression' THEN inferred_type
      ELSE coalesce(CASE WHEN receiver LIKE '::%' THEN receiver END, a.name, b.name, receiver) END AS receiver_type FROM ({_RECEIVERS}) r
    LEFT JOIN t a ON a.name = r.owner || '::' || r.receiver LEFT JOIN t b ON b.name = '::' || r.receiver""",
)
def receiver_type(f):
    calls = f.sql(_RECEIVERS).withColumn("nesting", F.array("owner"))
    return R.constant_receivers(calls, R.type_index(f["types"])).select("id", "n", "p", "receiver_type")
