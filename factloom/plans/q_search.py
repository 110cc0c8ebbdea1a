"""Search, completion and positional queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import names as N
from factloom.operators import references as R
from factloom.operators import search as S
from factloom.plans.registry import query

_QUERIES = "SELECT DISTINCT split_part(p_name, ' ', 1) AS text FROM part UNION SELECT 'R' || lower(p_type) FROM part UNION SELECT lower('K1') UNION SELECT 'g'"
_SYMBOLS = """SELECT kind, owner, name, uri, line, col FROM declarations
  UNION ALL SELECT kind, NULL, name, uri, line, CAST(0 AS BIGINT) FROM types"""


def _q(f):
    return f.sql(_QUERIES).select(F.col("text").alias("qid"), "text")


@query(
    "g1_workspace_symbol_search",
    f"""WITH q AS ({_QUERIES}), s AS (SELECT *, lower(string_split(name, '::')[-1]) AS k FROM ({_SYMBOLS})),
    r AS (SELECT q.text AS qid, s.*, row_number() OVER (PARTITION BY q.text ORDER BY CASE WHEN k = lower(q.text) THEN 0 ELSE 1 END, name, uri, line, col, kind, coalesce(owner, '')) AS rank
      FROM q JOIN s ON contains(k, lower(q.text)))
    SELECT qid, rank, name, uri, line, col, kind, owner FROM r WHERE rank <= 100""",
)
def workspace_symbol_search(f):
    return S.workspace_search(_q(f), f.sql(_SYMBOLS))


@query(
    "g2_prefix_search",
    f"""WITH q AS ({_QUERIES}), s AS (SELECT DISTINCT name, kind, owner, lower(string_split(name, '::')[-1]) AS k FROM ({_SYMBOLS}) WHERE kind IN ('class', 'module', 'instance_method')),
    r AS (SELECT q.text AS qid, s.*, row_number() OVER (PARTITION BY q.text ORDER BY CASE WHEN k = lower(q.text) THEN 0 ELSE 1 END, name, kind, coalesce(owner, '')) AS rank
      FROM q JOIN s ON starts_with(k, lower(q.text)))
    SELECT qid, rank, name, kind, owner FROM r WHERE rank <= 20""",
)
def prefix_search(f):
    return S.prefix_search(_q(f), f.sql(_SYMBOLS), ("class", "module", "instance_method"), 20)


@query(
    "g1_all_matches",
    f"""WITH q AS ({_QUERIES}), s AS (SELECT *, lower(string_split(name, '::')[-1]) AS k FROM ({_SYMBOLS}))
    SELECT q.text AS qid, k = lower(q.text) AS exact, name, uri, line, col, kind, owner FROM q JOIN s ON contains(k, lower(q.text))""",
)
def workspace_matches(f):
    return S.workspace_matches(_q(f), f.sql(_SYMBOLS))


@query(
    "g2_all_matches",
    f"""WITH q AS ({_QUERIES}), s AS (SELECT DISTINCT name, kind, owner, lower(string_split(name, '::')[-1]) AS k FROM ({_SYMBOLS}) WHERE kind IN ('class', 'module', 'instance_method'))
    SELECT q.text AS qid, k = lower(q.text) AS exact, name, kind, owner FROM q JOIN s ON starts_with(k, lower(q.text))""",
)
def prefix_matches(f):
    return S.prefix_matches(_q(f), f.sql(_SYMBOLS), ("class", "module", "instance_method"))


_ITEMS = """SELECT 'k' || l_suppkey AS qid, replace(p_name, ' ', '_') AS label, 'method' AS kind, 1 AS grp FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT 'k' || l_suppkey, 'v' || (l_partkey % 7), 'variable', 0 FROM lineitem
  UNION ALL SELECT 'k' || l_suppkey, 'K' || (l_partkey % 11), 'class', 2 FROM lineitem
  UNION ALL SELECT 'k' || l_suppkey, CASE WHEN l_linenumber = 1 THEN 'v1' ELSE 'puts' END, 'function', 3 FROM lineitem"""


@query(
    "g4_prefix_completion",
    f"""WITH d AS (SELECT qid, label, kind IN ('method', 'function') AS callable, min(grp) AS grp, arg_min(kind, grp) AS kind FROM ({_ITEMS}) GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grp, label, callable) AS rank, count(*) OVER (PARTITION BY qid) AS n FROM d)
    SELECT qid, label, kind, grp AS "group", rank, n > 50 AS incomplete FROM r WHERE rank <= 50""",
)
def prefix_completion(f):
    return S.prefix_completion(f.sql(_ITEMS).withColumnRenamed("grp", "group"))


@query(
    "g5_find_by_simple_name",
    """WITH q AS (SELECT DISTINCT 'C' || (c_custkey % 40) AS text FROM customer)
    SELECT q.text AS qid, name, kind, uri, line FROM q JOIN types ON string_split(name, '::')[-1] = q.text""",
)
def find_by_simple_name(f):
    asked = f.sql("SELECT DISTINCT 'C' || (c_custkey % 40) AS text FROM customer").withColumn("qid", F.col("text"))
    return S.find_by_simple_name(asked, f["types"])


_RANGES = """SELECT 'o' || o_custkey AS uri, o_orderkey AS rid, o_orderkey % 500 AS sl, CAST(3 AS BIGINT) AS sc,
  o_orderkey % 500 + CAST(floor(o_totalprice / 5000.0) AS BIGINT) AS el, CAST(9 AS BIGINT) AS ec FROM orders"""
_POSITIONS = """SELECT 'o' || o_custkey AS uri, o_orderkey AS pid, (o_orderkey * 7) % 600 AS line, o_orderkey % 13 AS col FROM orders"""


@query(
    "g6_innermost_range",
    f"""SELECT p.uri, p.pid, arg_min(r.rid, [el - sl, ec - sc, r.rid]) AS rid FROM ({_POSITIONS}) p JOIN ({_RANGES}) r ON p.uri = r.uri
      AND (p.line > sl OR (p.line = sl AND p.col >= sc)) AND (p.line < el OR (p.line = el AND p.col <= ec)) GROUP BY 1, 2""",
)
def innermost_range(f):
    return S.innermost_range(f.sql(_POSITIONS), f.sql(_RANGES))


_TOKENS = "SELECT DISTINCT 's' || (l_suppkey % 20) AS uri, CAST(floor(l_orderkey / 2.0) AS BIGINT) AS line, l_partkey AS col FROM lineitem"


@query(
    "g7_delta_encode_positions",
    f"""WITH t AS ({_TOKENS}), p AS (SELECT *, coalesce(lag(line) OVER w, 0) AS pl, coalesce(lag(col) OVER w, 0) AS pc FROM t WINDOW w AS (PARTITION BY uri ORDER BY line, col))
    SELECT uri, line, col, line - pl AS delta_line, CASE WHEN line = pl THEN col - pc ELSE col END AS delta_col FROM p""",
)
def delta_encode_positions(f):
    return S.delta_encode(f.sql(_TOKENS))


_OPS = """SELECT 'u' || user_id AS key, event_id AS ord, CASE WHEN event_type = 'error' THEN 'skip' ELSE 'add' END AS verb, 'cb' || (event_id % 5) AS name,
  CASE WHEN value < 5 THEN 'excluded' WHEN value < 15 THEN 'unresolved' ELSE 'applicable' END AS selector FROM events"""


@query(
    "g9_callback_replay",
    f"""WITH o AS (SELECT * FROM ({_OPS}) WHERE selector <> 'excluded' AND NOT (verb = 'add' AND selector = 'unresolved'))
    SELECT key, name, ord FROM o a WHERE verb = 'add' AND NOT EXISTS (SELECT 1 FROM o s WHERE s.verb = 'skip' AND s.key = a.key AND s.name = a.name AND s.ord > a.ord)""",
)
def callback_replay(f):
    return S.callback_replay(f.sql(_OPS))


@query(
    "e12_symbol_fanout",
    "SELECT lower(name) AS key, count(*) AS n_sites, count(DISTINCT kind || owner || name) AS n_symbols FROM declarations GROUP BY 1",
)
def symbol_fanout(f):
    return R.symbol_fanout(f["declarations"], N.simple_name_key("name"))
