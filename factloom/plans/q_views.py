"""Views, reconciliations and registers."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import reconcile as R
from factloom.operators import rules as I
from factloom.operators import text_audit as A
from factloom.operators import views as V
from factloom.plans.facts import CHECK_SQL
from factloom.plans.q_hierarchy import chain
from factloom.plans.q_lookup import heads
from factloom.plans.q_text import _INVENTORY
from factloom.plans.registry import query

_VIEW_FILES = "SELECT 'app/views/shop/k' || c_custkey || '/show.html.erb' AS view_uri FROM customer UNION ALL SELECT 'app/other/x' || c_custkey || '.erb' FROM customer"
_CONTROLLERS = """SELECT 'Shop::K' || c_custkey || 'Controller' AS name, 'class' AS kind, 'app/controllers/' || (c_custkey + v) || '.rb' AS uri
  FROM (SELECT c_custkey, 0 AS v FROM customer UNION ALL SELECT c_custkey, 7 FROM customer) x WHERE c_custkey % 3 <> 0"""


@query(
    "c25_view_controller_join",
    """SELECT 'app/views/shop/k' || c_custkey || '/show.html.erb' AS view_uri, '::Shop::K' || c_custkey || 'Controller' AS owner, 'show' AS action,
      'shop/k' || c_custkey || '/show' AS view_key, least('app/controllers/' || c_custkey || '.rb', 'app/controllers/' || (c_custkey + 7) || '.rb') AS controller_uri
    FROM customer WHERE c_custkey % 3 <> 0""",
)
def view_controller_join(f):
    return V.view_controllers(f.sql(_VIEW_FILES), f.sql(_CONTROLLERS))


# Every class serves one view, named after a part; some methods render it.
_VIEWS = """SELECT 'v' || c_custkey AS view_uri, '::K' || c_custkey AS owner, replace(p_name, ' ', '_') AS action, 'k' || c_custkey || '/' || replace(p_name, ' ', '_') AS view_key
  FROM customer JOIN part ON p_partkey = c_custkey"""
_RENDERS = """SELECT DISTINCT owner, name, CASE WHEN line % 3 = 0 THEN '/k' || line || '/' || name WHEN line % 3 = 1 THEN 'hot_rod' ELSE 'other' END AS target
  FROM (SELECT owner, name, min(line) AS line FROM declarations WHERE kind = 'instance_method' GROUP BY owner, name) d"""
CHECK_SQL["o_actions"] = f"""
        SELECT DISTINCT view_uri, x.name AS action FROM ({_VIEWS}) v JOIN (
          SELECT c.owner AS root, h.name, h.owner, h.visibility, row_number() OVER (PARTITION BY c.owner, h.name ORDER BY c.pos) AS k
          FROM chain_i c JOIN o_heads h ON h.owner = c.name AND h.kind = 'instance_method'
          WHERE c.origin IN ('self', 'superclass') AND c.name LIKE '::K%') x ON x.root = v.owner AND k = 1 AND visibility = 'public'
        LEFT JOIN ({_RENDERS}) r ON r.owner = x.owner AND r.name = x.name
        WHERE x.name = v.action OR CASE WHEN contains(r.target, '/') THEN ltrim(r.target, '/') = v.view_key ELSE r.target = v.action END"""


def actions(f):
    return V.contributing_actions(f.sql(_VIEWS), chain(f), heads(f), f.sql(_RENDERS))


@query("c26_contributing_actions", "SELECT view_uri, action FROM o_actions")
def contributing_actions(f):
    return actions(f)


_ENVS = """SELECT 'v' || (l_suppkey % 30) AS view_uri, 'a' || (l_partkey % 4) AS action, CASE WHEN l_linenumber = 7 THEN NULL ELSE '@i' || ((l_partkey + l_linenumber) % 9) END AS ivar,
  CASE l_linenumber % 3 WHEN 0 THEN 'User' WHEN 1 THEN 'String' ELSE 'nil' END AS type FROM lineitem WHERE l_partkey % 4 <> 3 OR l_linenumber IN (1, 7)"""


@query(
    "e9_merge_ivar_environments",
    f"""WITH e AS ({_ENVS}), a AS (SELECT view_uri, count(DISTINCT action) AS n FROM e GROUP BY 1),
    h AS (SELECT view_uri, ivar, count(DISTINCT action) AS have FROM e WHERE ivar IS NOT NULL GROUP BY 1, 2),
    t AS (SELECT view_uri, ivar, type FROM e WHERE ivar IS NOT NULL UNION SELECT h.view_uri, ivar, 'nil' FROM h JOIN a USING (view_uri) WHERE have < n)
    SELECT view_uri, ivar, string_agg(type, ' | ' ORDER BY type) AS type FROM t GROUP BY 1, 2""",
)
def merge_ivar_environments(f):
    return V.merge_environments(f.sql(_ENVS))


_WRITES = """SELECT 'v' || (o_custkey % 500) AS uri, '@v' || (o_orderkey % 9) AS name, o_orderkey % 3 AS part FROM orders"""


@query(
    "h4_assigned_union",
    f"""SELECT DISTINCT uri, name FROM ({_WRITES}) WHERE part < 2 UNION SELECT DISTINCT NULL, name FROM ({_WRITES}) WHERE part = 2""",
)
def assigned_union(f):
    w = f.sql(_WRITES)
    return V.assigned_union(w.filter("part = 0"), w.filter("part = 1"), w.filter("part = 2"))


_READS = """SELECT 'v' || (l_suppkey % 90) AS uri, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS col, '@v' || (l_partkey % 40) AS name FROM lineitem"""
_GATES = """SELECT 'v' || c_custkey AS uri, c_custkey % 7 = 0 AS dynamic, c_custkey % 11 <> 0 AS chain_read, c_custkey % 13 <> 0 AS declared_once, c_custkey % 17 = 0 AS mixed_in,
  c_custkey % 19 = 0 AS odd_call, c_custkey % 5 = 4 AS renders, CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE 1 END AS n_actions FROM customer"""
_LOCAL = "SELECT DISTINCT 'v' || (o_custkey % 90) AS uri, '@v' || (o_orderkey % 20) AS name, o_orderkey % 3 AS part FROM orders WHERE o_custkey % 4 = 0"


@query(
    "i7_unassigned_ivar",
    f"""WITH g AS (SELECT uri FROM ({_GATES}) WHERE NOT dynamic AND chain_read AND declared_once AND NOT mixed_in AND NOT odd_call AND NOT renders AND n_actions > 0)
    SELECT r.uri, line, col, 'unassigned-ivar' AS code, '`' || r.name || '` is never assigned before this is read' AS message, 'warning' AS severity, 'high' AS confidence
    FROM ({_READS}) r JOIN g ON g.uri = r.uri WHERE NOT EXISTS (SELECT 1 FROM ({_LOCAL}) l WHERE l.uri = r.uri AND l.name = r.name)""",
)
def unassigned_ivar(f):
    calls = F.when(F.col("odd_call"), F.array(F.lit("helper_method"))).otherwise(F.array(F.lit("before_action")))
    gates = V.computable_views(f.sql(_GATES).withColumn("unmodelled_calls", calls))
    w = f.sql(_LOCAL)
    return I.unassigned_ivars(f.sql(_READS), gates, w.filter("part = 0"), w.filter("part = 1"), w.filter("part = 2"))


@query(
    "i7_computable_views",
    f"SELECT uri, coalesce(NOT dynamic AND chain_read AND declared_once AND NOT mixed_in AND NOT odd_call AND NOT renders AND n_actions > 0, false) AS computable FROM ({_GATES})",
)
def computable_views(f):
    calls = F.when(F.col("odd_call"), F.array(F.lit("helper_method"))).otherwise(F.array(F.lit("before_action")))
    return V.computable_views(f.sql(_GATES).withColumn("unmodelled_calls", calls))


# --- reconciliations ------------------------------------------------------------------

_LEFT = "SELECT DISTINCT o_custkey AS k, o_orderpriority AS p FROM orders WHERE o_orderstatus <> 'F'"
_RIGHT = "SELECT DISTINCT o_custkey AS k, o_orderpriority AS p FROM orders WHERE o_orderstatus <> 'O'"


@query(
    "c28_inventory_reconcile",
    f"""SELECT coalesce(l.k, r.k) AS k, coalesce(l.p, r.p) AS p, CASE WHEN r.k IS NULL THEN 'missing' WHEN l.k IS NULL THEN 'extra' ELSE 'both' END AS status
    FROM ({_LEFT}) l FULL OUTER JOIN ({_RIGHT}) r ON l.k = r.k AND l.p = r.p""",
)
def inventory_reconcile(f):
    return R.inventory(f.sql(_LEFT), f.sql(_RIGHT), ["k", "p"])


@query(
    "h5_inventory_except",
    f"SELECT *, 'left' AS side FROM ({_LEFT} EXCEPT {_RIGHT}) UNION ALL SELECT *, 'right' FROM ({_RIGHT} EXCEPT {_LEFT})",
)
def inventory_except(f):
    return R.inventory_except(f.sql(_LEFT), f.sql(_RIGHT), ["k", "p"])


@query(
    "h2_names_except",
    """SELECT DISTINCT owner, name FROM declarations d WHERE kind = 'instance_method'
      AND NOT EXISTS (SELECT 1 FROM declarations b WHERE b.kind = 'instance_method' AND b.owner = '::K0' AND b.name = d.name)""",
)
def names_except(f):
    methods = f["declarations"].filter("kind = 'instance_method'")
    base = methods.filter("owner = '::K0'").select("name").distinct()
    return methods.select("owner", "name").distinct().join(base, "name", "left_anti").select("owner", "name")


# Recorded verdicts: one per document for the first site, some of them wrong.
_VERDICTS = """SELECT 'lib/' || source || '/d' || doc_id || '.rb#m' || (doc_id % 3) || CASE doc_id % 7 WHEN 6 THEN '[9]' ELSE '' END AS key,
  CASE doc_id % 5 WHEN 0 THEN 'surfaces' WHEN 1 THEN 'contained: caller checks' WHEN 2 THEN 'swallows' WHEN 3 THEN 'ignored' ELSE 'surfaces: logged' END AS verdict FROM documents"""


@query(
    "c29_verdict_reconcile",
    f"""WITH {_INVENTORY}, v AS ({_VERDICTS})
    SELECT coalesce(s.key, v.key) AS key, split_part(verdict, ':', 1) AS kind, CASE WHEN s.key IS NULL THEN 'stale' WHEN verdict IS NULL THEN 'missing'
      WHEN split_part(verdict, ':', 1) NOT IN ('surfaces', 'contained', 'swallows') THEN 'invalid' WHEN verdict LIKE 'swallows%' THEN 'disallowed' ELSE 'ok' END AS status
    FROM sites s FULL OUTER JOIN v ON s.key = v.key""",
)
def verdict_reconcile(f):
    return R.verdicts(A.site_inventory(f["source_files"]), f.sql(_VERDICTS))


_TEXT_DOCS = """SELECT doc_id AS doc, '# t' || chr(10) || '| Feature | a | b | c |' || chr(10) || '|---|---|---|---|' || chr(10)
  || '| `Go to` def ' || doc_id || ' | ✅ | ⚠️ [^n] | 1.2.' || (doc_id % 5) || ' |' || chr(10) || '| Rename / move | ✅ | — | ✅ |' || chr(10)
  || CASE WHEN doc_id % 4 = 0 THEN '| Only text | ✅ | ✅ | ✅ |' || chr(10) ELSE '' END || text AS text FROM documents"""
_PAGE_DOCS = """SELECT doc_id AS doc, '<table><tr data-status="x"><td>Go to def ' || doc_id || '</td><td class="col-status"><i class="mark--yes"></i></td><td class="col-status"><i class="mark--warn"></i></td>'
  || '<td class="col-status"><i class="mark--plan"></i>1.2.' || (doc_id % 3) || '</td></tr>' || chr(10) || '<tr> <td><b>Rename</b>/move<small>x</small></td><td class="col-status"><i class="mark--yes"></i></td>'
  || '<td class="col-status"><i class="mark--none"></i></td><td class="col-status"><i class="mark--yes"></i></td></tr>'
  || CASE WHEN doc_id % 6 = 1 THEN '<tr><td>Only page</td><td class="col-status"><i class="mark--yes"></i></td><td class="col-status"></td><td class="col-status"></td></tr>' ELSE '' END
  || '</table>' || text AS text FROM documents"""


@query(
    "c34_matrix_parity",
    """SELECT doc_id AS doc, 'go to def ' || doc_id AS feature, 'verified,unverified,planned:1.2.' || (doc_id % 5) AS left_status, 'verified,unverified,planned:1.2.' || (doc_id % 3) AS right_status,
      'different' AS problem FROM documents WHERE doc_id % 5 <> doc_id % 3
    UNION ALL SELECT doc_id, 'only text', 'verified,verified,verified', NULL, 'missing' FROM documents WHERE doc_id % 4 = 0
    UNION ALL SELECT doc_id, 'only page', NULL, 'verified,?,?', 'extra' FROM documents WHERE doc_id % 6 = 1""",
)
def matrix_parity(f):
    return R.matrix_parity(R.text_matrix(f.sql(_TEXT_DOCS)), R.page_matrix(f.sql(_PAGE_DOCS)))


_ROADMAPS = """SELECT doc_id AS doc, '# Roadmap' || chr(10) || '## 1.0.' || (doc_id % 4) || ' - next' || chr(10) || '- a' || chr(10) || '- b' || chr(10) || text || chr(10) || '## later' || chr(10) || '- x' || chr(10)
  || '## 2.1.0' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '- only' ELSE 'none' END AS text FROM documents"""


@query(
    "c34_version_counts",
    """SELECT doc_id AS doc, '1.0.' || (doc_id % 4) AS version, 2 + len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '- '))) AS n FROM documents
    UNION ALL SELECT doc_id, '2.1.0', CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END FROM documents""",
)
def version_counts(f):
    return R.version_counts(f.sql(_ROADMAPS))


_REGISTERS = """SELECT doc_id AS doc, 'Legend' || chr(10) || '## 024.' || (doc_id % 90) || ' Broken ' || lang || ' thing!' || chr(10) || '```yaml' || chr(10) || 'status: open # maybe' || chr(10)
  || CASE WHEN doc_id % 2 = 0 THEN 'target: 0.3.' || (doc_id % 7) || chr(10) ELSE '' END || '```' || chr(10) || text || chr(10) || '## 024.R' || (doc_id % 12) || ' Plan: more' || chr(10) || 'no metadata' AS text FROM documents"""


@query(
    "e11_register_index",
    """SELECT doc_id AS doc, '024.' || (doc_id % 90) AS number, 'Broken ' || lang || ' thing!' AS title, 'open' AS status, CASE WHEN doc_id % 2 = 0 THEN '0.3.' || (doc_id % 7) ELSE '—' END AS release,
      '#024' || (doc_id % 90) || '-broken-' || lang || '-thing' AS anchor, false AS roadmap, doc_id % 90 AS ordinal FROM documents
    UNION ALL SELECT doc_id, '024.R' || (doc_id % 12), 'Plan: more', '?', '—', '#024R' || (doc_id % 12) || '-plan-more', true, doc_id % 12 FROM documents""",
)
def register_index(f):
    return R.register_index(f.sql(_REGISTERS), "024")
