"""Traces, evidence and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import traces as T
from factloom.plans.facts import CHECK_SQL
from factloom.plans.registry import query
from factloom.session import durable
from factloom.streaming import jobs

CHECK_SQL.update({
    "o_step": "SELECT *, row_number() OVER (PARTITION BY fiber ORDER BY seq) AS n FROM trace_events",
    # One row per fiber and step: the stack as lists of keys, places and epochs.
    "o_machine": """
        SELECT DISTINCT fiber, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS ks, CAST([] AS BIGINT[]) AS ss, CAST([] AS BIGINT[]) AS es,
          CAST(0 AS BIGINT) AS epoch, CAST(NULL AS BIGINT) AS call_seq, CAST(NULL AS BIGINT) AS return_seq, CAST(NULL AS BOOLEAN) AS raised, CAST(NULL AS VARCHAR) AS key
        FROM trace_events
        UNION ALL
        SELECT m.fiber, s.n,
          CASE WHEN event = 'call' THEN list_append(ks, call_key) WHEN event = 'return' AND ks[-1] = call_key THEN ks[1:-2] ELSE ks END,
          CASE WHEN event = 'call' THEN list_append(ss, seq) WHEN event = 'return' AND ks[-1] = call_key THEN ss[1:-2] ELSE ss END,
          CASE WHEN event = 'call' THEN list_append(es, epoch) WHEN event = 'return' AND ks[-1] = call_key THEN es[1:-2] ELSE es END,
          epoch + CASE WHEN event = 'raise' THEN 1 ELSE 0 END,
          CASE WHEN event = 'return' AND ks[-1] = call_key THEN ss[-1] END, CASE WHEN event = 'return' THEN seq END,
          CASE WHEN event = 'return' AND ks[-1] = call_key THEN epoch > es[-1] END, CASE WHEN event = 'return' THEN call_key END
        FROM o_machine m JOIN o_step s ON s.fiber = m.fiber AND s.n = m.n + 1""",
    "o_pairs": """
        SELECT fiber, key AS call_key, call_seq, return_seq, raised, CASE WHEN call_seq IS NULL THEN 'ignored' ELSE 'paired' END AS status
        FROM o_machine WHERE return_seq IS NOT NULL
        UNION ALL SELECT fiber, call_key, seq, NULL, NULL, 'open' FROM trace_events WHERE event = 'call'
          AND (fiber, seq) NOT IN (SELECT fiber, call_seq FROM o_machine WHERE call_seq IS NOT NULL)""",
    "o_samples": """
        SELECT '::U' || (p.fiber % 10) || '#' || p.call_key AS symbol, p.call_seq, c.arg_type, 'f' || (p.call_seq % 3) AS fingerprint,
          CASE WHEN r.return_type IS NOT NULL THEN r.return_type WHEN NOT raised THEN 'nil' END AS return_type
        FROM o_pairs p JOIN trace_events c ON c.fiber = p.fiber AND c.seq = p.call_seq
        JOIN trace_events r ON r.fiber = p.fiber AND r.seq = p.return_seq WHERE status = 'paired'""",
    "o_observed": """
        SELECT symbol, string_agg(DISTINCT arg_type, ' | ' ORDER BY arg_type) AS parameter_types,
          coalesce(string_agg(DISTINCT return_type, ' | ' ORDER BY return_type), 'Unknown') AS return_type, count(*) AS samples,
          arg_min(fingerprint, call_seq) AS fingerprint FROM o_samples GROUP BY symbol""",
})


def events(f):
    return f["trace_events"].select(
        "fiber", "seq", "event", "call_key", F.col("arg_type").alias("call_payload"), F.col("return_type").alias("return_payload")
    )


def pairs(f):
    return f.derived("pairs", lambda: durable(T.pair_calls(events(f))))


def samples(f):
    return pairs(f).filter("status = 'paired'").select(
        F.concat(F.lit("::U"), (F.col("fiber") % 10).cast("string"), F.lit("#"), "call_key").alias("symbol"), "call_seq",
        F.array("call_payload").alias("arg_types"), F.concat(F.lit("f"), (F.col("call_seq") % 3).cast("string")).alias("fingerprint"),
        T.counted_return(F.col("return_payload"), F.col("raised")).alias("return_type"),
    )


def observed(f):
    return f.derived("observed", lambda: durable(T.observed_signatures(samples(f))))


def _flat(df):
    return df.withColumn("parameter_types", F.array_join("parameter_types", ","))


@query("s1_call_return_pairing", "SELECT fiber, call_key, call_seq, return_seq, status FROM o_pairs")
def call_return_pairing(f):
    return T.pair_calls(events(f)).select("fiber", "call_key", "call_seq", "return_seq", "status")


@query(
    "s1_call_depth",
    "SELECT m.fiber, s.seq AS call_seq, len(ks) AS depth FROM o_machine m JOIN o_step s ON s.fiber = m.fiber AND s.n = m.n WHERE s.event = 'call'",
)
def call_depth(f):
    return T.call_depth(pairs(f), bucket=1000)


@query("s2_raise_epoch", "SELECT fiber, call_seq, return_seq, raised FROM o_pairs WHERE status = 'paired'")
def raise_epoch(f):
    return pairs(f).filter("status = 'paired'").select("fiber", "call_seq", "return_seq", "raised")


@query(
    "s2_running_epoch",
    "SELECT fiber, seq, count(*) FILTER (event = 'raise') OVER (PARTITION BY fiber ORDER BY seq) AS epoch FROM trace_events",
)
def running_epoch(f):
    return T.epoch_of(f["trace_events"], bucket=1000).select("fiber", "seq", "epoch")


_RESULTS = """SELECT 'u' || user_id AS uri, event_id AS arrival, CAST(floor(event_id / 2500.0) AS BIGINT) - CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS buffer_id,
  CAST(floor(event_id / 400.0) AS BIGINT) + CAST(floor(value / 30.0) AS BIGINT) AS version,
  CASE WHEN event_id % 5 > 0 THEN CAST(floor(value) AS BIGINT) % 7 END AS generation FROM events"""


@query(
    "s3_publish_latest",
    f"""WITH r AS ({_RESULTS}), o AS (SELECT *, max(buffer_id) OVER (PARTITION BY uri ORDER BY arrival) AS op,
      max(version * 1000 + coalesce(generation + 1, 0)) OVER (PARTITION BY uri, buffer_id ORDER BY arrival) AS best FROM r)
    SELECT uri, arrival, buffer_id, version, generation FROM o WHERE buffer_id = op
      AND version = CAST(floor(best / 1000.0) AS BIGINT) AND (generation IS NULL OR version * 1000 + generation + 1 = best)""",
)
def publish_latest(f):
    return T.publish_latest(f.sql(_RESULTS), bucket=1000)


# Buffers of forty files: a signup opens one (its number and first version are the
# event), a purchase edits it, an error closes it; clicks and views are results, some
# of an older version, a version to come, another buffer, or from disk.
_LINE = """SELECT uri, seq, kind, CASE kind WHEN 'open' THEN seq WHEN 'result' THEN CASE WHEN seq % 11 = 0 THEN opened - 1 ELSE opened END END AS buffer_id,
    CASE WHEN kind IN ('open', 'edit') THEN seq WHEN kind = 'result' AND seq % 5 > 0 THEN CASE WHEN seq % 7 = 0 THEN edited + 1 WHEN seq % 3 = 0 THEN opened ELSE edited END END AS version,
    CASE WHEN kind = 'result' AND seq % 6 > 0 THEN CAST(floor(value) AS BIGINT) % 7 END AS generation
  FROM (SELECT uri, seq, kind, value, max(CASE WHEN kind = 'open' THEN seq END) OVER (PARTITION BY uri ORDER BY seq) AS opened,
      max(CASE WHEN kind IN ('open', 'edit') THEN seq END) OVER (PARTITION BY uri ORDER BY seq) AS edited
    FROM (SELECT 'u' || (user_id % 40) AS uri, event_id AS seq, value, CASE event_type WHEN 'signup' THEN 'open' WHEN 'purchase' THEN 'edit'
        WHEN 'error' THEN 'close' ELSE 'result' END AS kind FROM events) e) l"""
CHECK_SQL.update({
    "o_line": f"SELECT *, row_number() OVER (PARTITION BY uri ORDER BY seq) AS n FROM ({_LINE})",
    # The state of a file after each step: open buffer and version, and what was shown last.
    "o_file": """
        SELECT DISTINCT uri, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS ob, CAST(NULL AS BIGINT) AS ov, CAST(NULL AS BIGINT) AS lb,
          CAST(NULL AS BIGINT) AS lv, CAST(NULL AS BIGINT) AS lg, false AS shown FROM o_line
        UNION ALL
        SELECT uri, n, CASE kind WHEN 'open' THEN buffer_id WHEN 'close' THEN NULL ELSE ob END,
          CASE WHEN kind IN ('open', 'edit') THEN version ELSE ov END,
          CASE WHEN kind = 'close' THEN NULL WHEN take THEN buffer_id ELSE lb END, CASE WHEN kind = 'close' THEN NULL WHEN take THEN version ELSE lv END,
          CASE WHEN kind = 'close' THEN NULL WHEN take THEN coalesce(generation, lg) ELSE lg END, take OR (kind = 'result' AND version IS NULL AND ob IS NULL)
        FROM (SELECT l.*, ob, ov, lb, lv, lg, kind = 'result' AND coalesce(buffer_id = ob AND version <= ov, false) AND NOT coalesce(buffer_id = lb AND version < lv, false)
              AND NOT coalesce(buffer_id = lb AND version = lv AND generation < lg, false) AS take
          FROM o_file f JOIN o_line l ON l.uri = f.uri AND l.n = f.n + 1)""",
})
_SHOWN = "SELECT l.uri, l.seq, l.buffer_id, l.version, l.generation FROM o_file f JOIN o_line l ON l.uri = f.uri AND l.n = f.n WHERE shown"


@query("s3_publish_open_buffers", _SHOWN)
def publish_open_buffers(f):
    line = f.sql(_LINE)
    return T.publish_open(line.filter("kind = 'result'"), line.filter("kind <> 'result'"), bucket=1000)


@query("s3_publish_stream", _SHOWN)
def publish_stream(f):
    """The same answer from a stream over the buffers' line."""
    line = durable(f.sql(_LINE))
    return jobs.publish_table(f.spark.readStream.schema(line.schema).parquet(line.inputFiles()[0].rsplit("/", 1)[0]))


_CHANGES = "SELECT 'u' || user_id AS uri, ts, event_id AS version FROM events"


@query(
    "s4_coalesce_changes",
    f"""WITH c AS ({_CHANGES}), l AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY uri ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM c),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY uri ORDER BY ts) AS k FROM l)
    SELECT uri, min(ts) AS first_ts, count(*) AS n, max(version) AS version FROM s GROUP BY uri, k""",
)
def coalesce_changes(f):
    return T.coalesce_changes(f.sql(_CHANGES), 30 * 60)


@query("e1_observed_signatures", "SELECT symbol, parameter_types, return_type, samples, fingerprint FROM o_observed")
def observed_signatures(f):
    return _flat(T.observed_signatures(samples(f)))


@query("s5_observe_stream", "SELECT symbol, parameter_types, return_type, samples FROM o_observed")
def observe_stream(f):
    """The same answer from a stream over the event table."""
    return _flat(jobs.observe_table(f.spark, f.sf_dir)).drop("fingerprint")


_RUNS = """SELECT 'w' || (o_custkey % 200) AS repo, o_orderkey AS run_id, o_orderstatus <> 'F' AS ok, o_orderdate AS finished FROM orders"""
_SIGS = """SELECT 'w' || (o_custkey % 200) AS repo, o_orderkey AS run_id, 'm' || l_linenumber AS symbol, 'f' || (l_partkey % 3) AS fingerprint, l_quantity AS samples
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""
_CURRENT = "SELECT DISTINCT 'w' || (c_custkey % 200) AS repo, 'm' || (c_nationkey % 8) AS symbol, 'f' || (c_custkey % 3) AS fingerprint FROM customer"


@query(
    "s6_replace_run",
    f"""WITH l AS (SELECT repo, arg_max(run_id, (finished, run_id)) AS run_id FROM ({_RUNS}) WHERE ok GROUP BY repo)
    SELECT DISTINCT s.repo, s.run_id, symbol, fingerprint FROM ({_SIGS}) s JOIN l ON l.repo = s.repo AND l.run_id = s.run_id""",
)
def replace_run(f):
    signatures = f.sql(_SIGS).select("repo", "run_id", "symbol", "fingerprint").distinct()
    every = signatures.select("repo", "symbol", "fingerprint").distinct()
    return T.current_evidence(f.sql(_RUNS), signatures, every).select("repo", "run_id", "symbol", "fingerprint")


@query(
    "s7_invalidate_changed",
    f"SELECT s.repo, s.run_id, s.symbol, s.fingerprint, s.samples FROM ({_SIGS}) s JOIN ({_CURRENT}) c ON c.repo = s.repo AND c.symbol = s.symbol AND c.fingerprint = s.fingerprint",
)
def invalidate_changed(f):
    return T.invalidate_changed(f.sql(_SIGS), f.sql(_CURRENT)).select("repo", "run_id", "symbol", "fingerprint", "samples")


@query(
    "s7_fingerprint",
    "SELECT doc_id, sha256(text) || ':' || n_chars AS fingerprint FROM documents",
)
def fingerprints(f):
    return f["documents"].select("doc_id", T.fingerprint(F.col("text"), F.col("n_chars")).alias("fingerprint"))


_REQ = "SELECT 'r' || (user_id % 10) AS repo, ts AS at FROM events WHERE event_type = 'click'"
_PASS = "SELECT DISTINCT 'r' || (user_id % 10) AS repo, date_trunc('hour', ts) + INTERVAL 20 MINUTE AS start FROM events WHERE extract(HOUR FROM ts) % 3 <> 1"


@query(
    "s9_rerun_requests",
    f"""WITH p AS (SELECT repo, start, lag(start) OVER (PARTITION BY repo ORDER BY start) AS prev FROM ({_PASS}))
    SELECT p.repo, p.start, count(*) AS n FROM p JOIN ({_REQ}) r ON r.repo = p.repo AND r.at < p.start AND (p.prev IS NULL OR r.at >= p.prev) GROUP BY 1, 2""",
)
def rerun_requests(f):
    return T.collapse_requests(f.sql(_REQ), f.sql(_PASS)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "e10_run_totals",
    f"""SELECT r.run_id, CASE WHEN ok THEN coalesce(s, 0) ELSE 0 END AS sample_count, CASE WHEN ok THEN coalesce(m, 0) ELSE 0 END AS method_count
    FROM ({_RUNS}) r LEFT JOIN (SELECT run_id, CAST(sum(samples) AS BIGINT) AS s, count(*) AS m FROM ({_SIGS}) GROUP BY 1) t ON t.run_id = r.run_id""",
)
def run_totals(f):
    return T.run_totals(f.sql(_RUNS), f.sql(_SIGS).withColumn("samples", F.col("samples").cast("bigint")))


# Union receivers ask each member's exact symbol first, then the one of its parent.
_ASK = """SELECT receiver_type, receiver, name, rank, symbol FROM (
    SELECT 'U' || (l_suppkey % 12) || ' | U' || (l_partkey % 12) AS receiver_type, 'U' || (l_suppkey % 12) AS receiver, CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'B' END AS name,
      -1 AS rank, '::U' || (l_suppkey % 12) || '#' || CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'B' END AS symbol FROM lineitem
    UNION SELECT 'U' || (l_suppkey % 12) || ' | U' || (l_partkey % 12), 'U' || (l_partkey % 12), CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'B' END,
      -1, '::U' || (l_partkey % 12) || '#' || CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'B' END FROM lineitem
    UNION SELECT 'U' || (l_suppkey % 12) || ' | U' || (l_partkey % 12), 'U' || (l_suppkey % 12), CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'B' END,
      0, '::U' || (l_suppkey % 3) || '#' || CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'B' END FROM lineitem) a"""


@query(
    "c27_evidence_lookup",
    f"""WITH h AS (SELECT a.*, o.return_type AS t FROM ({_ASK}) a JOIN o_observed o ON o.symbol = a.symbol),
    f AS (SELECT receiver_type, receiver, name, arg_min(t, rank) AS t FROM h GROUP BY 1, 2, 3),
    m AS (SELECT DISTINCT receiver_type, name, unnest(string_split(t, ' | ')) AS t FROM f WHERE t <> 'Unknown')
    SELECT receiver_type, name, string_agg(t, ' | ' ORDER BY t) AS return_type FROM m GROUP BY 1, 2""",
)
def evidence_lookup(f):
    return T.evidence_lookup(f.sql(_ASK), observed(f))
