"""Sources, snapshots, ingest and sinks."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from factloom.operators import snapshots as S
from factloom.plans.registry import query
from factloom.sources import corpus, ingest, sinks

_PATH = """CASE doc_id % 9 WHEN 0 THEN 'app/models/' WHEN 1 THEN 'node_modules/x/' WHEN 2 THEN 'vendor/bundle/'
  WHEN 3 THEN 'public/assets/' WHEN 4 THEN 'lib/tmp/' ELSE 'lib/' END || source || '/d' || doc_id
  || CASE doc_id % 5 WHEN 0 THEN '.rb' WHEN 1 THEN '.rake' WHEN 2 THEN '.erb' WHEN 3 THEN '.txt' ELSE '.rb' END"""


@query(
    "a1_corpus_scan",
    f"""WITH p AS (SELECT {_PATH} AS path, text FROM documents)
    SELECT path, sha256(text) AS content_hash FROM p
    WHERE regexp_matches(path, '\\.(rb|rake|erb)$')
      AND len(list_intersect(list_slice(string_split(path, '/'), 1, -2), ['.git','node_modules','vendor','tmp','log','coverage','storage'])) = 0
      AND NOT (path LIKE 'vendor/bundle/%') AND NOT (path LIKE 'public/assets/%')""",
)
def corpus_scan(f):
    files = f.sql(f"SELECT {_PATH} AS path, text FROM documents")
    return corpus.included(files).select("path", S.content_hash("text").alias("content_hash"))


@query(
    "a2_dedup_physical",
    "SELECT '/real/' || sha256(text) AS real_path, min('lib/' || source || '/d' || doc_id || '.rb') AS path FROM documents GROUP BY 1",
)
def dedup_physical(f):
    files = f["documents"].select(
        F.concat(F.lit("/real/"), S.content_hash("text")).alias("real_path"),
        F.concat(F.lit("lib/"), "source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".rb")).alias("path"),
    )
    return S.dedup_physical(files)


@query("a3_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(f):
    return f["documents"].select("doc_id", S.content_hash("text").alias("content_hash"))


@query(
    "a4_incremental_diff",
    """SELECT uri, CASE WHEN p.text IS NULL THEN 'new' WHEN c.text IS NULL THEN 'deleted' WHEN p.text = c.text THEN 'unchanged'
      ELSE 'changed' END AS change FROM snapshot_prev p FULL OUTER JOIN snapshot_cur c USING (uri)""",
)
def incremental_diff(f):
    return S.incremental_diff(f["snapshot_prev"], f["snapshot_cur"])


@query(
    "a5_deleted_sweep",
    "SELECT uri, length(text) AS n FROM snapshot_prev WHERE uri IN (SELECT uri FROM snapshot_cur)",
)
def deleted_sweep(f):
    seen = f["snapshot_cur"].select("uri", F.lit(True).alias("ok"))
    facts = f["snapshot_prev"].select("uri", F.length("text").cast("bigint").alias("n"))
    return S.sweep(facts, seen.select("uri"), S.scan_completeness(seen).select("complete"))


_SOURCED = """SELECT uri, sha256(text) AS content_hash, 'disk' AS source FROM snapshot_prev"""


@query(
    "a6_replace_file",
    """WITH p AS (SELECT uri, sha256(text) AS content_hash FROM snapshot_prev), c AS (SELECT uri, sha256(text) AS content_hash FROM snapshot_cur)
    SELECT coalesce(c.uri, p.uri) AS uri, coalesce(c.content_hash, p.content_hash) AS content_hash,
      CASE WHEN c.uri IS NULL THEN 'disk' ELSE 'buffer' END AS source FROM p FULL OUTER JOIN c ON p.uri = c.uri""",
)
def replace_file(f):
    old = f["snapshot_prev"].select("uri", S.content_hash("text").alias("content_hash"), F.lit("disk").alias("source"))
    new = f["snapshot_cur"].select("uri", S.content_hash("text").alias("content_hash"), F.lit("buffer").alias("source"))
    return S.replace_file(old, new)


_SUMMARIES = """SELECT 'u' || user_id AS uri, event_id AS arrival,
  CASE WHEN event_type = 'error' THEN 'disk' ELSE 'buffer' END AS source,
  CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(event_id / 4000.0) AS BIGINT) END AS buffer_id,
  CASE WHEN event_type IN ('error', 'view') AND value < 30 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS document_version,
  CAST(floor(value) AS BIGINT) AS read_sequence FROM events"""


@query(
    "a7_latest_version_wins",
    f"""WITH s AS ({_SUMMARIES}), b AS (SELECT * FROM s WHERE source = 'buffer'),
    last AS (SELECT uri, arg_max(buffer_id, arrival) AS cur FROM b GROUP BY uri),
    st AS (SELECT uri, max(CASE WHEN buffer_id <> cur THEN arrival ELSE -1 END) AS frm FROM b JOIN last USING (uri) GROUP BY uri),
    live AS (SELECT b.*, max(CASE WHEN document_version IS NULL THEN arrival ELSE -1 END) OVER (PARTITION BY uri) AS null_at
      FROM b JOIN st USING (uri) WHERE arrival > frm),
    w AS (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY coalesce(document_version, -1) DESC, arrival DESC) AS r FROM live WHERE arrival >= null_at),
    d AS (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY read_sequence DESC, arrival DESC) AS r FROM s
      WHERE source = 'disk' AND uri NOT IN (SELECT uri FROM b))
    SELECT uri, arrival, source, buffer_id, document_version, read_sequence FROM w WHERE r = 1
    UNION ALL SELECT uri, arrival, source, buffer_id, document_version, read_sequence FROM d WHERE r = 1""",
)
def latest_version_wins(f):
    return S.latest_versions(f.sql(_SUMMARIES))


@query(
    "a8_scan_completeness",
    "SELECT count(*) FILTER (n_chars > 50) AS n_seen, count(*) FILTER (n_chars <= 50) AS n_errors, bool_and(n_chars > 50) AS complete FROM documents",
)
def scan_completeness(f):
    return S.scan_completeness(f["documents"].select((F.col("n_chars") > 50).alias("ok")))


@query(
    "a9_snapshot_key",
    """SELECT doc_id, sha256('3|1.0|4.1|p1|' || source || '|' || sha256(text) || '|' || lang || '|s' || n_chars) AS snapshot_key FROM documents""",
)
def snapshot_key(f):
    parts = [
        F.lit("3"), F.lit("1.0"), F.lit("4.1"), F.lit("p1"), F.col("source"), S.content_hash("text"), F.col("lang"),
        F.concat(F.lit("s"), F.col("n_chars").cast("string")),
    ]
    return f["documents"].select("doc_id", S.snapshot_key(parts).alias("snapshot_key"))


@query(
    "a10_inputs_fingerprint",
    """WITH entries AS (SELECT source, sha256('d' || doc_id || ':' || doc_id || ':' || n_chars) AS h FROM documents)
    SELECT source, count(*) AS n_files, sha256(concat_ws('|',
      sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 16, 15))::BIGINT)::VARCHAR,
      sum(('0x' || substr(h, 31, 15))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 46, 15))::BIGINT)::VARCHAR)) AS fingerprint
    FROM entries GROUP BY 1""",
)
def inputs_fingerprint(f):
    files = f["documents"].select(
        "source", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").alias("mtime"),
        F.col("n_chars").alias("size"),
    )
    return S.inputs_fingerprint(files, "source")


_SNAPS = """SELECT 'w' || (o_custkey % 50) AS workspace, 's' || o_orderkey AS snapshot,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS mtime,
  o_orderkey % 1000 = 7 AS is_current FROM orders"""


@query(
    "a11_retain_generations",
    f"""WITH s AS ({_SNAPS}), r AS (SELECT *, row_number() OVER (PARTITION BY workspace, is_current ORDER BY coalesce(mtime, 0) DESC, snapshot DESC) AS n FROM s)
    SELECT workspace, snapshot, is_current OR n <= 7 AS keep FROM r""",
)
def retain_generations(f):
    return S.retain_generations(f.sql(_SNAPS)).select("workspace", "snapshot", "keep")


@query(
    "a12_retain_entries",
    """WITH r AS (SELECT l_suppkey % 3 AS store, l_shipdate AS mtime, l_orderkey * 10 + l_linenumber AS entry, l_partkey,
      rank() OVER (PARTITION BY l_suppkey % 3 ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber DESC) AS n,
      count(*) OVER (PARTITION BY l_suppkey % 3) AS total FROM lineitem)
    SELECT store, count(*) AS n, count(*) FILTER (WHERE n <= 20000) >= least(total, 20000) AS filled FROM r GROUP BY store, total""",
)
def retain_entries(f):
    entries = f["lineitem"].select(
        (F.col("l_suppkey") % 3).alias("store"), F.col("l_shipdate").alias("mtime"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("entry"),
    )
    kept = S.retain_entries(entries)
    per = kept.groupBy("store").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("keep"), 1)).alias("_k")
    )
    return per.select("store", "n", (F.col("_k") >= F.least("n", F.lit(S.KEEP_ENTRIES))).alias("filled"))


@query(
    "a12_retain_entries_rows",
    """SELECT l_suppkey % 3 AS store, l_orderkey * 10 + l_linenumber AS entry,
      rank() OVER (PARTITION BY l_suppkey % 3 ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber DESC) <= 500 AS keep FROM lineitem""",
)
def retain_entries_rows(f):
    """A limit below the size of every store, entry by entry."""
    entries = f["lineitem"].select(
        (F.col("l_suppkey") % 3).alias("store"), F.col("l_shipdate").alias("mtime"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("entry"),
    )
    return S.retain_entries(entries, 500).select("store", "entry", "keep")


_SCOPES = """SELECT 'sc' || o_orderkey AS scope, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'w' || o_custkey END AS workspace,
  CAST(floor(o_totalprice * 10) AS BIGINT) AS mtime, o_orderkey % 100 = 1 AS is_current FROM orders"""


@query(
    "a13_retain_workspaces",
    f"""WITH s AS ({_SCOPES}), e AS (SELECT DISTINCT 'w' || c_custkey AS workspace FROM customer WHERE c_acctbal > 0)
    SELECT scope, is_current OR NOT (CASE WHEN s.workspace IS NULL THEN 4000000 - mtime >= 3600
      ELSE e.workspace IS NULL AND 4000000 - mtime >= 2592000 END) AS keep FROM s LEFT JOIN e ON s.workspace = e.workspace""",
)
def retain_workspaces(f):
    existing = f.sql("SELECT 'w' || c_custkey AS workspace FROM customer WHERE c_acctbal > 0")
    return S.retain_workspaces(f.sql(_SCOPES), existing, F.lit(4000000))


_PAYLOAD = """SELECT doc_id, CASE doc_id % 8
  WHEN 0 THEN '{"symbol_id":{"kind":"instance_method","owner":"::' || lang || '","name":"m' || doc_id || '"},"return_type":{"kind":"nominal","name":"User"}}'
  WHEN 1 THEN '{"symbol_id":{"kind":"widget","name":"m"},"return_type":{"kind":"nil"}}'
  WHEN 2 THEN '{"symbol_id":{"kind":"class","name":""}}'
  WHEN 3 THEN 'not json ' || doc_id
  WHEN 4 THEN '{"symbol_id":{"kind":"singleton_method","owner":"Admin","name":"all"},"return_type":{"kind":"generic","name":"Array","type_arg":{"kind":"nominal","name":"User"}}}'
  WHEN 5 THEN '{"symbol_id":{"kind":"constant","name":"X' || doc_id || '"},"return_type":{"kind":"union","members":[{"kind":"nominal","name":"User"},{"kind":"nil"}]}}'
  WHEN 6 THEN '{"symbol_id":{"kind":"class","name":7}}'
  ELSE '{"symbol_id":{"kind":"module","owner":null,"name":"M"},"return_type":{"kind":"union","members":[{"kind":"nil"}]}}' END AS payload
  FROM documents"""


@query(
    "a14_ingest_json_facts",
    """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'instance_method' WHEN 4 THEN 'singleton_method' WHEN 5 THEN 'constant' WHEN 7 THEN 'module' END AS kind,
      CASE doc_id % 8 WHEN 0 THEN '::' || lang WHEN 4 THEN '::Admin' END AS owner,
      CASE doc_id % 8 WHEN 0 THEN 'm' || doc_id WHEN 4 THEN 'all' WHEN 5 THEN 'X' || doc_id WHEN 7 THEN 'M' END AS name,
      CASE doc_id % 8 WHEN 0 THEN 'User' WHEN 4 THEN 'Array[User]' WHEN 5 THEN 'User | nil' END AS return_type,
      doc_id % 8 IN (1, 2, 3, 6) AS rejected FROM documents""",
)
def ingest_json_facts(f):
    facts, rejects = ingest.json_facts(f.sql(_PAYLOAD), "doc_id", "payload")
    return facts.withColumn("rejected", F.lit(False)).unionByName(
        rejects.select("doc_id", F.lit(True).alias("rejected")), allowMissingColumns=True
    )


_DEEP, _DEEP_TEXT = '{"kind":"nominal","name":"User"}', "User"
for _ in range(7):
    _DEEP, _DEEP_TEXT = f'{{"kind":"generic","name":"Array","type_arg":{_DEEP}}}', f"Array[{_DEEP_TEXT}]"
_FACT = '{"symbol_id":{"kind":"%s","owner":"A","name":"%s"},"return_type":%s}'
_PROC = f'{{"kind":"proc","parameters":[{_DEEP},{{"kind":"nil"}}],"return_type":{{"kind":"unknown"}}}}'
# Per document an answer with a nested type, a proc and two bad declarations; or a summary, a failure, an odd shape, no JSON.
_ANSWERS = f"""SELECT doc_id, CASE doc_id % 5
  WHEN 0 THEN '{{"ok":true,"result":{{"shape":"declarations","declarations":[{_FACT % ("class", "C", _DEEP)},{_FACT % ("module", "M", _PROC)},'
    || '{_FACT % ("ivar", "@x", "null")},{{"symbol_id":{{"kind":"constant","owner":1,"name":"X"}}}},{_FACT % ("constant", "X", '{"kind":"nominal","name":""}')}]}}}}'
  WHEN 1 THEN '{{"ok":true,"result":{{"shape":"summary","snapshot_section_names":["s' || doc_id || '"],"reload_hook_count":2}}}}'
  WHEN 2 THEN '{{"ok":false,"error":"e"}}' WHEN 3 THEN '{{"ok":true,"result":{{"shape":"odd"}}}}' ELSE '{{' END AS payload FROM documents"""


@query(
    "a14_plugin_results",
    f"""SELECT doc_id, ordinal, kind, owner, name, return_type, reason FROM documents, (VALUES
        (0, 0, 'class', '::A', 'C', '{_DEEP_TEXT}', NULL), (0, 1, 'module', '::A', 'M', '({_DEEP_TEXT}, nil) -> Unknown', NULL),
        (0, 2, NULL, NULL, NULL, NULL, 'unknown kind'), (0, 3, NULL, NULL, NULL, NULL, 'owner is no text'), (0, 4, 'constant', '::A', 'X', NULL, NULL),
        (1, NULL, 'summary', NULL, NULL, NULL, NULL), (2, NULL, NULL, NULL, NULL, NULL, 'plugin failed'), (3, NULL, NULL, NULL, NULL, NULL, 'unknown shape'),
        (4, NULL, NULL, NULL, NULL, NULL, 'no JSON')) v(r, ordinal, kind, owner, name, return_type, reason)
    WHERE doc_id % 5 = r AND kind IS DISTINCT FROM 'summary'
    UNION ALL SELECT doc_id, NULL, 'summary', NULL, 's' || doc_id, '2', NULL FROM documents WHERE doc_id % 5 = 1""",
)
def plugin_results(f):
    facts, summaries, rejects = ingest.plugin_results(f.sql(_ANSWERS), "doc_id", "payload")
    told = summaries.select(
        "doc_id", F.lit("summary").alias("kind"), F.array_join("section_names", ",").alias("name"), F.col("reload_hooks").cast("string").alias("return_type"))
    return facts.unionByName(told, allowMissingColumns=True).unionByName(rejects, allowMissingColumns=True)


_MODELS = """SELECT o_orderkey, '{"tableName":"t' || o_custkey || '","partial":' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END
  || ',"columns":[{"name":"id","type":"bigint","null":false},{"name":"note","type":"' || CASE WHEN o_orderkey % 3 = 0 THEN 'citext' ELSE 'jsonb' END
  || '"}],"associations":[{"name":"owner","macro":"belongs_to","className":"User","optional":' || CASE WHEN o_orderkey % 5 = 0 THEN 'false' ELSE 'null' END || '}]}' AS payload FROM orders"""


@query(
    "a15_ingest_model_facts",
    """SELECT 'm' || o_orderkey AS name, 't' || o_custkey AS table_name, o_orderkey % 2 = 0 AS partial,
      'id:Integer:false,note:' || CASE WHEN o_orderkey % 3 = 0 THEN 'Untyped' ELSE 'Hash' END || ':true' AS columns,
      'owner:belongs_to:User:' || CASE WHEN o_orderkey % 5 = 0 THEN 'false' ELSE 'true' END AS associations FROM orders""",
)
def ingest_model_facts(f):
    raw = f.sql(_MODELS).select(F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("name"), "payload")
    models = ingest.model_facts(raw)
    return models.select(
        "name", "table_name", "partial",
        F.array_join(F.transform("columns", lambda c: F.concat_ws(":", c["name"], c["ruby_type"], c["nullable"].cast("string"))), ",").alias("columns"),
        F.array_join(F.transform("associations", lambda a: F.concat_ws(":", a["name"], a["macro"], a["class_name"], a["optional"].cast("string"))), ",").alias("associations"),
    )


@query(
    "a16_commit_updates",
    """SELECT uri, text FROM snapshot_prev WHERE uri NOT IN (SELECT uri FROM snapshot_cur) AND length(text) % 2 = 0
    UNION ALL SELECT uri, text FROM snapshot_cur""",
)
def commit_updates(f):
    removals = f["snapshot_prev"].filter(F.length("text") % 2 == 1).select("uri")
    return S.commit_updates(f["snapshot_prev"], f["snapshot_cur"], removals, "uri")


_ROUTE_JSON = """SELECT o_orderkey, '{"name":' || CASE WHEN o_orderkey % 4 = 0 THEN 'null' WHEN o_orderkey % 4 = 1 THEN '""' ELSE '"r' || o_custkey || '"' END
  || ',"verb":"GET","pathTemplate":"/r/:id","requiredParts":["id"],"optionalParts":["format"],"defaults":{"controller":"c' || (o_custkey % 10)
  || '","action":"show"},"sourceLocation":{"path":"config/routes.rb","line":' || o_orderkey || '},"routeSet":"main"}' AS payload FROM orders"""


@query(
    "a17_ingest_route_facts",
    """SELECT o_orderkey AS ordinal, 'r' || o_custkey AS name, 'GET' AS verb, 'id' AS required, 'format' AS optional,
      'c' || (o_custkey % 10) AS controller, 'show' AS action, 'config/routes.rb' AS path, o_orderkey AS line
    FROM orders WHERE o_orderkey % 4 >= 2""",
)
def ingest_route_facts(f):
    routes, _ = ingest.route_facts(f.sql(_ROUTE_JSON).withColumnRenamed("o_orderkey", "ordinal"))
    return routes.select(
        "ordinal", "name", "verb", F.array_join("required_parts", ",").alias("required"),
        F.array_join("optional_parts", ",").alias("optional"), "controller", "action", "path", "line",
    )


@query("a18_fact_sink", "SELECT source AS repo_id, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def fact_sink(f):
    out = os.path.join(sinks.scratch_dir(f.spark), "facts")
    rows = f["documents"].select(F.col("source").alias("repo_id"), F.lit(1).alias("snapshot_id"), "doc_id", "n_chars")
    sinks.write_facts(rows, out)
    back = f.spark.read.parquet(out)
    return back.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "a19_corpus_tsv_report",
    """SELECT 'long-line' || chr(9) || 'd' || doc_id || ':' || n_chars || ':0' || chr(9) || trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line
    FROM documents""",
)
def corpus_tsv_report(f):
    findings = f["documents"].select(
        F.lit("long-line").alias("code"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("uri"),
        F.col("n_chars").alias("line"), F.lit(0).alias("character"), F.col("text").alias("message"),
    )
    return sinks.tsv_report(findings)


@query(
    "h3_uris_except",
    "SELECT uri FROM snapshot_prev EXCEPT SELECT uri FROM snapshot_cur",
)
def uris_except(f):
    return f["snapshot_prev"].select("uri").join(f["snapshot_cur"].select("uri"), "uri", "left_anti")


@query(
    "s10_supersede",
    """SELECT 'w' || o_custkey AS repo, o_orderkey AS generation,
      CASE WHEN o_orderkey < max(o_orderkey) OVER (PARTITION BY o_custkey) THEN 'superseded' ELSE 'current' END AS status FROM orders""",
)
def supersede(f):
    return S.supersede(f.sql("SELECT 'w' || o_custkey AS repo, o_orderkey AS generation FROM orders"))


@query(
    "g10_capped_pass",
    """WITH r AS (SELECT 'r' || (l_suppkey % 4) AS repo, 'o' || l_orderkey AS uri FROM lineitem GROUP BY 1, 2),
    n AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY uri) AS k, count(*) OVER (PARTITION BY repo) AS t FROM r)
    SELECT repo, uri, t > 2000 AS truncated FROM n WHERE k <= 2000""",
)
def capped_pass(f):
    uris = f.sql("SELECT DISTINCT 'r' || (l_suppkey % 4) AS repo, 'o' || l_orderkey AS uri FROM lineitem")
    return S.affected_by_cap(uris, "repo", 2000)
