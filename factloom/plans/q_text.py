"""Texts, templates, pages and source lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import text_audit as A
from factloom.plans.registry import query

_W = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
_REDACT = r"""
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '(?i)\bBearer\s+[A-Za-z0-9\-._~+/]+=*', 'Bearer [REDACTED]', 'g'),
  '(?i)\bBasic\s+[A-Za-z0-9\-._~+/]+=*', 'Basic [REDACTED]', 'g'),
  '([a-zA-Z][a-zA-Z0-9+.\-]*://)([^:/?\s@]+):([^/?\s]+)@', '\1\2:[REDACTED]@', 'g'),
  '\bAKIA[0-9A-Z]{16}\b|\b(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{10,}\b|\bgh[aoprsu]_[A-Za-z0-9]{20,}\b|\bxox[baprs]-[A-Za-z0-9\-]{10,}\b', '[REDACTED]', 'g'),
  '(?i)(password|passwd|secret|api[_-]?key|token|access[_-]?key|credential)(\s*[:=]\s*"?)([^\s"'',}]+)', '\1\2[REDACTED]', 'g')"""


@query("k1_redact", f"SELECT doc_id, replace({_REDACT}, '/home/user1', '~') AS text FROM log_lines")
def redact(f):
    return f["log_lines"].select("doc_id", T.redact("text", home="/home/user1").alias("text"))


@query("k1_redact_documents", f"SELECT doc_id, {_REDACT} AS text FROM documents")
def redact_documents(f):
    return f["documents"].select("doc_id", T.redact("text").alias("text"))


@query(
    "k2_redact_generic_tokens",
    r"SELECT doc_id, regexp_replace(text, '\b[A-Za-z0-9\-_]{20,}\b', '[REDACTED]', 'g') AS text FROM log_lines",
)
def redact_generic(f):
    return f["log_lines"].select("doc_id", T.redact_generic_tokens("text").alias("text"))


_COUNTS = {
    "bearer": r"(?i)\bBearer\s+[A-Za-z0-9\-._~+/]+=*",
    "basic": r"(?i)\bBasic\s+[A-Za-z0-9\-._~+/]+=*",
    "url_password": r"([a-zA-Z][a-zA-Z0-9+.\-]*://)([^:/?\s@]+):([^/?\s]+)@",
    "known_secret": r"\bAKIA[0-9A-Z]{16}\b|\b(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{10,}\b|\bgh[aoprsu]_[A-Za-z0-9]{20,}\b|\bxox[baprs]-[A-Za-z0-9\-]{10,}\b",
    "credential_key": r"""(?i)(password|passwd|secret|api[_-]?key|token|access[_-]?key|credential)(\s*[:=]\s*"?)([^\s"'',}]+)""",
    "generic_token": r"\b[A-Za-z0-9\-_]{20,}\b",
}


@query(
    "k3_secret_audit",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT doc_id, '{n}' AS pattern, len(regexp_extract_all(text, '{p}')) AS hits FROM log_lines" for n, p in _COUNTS.items()
    ) + ") WHERE hits > 0",
)
def secret_audit(f):
    return A.audit(f["log_lines"], "doc_id", "text")


@query(
    "k4_home_path_scan",
    r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM log_lines),
    n AS (SELECT doc_id, unnest(ls) AS s, generate_subscripts(ls, 1) AS line FROM l),
    u AS (SELECT doc_id, line, unnest(regexp_extract_all(s, '[/\\](?:Users|home)[/\\]([A-Za-z0-9._-]*[A-Za-z0-9][A-Za-z0-9._-]*)', 1)) AS "user" FROM n)
    SELECT doc_id, line, "user" FROM u WHERE "user" NOT IN ('example','exampleuser','dev','rhc','runner','runneradmin')""",
)
def home_path_scan(f):
    return A.home_paths(f["log_lines"], "doc_id", "text")


_TAG = "'(?s)(.*?)(<%(-|=)?(.*?)-?%>)'"


@query(
    "k5_template_regions",
    f"""WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, {_TAG}, 1)) AS gap, unnest(regexp_extract_all(text, {_TAG}, 2)) AS tag,
      unnest(regexp_extract_all(text, {_TAG}, 3)) AS marker, unnest(regexp_extract_all(text, {_TAG}, 4)) AS code,
      generate_subscripts(regexp_extract_all(text, {_TAG}, 2), 1) - 1 AS ordinal FROM templates),
    b AS (SELECT *, sum(length(gap) + length(tag)) OVER (PARTITION BY doc_id ORDER BY ordinal) - length(tag) AS start FROM a)
    SELECT doc_id, ordinal, coalesce(marker, '') AS marker, coalesce(code, '') AS code, CAST(start + instr(tag, code) - 1 AS BIGINT) AS "offset" FROM b WHERE tag NOT LIKE '<\\%#%' ESCAPE '\\'""",
)
def template_regions(f):
    return A.template_regions(f["templates"], "doc_id", "text")


def _blank(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '[\x{{10000}}-\x{{10FFFF}}]', '  ', 'g'), '[^\r\n]', ' ', 'g')"


# The generated templates hold five tags in a fixed order; the check rebuilds the
# blanked text from its pieces.
@query(
    "k6_blank_non_code",
    f"""SELECT doc_id, {_blank("'<p>' || source || '</p>' || chr(10)")} || '    user.name' || doc_id || ' ' || '   ' || '           '
      || '  x = ' || '' || (doc_id % 3) || ' ' || '   ' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '   ' ELSE '  ;' END || ' y '
      || '  ' || {_blank('text')} || CASE WHEN contains(text, chr(10)) THEN '   ' ELSE '  ;' END || lang || '  ' || chr(10) || '    ' AS code
    FROM documents""".replace("'  x = '", "' ; x = '"),
)
def blank_non_code(f):
    return f["templates"].select("doc_id", A.blank_non_code("text").alias("code"))


@query(
    "k7_link_check",
    r"""WITH p AS (SELECT page_id, regexp_extract(url, '^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?//([^/?#]*)([^?#]*)', 2) AS site,
      CASE WHEN regexp_extract(url, '^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?//([^/?#]*)([^?#]*)', 3) = '' THEN '/'
           ELSE regexp_extract(url, '^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?//([^/?#]*)([^?#]*)', 3) END AS path, html FROM pages),
    r AS (SELECT page_id, site, path, unnest(regexp_extract_all(html, '\b(?:href|src)\s*=\s*"([^"]*)"', 1)) AS ref FROM p),
    t AS (SELECT *, '/' || array_to_string(list_filter(string_split(CASE WHEN ref LIKE '/%' THEN split_part(ref, '#', 1)
        ELSE regexp_replace(path, '[^/]*$', '') || split_part(ref, '#', 1) END, '/'), lambda x: x <> '' AND x <> '.'), '/') AS target
      FROM r WHERE ref <> '' AND NOT regexp_matches(ref, '^(?:http://|https://|mailto:|data:|//)'))
    SELECT page_id, ref, 'missing_target' AS problem, target FROM t
    WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.site = t.site AND p.path = t.target)""",
)
def link_check(f):
    return A.link_check(A.with_site_path(f["pages"]))


@query(
    "k8_page_required_elements",
    """SELECT page_id, element FROM (
      SELECT page_id, 'title' AS element, html LIKE '%<title>%' AS found FROM pages
      UNION ALL SELECT page_id, 'lang', regexp_matches(html, '<html\\s+lang="[^"]+"') FROM pages
      UNION ALL SELECT page_id, 'description', html LIKE '%name="description"%' FROM pages
      UNION ALL SELECT page_id, 'canonical', html LIKE '%rel="canonical"%' FROM pages
      UNION ALL SELECT page_id, 'stylesheet', html LIKE '%assets/css/site.css%' FROM pages
      UNION ALL SELECT page_id, 'script', html LIKE '%assets/js/site.js%' FROM pages) WHERE NOT found""",
)
def page_required_elements(f):
    return A.missing_elements(f["pages"])


_INVENTORY = r"""
  l AS (SELECT uri, string_split(text, chr(10)) AS ls FROM source_files),
  n AS (SELECT uri, trim(unnest(ls)) AS source, generate_subscripts(ls, 1) AS line FROM l),
  d AS (SELECT *, CASE WHEN regexp_matches(source, '^def\s+[A-Za-z_]') THEN regexp_extract(source, '^def\s+([A-Za-z_][A-Za-z0-9_.?!=\[\]]*)', 1) END AS def FROM n),
  m AS (SELECT *, count(def) OVER (PARTITION BY uri ORDER BY line) AS scope FROM d),
  o AS (SELECT uri, line, source, scope, max(def) OVER (PARTITION BY uri, scope) AS method FROM m),
  s AS (SELECT uri, line, source, coalesce(method, '(toplevel)') AS method,
    row_number() OVER (PARTITION BY uri, scope ORDER BY line) AS nth FROM o WHERE regexp_matches(source, '^rescue\b')),
  sites AS (SELECT uri, line, source, uri || '#' || method || CASE WHEN nth > 1 THEN '[' || nth || ']' ELSE '' END AS key FROM s)"""


@query("k9_site_inventory", f"WITH {_INVENTORY} SELECT uri, line, source, key FROM sites")
def site_inventory(f):
    return A.site_inventory(f["source_files"])


@query(
    "k10_dynamic_marker",
    """SELECT 'lib/' || source AS owner, bool_or(regexp_matches(text, '\\binstance_variable_set\\b')) AS dynamic
    FROM (SELECT regexp_extract(uri, '^lib/([^/]+)/', 1) AS source, text FROM source_files) GROUP BY 1""",
)
def dynamic_marker(f):
    files = f["source_files"]
    chains = files.select(F.concat(F.lit("lib/"), F.element_at(F.split("uri", "/"), 2)).alias("owner"), "uri")
    return A.dynamic_marker(chains, files)


@query(
    "k11_utf16_positions",
    r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
    n AS (SELECT doc_id, unnest(ls) AS s, generate_subscripts(ls, 1) AS line FROM l)
    SELECT doc_id, line, strlen(s) AS byte_offset,
      CAST(length(s) + len(regexp_extract_all(s, '[\x{10000}-\x{10FFFF}]')) AS BIGINT) AS utf16_col FROM n""",
)
def utf16_positions(f):
    lines = f["documents"].select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "s"))
    size = F.octet_length("s")
    return lines.select(
        "doc_id", (F.col("pos") + 1).cast("bigint").alias("line"), size.cast("bigint").alias("byte_offset"),
        T.utf16_column("s", size).alias("utf16_col"),
    )


@query(
    "g8_comment_block_above",
    """SELECT uri, CAST(3 AS BIGINT) AS line, regexp_extract(text, '# (Doc of m\\d)', 1) || chr(10) || ' ' || regexp_extract(text, '#  (\\w+)', 1) AS doc
    FROM source_files""",
)
def comment_block_above(f):
    files = f["source_files"]
    lines = files.select("uri", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    defs = lines.filter(F.col("raw").rlike(r"^\s*def ")).select("uri", F.col("pos").cast("bigint").alias("line"))
    return A.doc_comments(files, defs)
