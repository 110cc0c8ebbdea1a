"""Jobs over whole texts, templates and web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T

_TAGGED = r"(?s)(.*?)(<%(-|=)?(.*?)-?%>)"


# --- secrets and paths ----------------------------------------------------------


def audit(df: DataFrame, key: str, col: str) -> DataFrame:
    """Hits per document and secret pattern; patterns without hits are left out."""
    return (
        df.select(key, F.explode(T.pattern_hits(col)).alias("h"))
        .select(key, "h.pattern", "h.hits").filter("hits > 0")
    )


def home_paths(df: DataFrame, key: str, col: str) -> DataFrame:
    """Each user directory named in a text: key, line (from 1), user."""
    lines = df.select(key, F.posexplode(F.split(F.col(col), "\n")).alias("pos", "line_text"))
    hits = lines.filter(F.col("line_text").rlike(T.HOME_PATH))
    return hits.select(
        key, (F.col("pos") + 1).cast("bigint").alias("line"), F.explode(T.home_path_users("line_text")).alias("user")
    )


# --- templates ------------------------------------------------------------------


def template_regions(df: DataFrame, key: str, col: str) -> DataFrame:
    """Code regions of a template: key, ordinal, marker, code and the character
    offset of the code. Comment tags are left out."""
    tags = df.select(
        key,
        F.posexplode(
            F.arrays_zip(
                F.regexp_extract_all(F.col(col), F.lit(_TAGGED), F.lit(1)).alias("gap"),
                F.regexp_extract_all(F.col(col), F.lit(_TAGGED), F.lit(2)).alias("tag"),
                F.regexp_extract_all(F.col(col), F.lit(_TAGGED), F.lit(3)).alias("marker"),
                F.regexp_extract_all(F.col(col), F.lit(_TAGGED), F.lit(4)).alias("code"),
            )
        ).alias("ordinal", "t"),
    ).select(key, "ordinal", "t.*")
    # One text is one row of the input, so its tags are bounded by that row.
    through = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("gap") + F.length("tag")).over(through)
    return (
        tags.withColumn("start", end - F.length("tag"))
        .filter(~F.col("tag").startswith("<%#"))
        .select(
            key, F.col("ordinal").cast("bigint").alias("ordinal"), "marker", "code",
            (F.col("start") + F.instr("tag", F.col("code")) - 1).cast("bigint").alias("offset"),
        )
    )


def blank_non_code(text: Column | str) -> Column:
    """The text with everything but template code blanked out, same UTF-16
    length, line breaks kept. ``;`` separates two tags on one line."""
    t = F.col(text) if isinstance(text, str) else text

    def group(n: int) -> Column:
        return F.regexp_extract_all(t, F.lit(_TAGGED), F.lit(n))

    parts = F.arrays_zip(group(1).alias("gap"), group(2).alias("tag"), group(4).alias("code"))
    # Position of the first tag that holds code; only later ones may need ``;``.
    first_code = F.array_min(
        F.filter(
            F.transform(group(2), lambda tag, i: F.when(~tag.startswith("<%#"), i)), lambda i: i.isNotNull()
        )
    )

    def render(p: Column, i: Column) -> Column:
        offset = F.instr(p["tag"], p["code"]) - 1
        prefix = T.blank(F.substr(p["tag"], F.lit(1), offset))
        separate = (i > first_code) & ~p["gap"].contains("\n") & (F.length(prefix) > 0)
        lead = F.when(separate, F.concat(F.substr(prefix, F.lit(1), F.length(prefix) - 1), F.lit(";"))).otherwise(prefix)
        rest = F.substr(p["tag"], offset + F.length(p["code"]) + 1)
        code = F.concat(lead, p["code"], T.blank(rest))
        return F.concat(T.blank(p["gap"]), F.when(p["tag"].startswith("<%#"), T.blank(p["tag"])).otherwise(code))

    used = F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(p["gap"]) + F.length(p["tag"]))
    return F.concat(F.array_join(F.transform(parts, render), ""), T.blank(F.substr(t, used + 1)))


# --- web pages ------------------------------------------------------------------

_URL = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?//([^/?#]*)([^?#]*)"
_REFERENCE = r'\b(?:href|src)\s*=\s*"([^"]*)"'
_ELEMENT_ID = r'\bid\s*=\s*"([^"]+)"'
_EXTERNAL = r"^(?:http://|https://|mailto:|data:|//)"

# What every page must carry, and how that shows in its source.
REQUIRED_ELEMENTS = {
    "title": r"<title>",
    "lang": r'<html\s+lang="[^"]+"',
    "description": r'name="description"',
    "canonical": r'rel="canonical"',
    "stylesheet": r"assets/css/site\.css",
    "script": r"assets/js/site\.js",
}


def resolve_path(base: Column, path: Column) -> Column:
    """Absolute path of ``path`` seen from the file ``base``, dots folded."""
    joined = F.when(path.startswith("/"), path).otherwise(
        F.concat(F.regexp_replace(base, "[^/]*$", ""), path)
    )
    folded = F.aggregate(
        F.split(joined, "/"),
        F.array().cast("array<string>"),
        lambda acc, part: F.when((part == "") | (part == "."), acc)
        .when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(part))),
    )
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def link_check(pages: DataFrame, base_path: str = "") -> DataFrame:
    """Broken references: page_id, ref, problem, target.

    ``pages``: page_id, site, path, html. Problems are ``leaves_site`` (a rooted
    reference outside ``base_path``), ``missing_target`` and ``missing_fragment``.
    """
    refs = (
        pages.select("page_id", "site", "path", F.explode(F.regexp_extract_all("html", F.lit(_REFERENCE), F.lit(1))).alias("ref"))
        .filter((F.col("ref") != "") & ~F.col("ref").rlike(_EXTERNAL))
        .withColumn("to", F.element_at(F.split("ref", "#", 2), 1))
        .withColumn("fragment", F.nullif(F.regexp_extract("ref", r"^[^#]*#(.*)$", 1), F.lit("")))
    )
    rooted = F.col("to").startswith("/")
    leaves = rooted & ~F.col("to").startswith(base_path + "/")
    inside = F.when(rooted, F.substring("to", len(base_path) + 1, 2**30)).otherwise(F.col("to"))
    target = F.when(F.col("to") == "", F.col("path")).otherwise(resolve_path(F.col("path"), inside))
    placed = refs.withColumn("leaves", leaves).withColumn("target", target)

    # Whether a page exists is a set question, so popular targets are reduced
    # to one row on both sides before they meet.
    known = pages.select("site", F.col("path").alias("target")).distinct()
    asked = placed.filter("NOT leaves").select("site", "target").distinct()
    missing = asked.join(known, ["site", "target"], "left_anti").withColumn("missing", F.lit(True))
    ids = (
        pages.select("site", F.col("path").alias("target"), F.explode(F.regexp_extract_all("html", F.lit(_ELEMENT_ID), F.lit(1))).alias("fragment"))
        .distinct()
    )
    pointed = (
        placed.filter("NOT leaves AND fragment IS NOT NULL").filter(F.col("target").endswith(".html"))
        .select("site", "target", "fragment").distinct()
    )
    dangling = pointed.join(ids, ["site", "target", "fragment"], "left_anti").withColumn("dangling", F.lit(True))
    judged = (
        placed.join(missing, ["site", "target"], "left")
        .join(dangling, ["site", "target", "fragment"], "left")
    )
    problem = (
        F.when(F.col("leaves"), "leaves_site")
        .when(F.col("missing"), "missing_target")
        .when(F.col("dangling"), "missing_fragment")
    )
    return judged.withColumn("problem", problem).filter("problem IS NOT NULL").select("page_id", "ref", "problem", "target")


def with_site_path(pages: DataFrame) -> DataFrame:
    """Split a page's address into site and path."""
    return pages.select(
        "page_id",
        F.regexp_extract("url", _URL, 2).alias("site"),
        F.when(F.regexp_extract("url", _URL, 3) == "", "/").otherwise(F.regexp_extract("url", _URL, 3)).alias("path"),
        "html",
    )


def missing_elements(pages: DataFrame) -> DataFrame:
    """Required elements a page lacks: page_id, element."""
    checks = F.array(
        *[F.struct(F.lit(name).alias("element"), F.col("html").rlike(p).alias("found")) for name, p in REQUIRED_ELEMENTS.items()]
    )
    return pages.select("page_id", F.explode(checks).alias("c")).filter("NOT c.found").select("page_id", "c.element")


# --- source lines ---------------------------------------------------------------


def site_inventory(files: DataFrame) -> DataFrame:
    """Every ``rescue`` with a key that survives edits elsewhere in the file:
    ``file#method`` plus ``[n]`` from the second one in a method on."""
    lines = files.select("uri", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).withColumn("source", F.btrim("raw"))
    define = F.nullif(F.regexp_extract("source", r"^def\s+([A-Za-z_][A-Za-z0-9_.?!=\[\]]*)", 1), F.lit(""))
    marked = lines.withColumn("define", define).filter(F.col("define").isNotNull() | F.col("source").rlike(r"^rescue\b"))
    so_far = Window.partitionBy("uri").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    scoped = marked.withColumn("scope", F.count("define").over(so_far)).withColumn(
        "method", F.coalesce(F.last("define", ignorenulls=True).over(so_far), F.lit("(toplevel)"))
    )
    nth = F.row_number().over(Window.partitionBy("uri", "scope").orderBy("pos"))
    sites = scoped.filter(F.col("define").isNull()).withColumn("nth", nth)
    suffix = F.when(F.col("nth") > 1, F.concat(F.lit("["), F.col("nth").cast("string"), F.lit("]"))).otherwise("")
    return sites.select(
        "uri", (F.col("pos") + 1).cast("bigint").alias("line"), "source",
        F.concat("uri", F.lit("#"), "method", suffix).alias("key"),
    )


# Comment lines addressed to a tool rather than a reader.
DIRECTIVE_COMMENT = (
    r"^#!|^#\s*(?:frozen_string_literal|encoding\s*[:=]|warn_indent|shareable_constant_value|rubocop:|-\*-|vim:\s|"
    r"Local Variables:|:(?:nodoc|doc|markup|stopdoc|startdoc|enddoc|include|title|main|category|call-seq):)"
)


def doc_comments(files: DataFrame, declarations: DataFrame) -> DataFrame:
    """Comment block right above each declaration: uri, line (from 0), doc.

    Runs of comment lines are found once per file; directive lines stay part of
    the run but not of its text."""
    lines = files.select("uri", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).withColumn("source", F.btrim("raw"))
    comments = lines.filter(F.col("source").startswith("#"))
    run = F.col("pos") - F.row_number().over(Window.partitionBy("uri").orderBy("pos"))
    stripped = F.regexp_replace(F.regexp_replace("source", "^#", ""), "^ ", "")
    kept = F.when(~F.col("source").rlike(DIRECTIVE_COMMENT), F.struct("pos", stripped.alias("s")))
    blocks = (
        comments.withColumn("run", run).withColumn("kept", kept)
        .groupBy("uri", "run")
        .agg((F.max("pos") + 1).alias("line"), F.array_sort(F.collect_list("kept")).alias("body"))
        .select("uri", F.col("line").cast("bigint").alias("line"), F.btrim(F.array_join(F.col("body.s"), "\n"), F.lit(" \t\r\n\f\v")).alias("doc"))
        .filter("doc <> ''")
    )
    return declarations.join(blocks, ["uri", "line"]).select("uri", "line", "doc")


def dynamic_marker(chains: DataFrame, files: DataFrame) -> DataFrame:
    """Owners with a file in their chain that assigns variables by name.

    ``chains``: owner, uri; the files are reduced to the marked ones first."""
    marked = files.filter(F.col("text").rlike(r"\binstance_variable_set\b")).select("uri").distinct()
    flagged = chains.join(marked.withColumn("hit", F.lit(True)), "uri", "left")
    return flagged.groupBy("owner").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("dynamic"))
