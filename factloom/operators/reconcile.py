"""Compare two lists and say where they differ."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inventory(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, status: both, missing (only left) or extra (only right)."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(True))
    status = F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "extra").otherwise("both")
    return a.join(b, list(keys), "full_outer").select(*keys, status.alias("status"))


def inventory_except(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both differences in one table: keys, side."""
    return inventory(left, right, keys).filter("status <> 'both'").select(
        *keys, F.when(F.col("status") == "missing", "left").otherwise("right").alias("side")
    )


# What a site may be recorded as.
VERDICTS = ("surfaces", "contained", "swallows")


def verdicts(sites: DataFrame, recorded: DataFrame) -> DataFrame:
    """key, status: ok, missing, invalid, disallowed or stale.

    ``sites``: key; ``recorded``: key, verdict (kind, maybe ``: reason``)."""
    s = sites.select("key").distinct().withColumn("_s", F.lit(True))
    kind = F.element_at(F.split("verdict", ":"), 1)
    status = (
        F.when(F.col("_s").isNull(), "stale").when(F.col("verdict").isNull(), "missing")
        .when(~kind.isin(*VERDICTS), "invalid").when(kind == "swallows", "disallowed").otherwise("ok")
    )
    return s.join(recorded, "key", "full_outer").select("key", kind.alias("kind"), status.alias("status"))


# --- status matrices ------------------------------------------------------------------

_VERSION = r"(\d+\.\d+\.\d+)"


def normal_status(cell: Column) -> Column:
    """Status a cell states, whether in marks of a page or signs of a text."""
    marks = F.regexp_extract_all(cell, F.lit(r"mark--(yes|warn|plan|none)"), F.lit(1))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(cell, r"<[^>]+>", " "), r"\[\^[a-z]+\]", ""), r"\s+", " ")
    version = F.nullif(F.regexp_extract(cell, _VERSION, 1), F.lit(""))
    shown = F.nullif(F.regexp_extract(plain, _VERSION, 1), F.lit(""))
    def joined(*parts: Column) -> Column:
        return F.nullif(F.concat_ws("+", *parts), F.lit(""))
    of_page = joined(
        F.when(F.array_contains(marks, "yes"), "verified"), F.when(F.array_contains(marks, "warn"), "unverified"),
        F.when(F.array_contains(marks, "plan") & version.isNotNull(), F.concat(F.lit("planned:"), version)),
        F.when(F.array_contains(marks, "none"), "none"),
    )
    of_text = joined(
        F.when(plain.contains("✅"), "verified"), F.when(plain.contains("⚠️"), "unverified"),
        F.when(shown.isNotNull(), F.concat(F.lit("planned:"), shown)),
    )
    dash = F.when(F.btrim(plain).rlike("^(—|―)"), "none")
    return F.when(F.size(marks) > 0, of_page).otherwise(F.coalesce(of_text, dash))


def normal_feature(text: Column) -> Column:
    t = F.regexp_replace(text, r"(?s)<small.*?</small>", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\[\^[a-z]+\]", ""), r"[`*_]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", ""), r"\s*([/,])\s*", "$1")
    return F.lower(F.btrim(F.regexp_replace(t, r"\s+", " ")))


def _known(rows: DataFrame) -> DataFrame:
    return rows.filter(F.exists("statuses", lambda s: s.isNotNull())).withColumn(
        "statuses", F.array_join("statuses", ",", "?")
    )


def text_matrix(docs: DataFrame) -> DataFrame:
    """doc, feature, statuses of the table rows of a text document."""
    lines = docs.select("doc", F.explode(F.split("text", "\n")).alias("line")).filter(
        F.col("line").startswith("| ") & (F.regexp_count("line", F.lit(r"\|")) >= 5)
    )
    cells = lines.select("doc", F.transform(F.split("line", r"\|"), F.btrim).alias("c"))
    return _known(cells.select(
        "doc", normal_feature(F.col("c")[1]).alias("feature"), F.transform(F.slice("c", 3, 3), normal_status).alias("statuses")
    ))


_ROW = r'(?s)<tr[^>]*>\s*<td>(.*?)</td>\s*((?:<td class="col-status">.*?</td>\s*){3})</tr>'
_CELL = r'(?s)<td class="col-status">(.*?)</td>'


def page_matrix(docs: DataFrame) -> DataFrame:
    """doc, feature, statuses of the table rows of a page."""
    rows = docs.select(
        "doc",
        F.explode(F.arrays_zip(
            F.regexp_extract_all("text", F.lit(_ROW), F.lit(1)).alias("f"), F.regexp_extract_all("text", F.lit(_ROW), F.lit(2)).alias("cells"),
        )).alias("r"),
    )
    return _known(rows.select(
        "doc", normal_feature(F.col("r.f")).alias("feature"),
        F.transform(F.regexp_extract_all(F.col("r.cells"), F.lit(_CELL), F.lit(1)), normal_status).alias("statuses"),
    ))


def matrix_parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """doc, feature, left_status, right_status, problem where two matrices of a
    document disagree. A feature listed twice counts once, the last row in text
    order deciding."""
    a = left.groupBy("doc", "feature").agg(F.max("statuses").alias("left_status"))
    b = right.groupBy("doc", "feature").agg(F.max("statuses").alias("right_status"))
    problem = (
        F.when(F.col("right_status").isNull(), "missing").when(F.col("left_status").isNull(), "extra")
        .when(F.col("left_status") != F.col("right_status"), "different")
    )
    return a.join(b, ["doc", "feature"], "full_outer").withColumn("problem", problem).filter("problem IS NOT NULL")


def version_counts(docs: DataFrame) -> DataFrame:
    """doc, version, n: list items under each version heading of a text."""
    parts = docs.select("doc", F.explode(F.split("text", r"(?m)^## ")).alias("part"))
    version = F.nullif(F.regexp_extract("part", r"^(\d+\.\d+\.\d+)", 1), F.lit(""))
    return parts.select("doc", version.alias("version"), F.regexp_count("part", F.lit(r"(?m)^- ")).cast("bigint").alias("n")).filter("version IS NOT NULL")


def register_index(registers: DataFrame, prefix: str) -> DataFrame:
    """Entries of a register text: doc, number, title, status, release, anchor,
    roadmap (entries after the defects) and ordinal, by which they sort."""
    head = rf"^({prefix}\.[0-9R]+) ([^\n]*)"
    parts = registers.select("doc", F.explode(F.split("text", rf"(?m)^## (?={prefix}\.)")).alias("part")).filter(F.col("part").rlike(head))
    number = F.regexp_extract("part", head, 1)
    title = F.btrim(F.regexp_extract("part", head, 2))
    block = F.regexp_extract("part", r"(?s)```yaml\n(.*?)```", 1)
    def meta(key: str) -> Column:
        raw = F.regexp_extract(block, rf"(?m)^\s*{key}:[ \t]*([^>\n#][^\n#]*)", 1)
        return F.nullif(F.btrim(raw), F.lit(""))
    slug = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-|-$", "")
    tail = F.element_at(F.split(number, r"\."), -1)
    return parts.select(
        "doc", number.alias("number"), title.alias("title"), F.coalesce(meta("status"), F.lit("?")).alias("status"),
        F.coalesce(meta("target"), meta("released-in"), F.lit("—")).alias("release"),
        F.concat(F.lit("#"), F.replace(number, F.lit("."), F.lit("")), F.lit("-"), slug).alias("anchor"),
        tail.startswith("R").alias("roadmap"), F.regexp_replace(tail, "^R", "").cast("bigint").alias("ordinal"),
    )
