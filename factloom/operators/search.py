"""Ranked symbol search and positional lookups for many questions at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import names as N
from factloom.functions.skew import previous_row, top_k

SEARCH_LIMIT = 100
_SITE = ("name", "uri", "line", "col", "kind", "owner")


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of length 1 to ``size``."""
    n = F.length(text)
    def of(k: int) -> Column:
        last = n - k + 1
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substr(text, i, F.lit(k)))
    return F.array_distinct(F.concat(*[of(k) for k in range(1, size + 1)]))


def _matching_keys(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """qid, _q, _key: queries (lower case) and the simple names that contain them.

    A query meets the dictionary of distinct names through its rarest run of three
    characters.
    """
    grams = keys.select("_key", F.explode(_grams(F.col("_key"), 3)).alias("_g"))
    asked = queries.select("qid", F.lower("text").alias("_q")).distinct()
    size = F.least(F.length("_q"), F.lit(3))
    starts = F.sequence(F.lit(1), F.length("_q") - size + 1)
    runs = asked.filter("_q <> ''").select("qid", "_q", F.explode(F.transform(starts, lambda i: F.substr(F.col("_q"), i, size))).alias("_g"))
    frequency = grams.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    rarest = runs.join(frequency, "_g").groupBy("qid", "_q").agg(F.min_by("_g", F.struct("_n", "_g")).alias("_g"))
    return rarest.join(grams, "_g").filter(F.col("_key").contains(F.col("_q"))).select("qid", "_q", "_key")


def workspace_matches(queries: DataFrame, declarations: DataFrame) -> DataFrame:
    """qid, exact and the site of every match: the simple name contains the query
    whatever its case. ``queries``: qid, text; ``declarations``: kind, owner, name,
    uri, line, col."""
    sited = declarations.withColumn("_key", N.simple_name_key("name"))
    hits = _matching_keys(queries, sited.select("_key").distinct())
    return hits.join(sited, "_key").select("qid", (F.col("_key") == F.col("_q")).alias("exact"), *_SITE)


def workspace_search(queries: DataFrame, declarations: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """qid, rank and the site of the first ``limit`` matches: exact ones first, then
    by name and place. Each simple name brings at most ``limit`` sites."""
    sited = declarations.withColumn("_key", N.simple_name_key("name"))
    order = [F.coalesce(F.col(c), F.lit("")) if c == "owner" else F.col(c) for c in _SITE]
    sites = top_k(sited, ["_key"], order, limit).drop("rank")
    matches = _matching_keys(queries, sited.select("_key").distinct()).join(sites, "_key").withColumn(
        "_exact", F.when(F.col("_key") == F.col("_q"), 0).otherwise(1))
    return top_k(matches.drop("_q"), ["qid"], [F.col("_exact"), *order], limit).select("qid", "rank", *_SITE)


def _prefixed(queries: DataFrame, keyed: DataFrame) -> DataFrame:
    """qid, _q, _key: queries (lower case) and the simple names that start with them."""
    key = F.col("_key")
    heads = F.transform(F.sequence(F.lit(1), F.length(key)), lambda k: F.substr(key, F.lit(1), k))
    prefixes = keyed.select("_key").distinct().select("_key", F.explode(heads).alias("_q"))
    return queries.select("qid", F.lower("text").alias("_q")).distinct().join(prefixes, "_q")


def _keyed(symbols: DataFrame, kinds: Sequence[str]) -> DataFrame:
    return symbols.filter(F.col("kind").isin(*kinds)).select("name", "kind", "owner").distinct().withColumn("_key", N.simple_name_key("name"))


def prefix_matches(queries: DataFrame, symbols: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """qid, exact, name, kind, owner of every symbol whose simple name starts with the query."""
    keyed = _keyed(symbols, kinds)
    return _prefixed(queries, keyed).join(keyed, "_key").select("qid", (F.col("_key") == F.col("_q")).alias("exact"), "name", "kind", "owner")


def prefix_search(queries: DataFrame, symbols: DataFrame, kinds: Sequence[str], limit: int) -> DataFrame:
    """qid, rank, name, kind, owner of the first ``limit`` symbols whose simple name
    starts with the query: exact first, then name, kind, owner."""
    keyed = _keyed(symbols, kinds)
    order = [F.col("name"), F.col("kind"), F.coalesce("owner", F.lit(""))]
    best = top_k(keyed, ["_key"], order, limit).drop("rank")
    exact = F.when(F.col("_key") == F.col("_q"), 0).otherwise(1)
    hits = _prefixed(queries, keyed).join(best, "_key").withColumn("_exact", exact).drop("_q")
    return top_k(hits, ["qid"], [F.col("_exact"), *order], limit).select("qid", "rank", "name", "kind", "owner")


def find_by_simple_name(queries: DataFrame, types: DataFrame) -> DataFrame:
    """qid, name, kind, uri, line of types and constants with exactly that last segment."""
    named = types.filter(F.col("kind").isin("class", "module", "constant")).withColumn("text", N.simple_name("name"))
    return queries.join(named, "text").select("qid", "name", "kind", "uri", "line")


MAX_COMPLETIONS = 50
CALLABLE_KINDS = ("method", "function")


def prefix_completion(items: DataFrame, limit: int = MAX_COMPLETIONS) -> DataFrame:
    """qid, label, kind, group, rank, incomplete from (qid, label, kind, group).

    A label appears once as a callable and once as anything else, from the first
    group offering it; the list is cut at ``limit`` and says so."""
    flagged = items.withColumn("callable", F.col("kind").isin(*CALLABLE_KINDS))
    once = flagged.groupBy("qid", "label", "callable").agg(F.min(F.struct("group", "kind")).alias("m")).select(
        "qid", "label", "callable", "m.group", "m.kind"
    )
    size = once.groupBy("qid").agg(F.count(F.lit(1)).alias("_n"))
    kept = top_k(once, ["qid"], [F.col("group"), F.col("label"), F.col("callable")], limit)
    return kept.join(size, "qid").select("qid", "label", "kind", "group", "rank", (F.col("_n") > limit).alias("incomplete"))


def innermost_range(positions: DataFrame, ranges: DataFrame, block: int = 64) -> DataFrame:
    """The smallest range around each position.

    ``positions``: uri, pid, line, col; ``ranges``: uri, rid, sl, sc, el, ec.
    Both sides meet on blocks of lines, so a position is compared with the
    ranges of its neighbourhood and not with the whole file.
    """
    blocks = F.sequence(F.floor(F.col("sl") / block), F.floor(F.col("el") / block))
    spread = ranges.withColumn("_b", F.explode(blocks))
    placed = positions.withColumn("_b", F.floor(F.col("line") / block))
    at = F.struct(F.col("line").alias("l"), F.col("col").alias("c"))
    start, end = F.struct(F.col("sl").alias("l"), F.col("sc").alias("c")), F.struct(F.col("el").alias("l"), F.col("ec").alias("c"))
    inside = placed.join(spread, ["uri", "_b"]).filter((start <= at) & (at <= end))
    span = F.struct(F.col("el") - F.col("sl"), F.col("ec") - F.col("sc"), F.col("rid"))
    return inside.groupBy("uri", "pid").agg(F.min_by("rid", span).alias("rid"))


def delta_encode(tokens: DataFrame, bucket_lines: int = 1024) -> DataFrame:
    """Adds delta_line and delta_col to (uri, line, col, …): distance to the
    token before it, the column absolute on a new line."""
    bucket = F.floor(F.col("line") / bucket_lines)
    prev = previous_row(tokens, ["uri"], bucket, [F.col("line"), F.col("col")], ["line", "col"], "_p_")
    down = F.col("line") - F.coalesce("_p_line", F.lit(0))
    across = F.when(down == 0, F.col("col") - F.coalesce("_p_col", F.lit(0))).otherwise(F.col("col"))
    return prev.withColumns({"delta_line": down, "delta_col": across}).drop("_p_line", "_p_col")


def callback_replay(operations: DataFrame) -> DataFrame:
    """key, name, ord of the callbacks left after adds and skips in order.

    ``operations``: key, ord, verb (add/skip), name, selector (applicable,
    excluded, unresolved). A skip removes every earlier add of the name, so an
    add survives when no skip of its name follows."""
    counted = operations.filter(
        (F.col("selector") != "excluded") & ~((F.col("verb") == "add") & (F.col("selector") == "unresolved"))
    )
    skipped = counted.filter(F.col("verb") == "skip").groupBy("key", "name").agg(F.max("ord").alias("_skip"))
    adds = counted.filter(F.col("verb") == "add").join(skipped, ["key", "name"], "left")
    return adds.filter(F.col("_skip").isNull() | (F.col("ord") > F.col("_skip"))).select("key", "name", "ord")
