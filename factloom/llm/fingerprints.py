"""Operator 10: document fingerprints by a threshold-scaled sketch, in SQL functions only.

A fingerprint holds every hash of the text's five-word shingles (words in lower
case for A-Z) that lies below a fixed fraction of the hash range, and always the
smallest one, so that no text with words has an empty one. What is kept does not
depend on the other shingles (but for the smallest), so fingerprints merge by
union, and the overlap of two estimates how much of the smaller text is in the
larger one, however unequal they are.

Hashes are 64-bit (xxhash64 over the words of the shingle), fingerprints the sorted
concatenation of 16 hexadecimal digits each. A text of fewer than five words is one shingle; null and empty
texts have none, and count as alike with each other only.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.tables import documents

SHINGLE_WORDS = 5
FRACTION = 1 / 8
DIGITS = 16
RANGES = 1024
_FINE = 32


def _limit(fraction: float) -> int:
    """Hashes count as unsigned; the kept ones are small, so they are not negative as signed numbers."""
    if not 0 < fraction <= 1 / 2:
        raise ValueError("the fraction is at most one half")
    return int(fraction * 2 ** 64)


def _digits(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), DIGITS, "0"))


def fingerprint(rows: DataFrame, text: str, out: str, fraction: float = FRACTION, words: int = SHINGLE_WORDS) -> DataFrame:
    """Add the fingerprint of a text column."""
    folded = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    split = F.filter(F.split(folded, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("_words", split)
    shingle = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("_words") - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("_words", i, words)))
    rows = rows.withColumn("_hashes", F.when(F.size("_words") > 0, shingle).otherwise(F.array().cast("array<bigint>"))).drop("_words")
    # Each hash list is read more than once below; the projection above keeps it from being computed again.
    small = F.filter("_hashes", lambda h: (h >= 0) & (h < _limit(fraction)))
    rows = rows.withColumn("_small", small)
    # The smallest as an unsigned number: of the non-negative ones, else of all.
    least = F.coalesce(F.array_min(F.filter("_hashes", lambda h: h >= 0)), F.array_min("_hashes"))
    kept = F.when(F.size("_small") > 0, F.array_distinct("_small")).otherwise(F.filter(F.array(least), lambda h: h.isNotNull()))
    return rows.withColumn(out, F.array_join(F.sort_array(F.transform(kept, _digits)), "")).drop("_hashes", "_small")


def hashes(fp: Column) -> Column:
    """The hashes of a fingerprint."""
    at = F.sequence(F.lit(1), F.length(fp) - DIGITS + 1, F.lit(DIGITS))
    return F.when(F.length(fp) > 0, F.transform(at, lambda i: F.substring(fp, i, F.lit(DIGITS)))).otherwise(F.array().cast("array<string>"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of the smaller text's shingles that the other has too, 0 to 1."""
    least = F.least(F.length(a), F.length(b)) / DIGITS
    both = F.size(F.array_intersect(hashes(a), hashes(b)))
    return F.when(a == b, F.lit(1.0)).when(least == 0, F.lit(0.0)).otherwise(both / least)


def merged(a: Column, b: Column) -> Column:
    """Fingerprint of two texts' shingles together.

    Only the smallest hash of all may lie above the fraction's limit.
    """
    union = F.array_union(hashes(a), hashes(b))
    return F.array_join(F.sort_array(F.filter(union, lambda h: (h < f"{_limit(FRACTION):0{DIGITS}x}") | (h == F.array_min(union)))), "")


def _range_of(id_column: str, splits: list[int]) -> Column:
    """Number of splitters up to the id; a null id is below all."""
    coarse = splits[_FINE - 1:: _FINE]
    reached = F.size(F.filter(F.array(*map(F.lit, coarse)).cast("array<bigint>"), lambda s: s <= F.col(id_column)))
    fine = F.slice(F.array(*map(F.lit, splits)).cast("array<bigint>"), reached * _FINE + 1, _FINE)
    return F.when(F.col(id_column).isNull(), F.lit(-1)).otherwise(
        reached * _FINE + F.size(F.filter(fine, lambda s: s <= F.col(id_column))))


def with_next(rows: DataFrame, id_column: str, columns: list[str], tie: str, add: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Add _next: ``columns`` of the row after each in descending order of the id; after the last comes the first.

    Rows are dealt to ranges of ids; only the first row of each range is looked at
    from outside. Equal ids follow ``tie``, null ids come last. ``add`` makes columns
    that are dear: once for every row, and once more for the first rows alone.
    """
    steps = [(k + 1) / RANGES for k in range(RANGES - 1)]
    found = rows.agg(F.percentile_approx(F.col(id_column), F.array(*map(F.lit, steps)), F.lit(10 * RANGES))).first()[0]
    rows = rows.withColumn("_range", _range_of(id_column, sorted(set(found or [])))).withColumn("_tie", F.xxhash64(tie))
    order = Window.partitionBy("_range").orderBy(F.desc_nulls_last(id_column), F.col("_tie"), F.col(tie))
    mine = add(rows).withColumn("_next", F.lead(F.struct(*columns)).over(order))
    # At most RANGES + 1 rows: id and hash of the first row of each range, then the rows that have them.
    top = rows.groupBy("_range").agg(F.max(F.struct(F.col(id_column).alias("id"), F.bitwise_not("_tie").alias("tie"))).alias("_top"))
    at_top = (F.col(id_column).eqNullSafe(F.col("_top.id"))) & (F.bitwise_not("_tie") == F.col("_top.tie"))
    first = rows.join(F.broadcast(top), "_range").filter(at_top).groupBy("_range").agg(F.min(tie).alias(tie))
    first = add(first).select("_range", F.struct(*columns).alias("_first"))
    # Each range and the one below it, the lowest followed by the highest.
    all_ranges = Window.orderBy(F.desc("_range"))
    pairs = top.select(
        "_range", F.coalesce(F.lead("_range").over(all_ranges), F.max("_range").over(all_ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_after"))
    follows = pairs.join(first.withColumnRenamed("_range", "_after"), "_after").select("_range", "_first")
    return mine.join(follows, "_range").withColumn("_next", F.coalesce("_next", "_first")).drop("_first", "_range", "_tie")


def with_edits(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edit, whose second half comes from the next document."""
    rows = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = with_next(rows, "_id", ["_text", "fingerprint"], "_text", lambda found: fingerprint(found, "_text", "fingerprint"))
    n, half = F.length("_text"), F.floor(F.length("_text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - half), F.substring(F.col("_next._text"), F.lit(1), half))
    rows = rows.select("_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", F.col("_next.fingerprint").alias("_other"))
    rows = fingerprint(rows, "edited", "edited_fingerprint")
    return rows.select(
        F.col("_id").alias(id_column), "n_chars", "edited", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_other")).alias("near_next"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_edits(documents(spark, sf_dir, "doc_id", "text"))
    return found.withColumn("edited", F.sha2("edited", 256)).withColumnRenamed("edited", "edited_sha256")


QUERIES = {"op10_fingerprints": op10_fingerprints}
# The hash is not among the SQL functions of the check; the tests recompute it.
ORACLES: dict[str, str] = {}
