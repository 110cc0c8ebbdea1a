"""Snapshot maintenance: what changed, what wins, what is kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.skew import pick_first, pick_last


def content_hash(text: Column | str) -> Column:
    return F.sha2(F.encode(F.col(text) if isinstance(text, str) else text, "UTF-8"), 256)


def dedup_physical(files: DataFrame) -> DataFrame:
    """Each real file once, under its first logical path."""
    rest = [c for c in files.columns if c != "real_path"]
    return pick_first(files, ["real_path"], [F.col("path")], rest).select(*files.columns)


def incremental_diff(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """uri, change in new/changed/unchanged/deleted. Texts are reduced to their
    hash before the join, so they are never shuffled."""
    p = prev.select("uri", content_hash("text").alias("old"))
    c = cur.select("uri", content_hash("text").alias("new"))
    change = (
        F.when(F.col("old").isNull(), "new")
        .when(F.col("new").isNull(), "deleted")
        .when(F.col("old") == F.col("new"), "unchanged")
        .otherwise("changed")
    )
    return p.join(c, "uri", "full_outer").select("uri", change.alias("change"))


def sweep(facts: DataFrame, seen: DataFrame, complete: DataFrame, key: str = "uri") -> DataFrame:
    """Rows of files that are still there. ``complete`` is one row with the
    boolean ``complete``; an incomplete scan removes nothing."""
    gone = (
        facts.select(key).distinct()
        .join(seen.select(key).distinct(), key, "left_anti")
        .filter(complete.select("complete").scalar())
    )
    return facts.join(gone, key, "left_anti")


def scan_completeness(scan: DataFrame) -> DataFrame:
    """One row: files seen and whether every one of them could be read."""
    return scan.agg(
        F.count(F.when(F.col("ok"), 1)).alias("n_seen"),
        F.count(F.when(~F.col("ok"), 1)).alias("n_errors"),
        F.coalesce(F.bool_and("ok"), F.lit(True)).alias("complete"),
    )


def replace_file(facts: DataFrame, incoming: DataFrame, key: str = "uri") -> DataFrame:
    """All rows of an incoming file replace all earlier rows of that file. A
    file whose hash did not change keeps its rows; only its source is raised
    from disk to buffer."""
    state = facts.select(key, F.col("content_hash").alias("_h")).distinct()
    arriving = incoming.select(key, F.col("content_hash").alias("_h"), F.col("source").alias("_src")).distinct()
    same = arriving.join(state, [key, "_h"], "left_semi").select(key, "_src")
    changed = arriving.join(state, [key, "_h"], "left_anti").select(key).distinct()
    kept = facts.join(changed, key, "left_anti").join(same, key, "left").withColumn(
        "source", F.when(F.col("_src") == "buffer", "buffer").otherwise(F.col("source"))
    ).drop("_src")
    return kept.unionByName(incoming.join(changed, key, "left_semi"))


def commit_updates(table: DataFrame, upserts: DataFrame, removals: DataFrame, key: str) -> DataFrame:
    """Partial refresh: removals and upserts applied to a copy, in one swap."""
    touched = removals.select(key).unionByName(upserts.select(key)).distinct()
    return table.join(touched, key, "left_anti").unionByName(upserts)


def latest_versions(summaries: DataFrame) -> DataFrame:
    """The summary in force per file after all of them arrived.

    A buffer beats the disk; a different buffer takes over when it arrives; one
    buffer is ordered by document version (a missing version is accepted as it
    arrives); disk reads by read sequence. ``arrival`` orders the input.
    """
    keys = ["uri"]
    buffers = summaries.filter(F.col("source") == "buffer")
    # The buffer that arrived last under a new identity is the one in force;
    # its own rows compete by version, later arrival winning ties.
    opened = pick_last(buffers, keys, [F.col("arrival")], ["buffer_id"])
    # The in-force stretch starts after the last arrival of any other buffer.
    current = opened.withColumnRenamed("buffer_id", "_b")
    tagged = buffers.join(current, keys)
    start = tagged.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(~F.col("buffer_id").eqNullSafe(F.col("_b")), F.col("arrival"))), F.lit(-1)).alias("_from")
    )
    stretch = tagged.join(start, keys).filter(F.col("arrival") > F.col("_from"))
    # Within it a row without a version resets the comparison.
    reset = stretch.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("document_version").isNull(), F.col("arrival"))), F.lit(-1)).alias("_null_at")
    )
    live = stretch.join(reset, keys).filter(F.col("arrival") >= F.col("_null_at"))
    # The row right after a reset is accepted whatever its version, and from
    # there versions only rise; the largest version therefore wins.
    cols = [c for c in summaries.columns if c not in keys]
    best_buffer = pick_last(live, keys, [F.coalesce("document_version", F.lit(-1)), F.col("arrival")], cols)
    disk = summaries.filter(F.col("source") == "disk").join(buffers.select(*keys).distinct(), keys, "left_anti")
    best_disk = pick_last(disk, keys, [F.col("read_sequence"), F.col("arrival")], cols)
    return best_buffer.unionByName(best_disk).select(*summaries.columns)


KEY_PARTS = ("schema", "tool", "runtime", "parser", "workspace", "lockfile", "signatures", "settings")


def snapshot_key(parts: Sequence[Column | str] = KEY_PARTS) -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p for p in parts]), 256)


def inputs_fingerprint(files: DataFrame, group: str) -> DataFrame:
    """Fingerprint of each file set: group, n_files, fingerprint.

    The same scheme for every size, in no order: four 60-bit parts of the SHA-256
    of each entry are summed over the set, before the shuffle as well as after.
    """
    entry = F.sha2(F.concat_ws(":", "path", F.col("mtime").cast("string"), F.col("size").cast("string")), 256)
    parts = [F.conv(F.substring(entry, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)") for k in range(4)]
    sums = files.groupBy(group).agg(F.count(F.lit(1)).alias("n_files"), *[F.sum(p).alias(f"_p{k}") for k, p in enumerate(parts)])
    digest = F.sha2(F.concat_ws("|", *[F.col(f"_p{k}").cast("string") for k in range(4)]), 256)
    return sums.select(group, "n_files", digest.alias("fingerprint"))


def _cutoff(rows: DataFrame, keys: Sequence[str], order: Sequence[str], keep: int) -> DataFrame:
    """The order key of the ``keep``-th newest row per group, where it exists."""
    key = F.struct(*order)
    spread = rows.select(*keys, key.alias("_o")).withColumn("_salt", F.pmod(F.xxhash64("_o"), F.lit(32)))
    newest = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(F.desc("_o")))
    near = spread.withColumn("_r", newest).filter(F.col("_r") <= keep)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_o")))
    return near.withColumn("_n", rank).filter(F.col("_n") == keep).select(*keys, F.col("_o").alias("_cut"))


def retain_newest(rows: DataFrame, keys: Sequence[str], order: Sequence[str], keep: int) -> DataFrame:
    """Adds ``keep``: whether a row is among the newest ``keep`` of its group.
    Only the cut-off is searched for; the group itself is never sorted whole."""
    cut = _cutoff(rows, keys, order, keep)
    flagged = rows.join(cut, list(keys), "left")
    kept = F.col("_cut").isNull() | (F.struct(*order) >= F.col("_cut"))
    return flagged.withColumn("keep", kept).drop("_cut")


# How much is retained.
KEEP_GENERATIONS = 8
KEEP_ENTRIES = 20_000
ABSENT_GRACE_SECONDS = 30 * 24 * 60 * 60
UNMARKED_GRACE_SECONDS = 60 * 60


def retain_generations(snapshots: DataFrame, keep: int = KEEP_GENERATIONS) -> DataFrame:
    """The current snapshot of a workspace plus its newest others. Columns
    workspace, snapshot, mtime (null sorts oldest), is_current; adds keep."""
    others = snapshots.filter("NOT is_current").withColumn("_m", F.coalesce(F.col("mtime"), F.lit(0)))
    ranked = retain_newest(others, ["workspace"], ["_m", "snapshot"], keep - 1).drop("_m")
    return ranked.unionByName(snapshots.filter("is_current").withColumn("keep", F.lit(True)))


def retain_entries(entries: DataFrame, limit: int = KEEP_ENTRIES) -> DataFrame:
    """The oldest entries beyond ``limit`` of a store are dropped."""
    return retain_newest(entries, ["store"], ["mtime", "entry"], limit)


def retain_workspaces(scopes: DataFrame, existing: DataFrame, now: Column) -> DataFrame:
    """scope, keep. ``scopes``: scope, workspace (null when unmarked), age base
    ``mtime`` in seconds, is_current; ``existing``: workspace."""
    there = existing.select(F.col("workspace")).distinct().withColumn("_there", F.lit(True))
    age = now - F.col("mtime")
    drop = F.when(F.col("workspace").isNull(), age >= UNMARKED_GRACE_SECONDS).otherwise(
        F.col("_there").isNull() & (age >= ABSENT_GRACE_SECONDS)
    )
    return scopes.join(there, "workspace", "left").select("scope", (F.col("is_current") | ~drop).alias("keep"))


def supersede(passes: DataFrame) -> DataFrame:
    """Passes of an older generation than the newest of their repository."""
    newest = passes.groupBy("repo").agg(F.max("generation").alias("_g"))
    return passes.join(newest, "repo").withColumn(
        "status", F.when(F.col("generation") < F.col("_g"), "superseded").otherwise("current")
    ).drop("_g")


def affected_by_cap(uris: DataFrame, group: str, cap: int) -> DataFrame:
    """The first ``cap`` uris of each group in text order, as an option for
    callers that want a bounded pass: group, uri, truncated."""
    cut = _cutoff_ascending(uris, group, cap)
    size = uris.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    return (
        uris.join(cut, group, "left").join(size, group)
        .filter(F.col("_cut").isNull() | (F.col("uri") <= F.col("_cut")))
        .select(group, "uri", (F.col("_n") > cap).alias("truncated"))
    )


def _cutoff_ascending(uris: DataFrame, group: str, cap: int) -> DataFrame:
    spread = uris.withColumn("_salt", F.pmod(F.xxhash64("uri"), F.lit(32)))
    first = F.row_number().over(Window.partitionBy(group, "_salt").orderBy("uri"))
    near = spread.withColumn("_r", first).filter(F.col("_r") <= cap)
    rank = F.row_number().over(Window.partitionBy(group).orderBy("uri"))
    return near.withColumn("_k", rank).filter(F.col("_k") == cap).select(group, F.col("uri").alias("_cut"))
