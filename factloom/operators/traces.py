"""Call, return and raise events to observed signatures."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import typeexpr as X
from factloom.functions.skew import last_value_before, pick_first, previous_row, running_max, running_sum
from factloom.session import durable

PAIR_SCHEMA = (
    "fiber bigint, call_key string, call_seq bigint, return_seq bigint, raised boolean, call_payload string, "
    "return_payload string, status string, slice bigint, seq bigint, ord int, event string, epoch bigint"
)
_STEP = ["fiber", "seq", "ord", "event", "call_key", "epoch", "call_payload", "return_payload"]
# Neighbouring summaries that one step of the tree replays as one.
FAN_IN = 4


class _Replay:
    """One stack over the events of a stretch of a fiber, in order.

    A call pushes; a return pops only the frame on top and only if it has the
    same key; a raise (or ``shift``, a count of raises) moves the epoch on.

    Where a stretch is open to the left, a return that meets no frame of its own
    may belong to a call before it; where it is open to the right, frames left
    over may be returned from later. Both are passed on as ``rest`` rows, which
    with the count of raises are the summary of the stretch: replayed behind the
    summary of the stretch before, they settle as the events themselves would.
    """

    def __init__(self, fiber: int, slice_: int, out: list[tuple]) -> None:
        self.fiber, self.slice, self.out = fiber, slice_, out
        self.stack: list[tuple] = []
        self.base = self.last_seq = 0

    def step(self, seq: int, event: str, key: str, epoch: int, call_payload: str, return_payload: str, left_open: bool) -> None:
        self.last_seq = seq
        if event == "call":
            self.stack.append((key, seq, self.base + epoch, call_payload))
        elif event != "return":
            self.base += epoch
        elif self.stack and self.stack[-1][0] == key:
            _, call_seq, at, payload = self.stack.pop()
            self.out.append((self.fiber, key, call_seq, seq, self.base + epoch > at, payload, return_payload, "paired", *[None] * 5))
        elif left_open and not self.stack:
            self.out.append((self.fiber, key, None, None, None, None, return_payload, "rest", self.slice, seq, 0, "return", self.base + epoch))
        else:
            self.out.append((self.fiber, key, None, seq, None, None, return_payload, "ignored", *[None] * 5))

    def close(self, right_open: bool) -> None:
        for key, seq, epoch, payload in self.stack:
            if right_open:
                self.out.append((self.fiber, key, None, None, None, payload, None, "rest", self.slice, seq, 0, "call", epoch))
            else:
                self.out.append((self.fiber, key, seq, None, None, payload, None, "open", *[None] * 5))
        if right_open and self.base:
            self.out.append((self.fiber, None, None, None, None, None, None, "rest", self.slice, self.last_seq, 1, "shift", self.base))


def _paired(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in PAIR_SCHEMA.split(", ")])
    for c in ("call_seq", "return_seq", "slice", "seq", "epoch"):
        frame[c] = frame[c].astype("Int64")
    frame["ord"] = frame["ord"].astype("Int32")
    frame["raised"] = frame["raised"].astype("boolean")
    return frame


_OUT_ROWS = 20_000


def _slice_pass(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The events of one range slice: only its first fiber can have begun before it, only its last can go on after it."""
    out: list[tuple] = []
    replay = None
    first = True
    for frame in frames:
        rows = zip(frame["slice"].tolist(), *[frame[c].tolist() for c in _STEP], strict=True)
        for slice_, fiber, seq, _, event, key, epoch, call_payload, return_payload in rows:
            if replay is None or replay.fiber != fiber:
                if replay:
                    replay.close(False)
                    first = False
                replay = _Replay(fiber, slice_, out)
            replay.step(seq, event, key, epoch, call_payload, return_payload, first)
        if len(out) >= _OUT_ROWS:
            yield _paired(out)
            out.clear()
    if replay:
        replay.close(True)
    yield _paired(out)


def _merge_pass(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Summaries of neighbouring stretches, one behind the other; ``low`` and ``high`` are the fiber's ends."""
    out: list[tuple] = []
    replay, right_open = None, False
    for frame in frames:
        rows = zip(*[frame[c].tolist() for c in ("node", "low", "high", *_STEP)], strict=True)
        for node, low, high, fiber, seq, _, event, key, epoch, call_payload, return_payload in rows:
            if replay is None or (replay.fiber, replay.slice) != (fiber, node):
                if replay:
                    replay.close(right_open)
                replay, right_open = _Replay(fiber, node, out), node < high
            replay.step(seq, event, key, epoch, call_payload, return_payload, low < node)
        if len(out) >= _OUT_ROWS:
            yield _paired(out)
            out.clear()
    if replay:
        replay.close(right_open)
    yield _paired(out)


def pair_calls(events: DataFrame, slices: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """fiber, call_key, call_seq, return_seq, raised, call_payload,
    return_payload, status (paired, ignored, open).

    ``events``: fiber, seq, event, call_key, call_payload, return_payload. The
    events are cut into ranges of (fiber, seq), so one busy fiber is walked by
    as many tasks as it is long. What a slice can't settle is its summary:
    returns to calls before it, calls still open, and its number of raises.
    ``fan_in`` neighbouring summaries of a fiber are replayed as one, level by
    level, until none is left; a task streams them and holds open frames only.
    """
    steps = events.select(
        "fiber", "seq", F.lit(0).alias("ord"), "event", "call_key",
        F.when(F.col("event") == "raise", 1).otherwise(0).cast("bigint").alias("epoch"), "call_payload", "return_payload",
    )
    ranged = steps.repartitionByRange(slices, "fiber", "seq") if slices else steps.repartitionByRange("fiber", "seq")
    sliced = ranged.withColumn("slice", F.spark_partition_id()).sortWithinPartitions("fiber", "seq", "ord")
    # Every level is written: results and summaries come from the same cuts.
    level = durable(sliced.mapInPandas(_slice_pass, PAIR_SCHEMA))
    settled = []
    while True:
        settled.append(level.filter("status <> 'rest'"))
        rest = level.filter("status = 'rest'").select("slice", *_STEP)
        if rest.isEmpty():
            break
        node = F.floor(F.col("slice") / fan_in).cast("bigint")
        ends = rest.groupBy("fiber").agg(F.min(node).alias("low"), F.max(node).alias("high"))
        nodes = rest.withColumn("node", node).drop("slice").join(ends, "fiber")
        dealt = nodes.repartition("fiber", "node").sortWithinPartitions("fiber", "node", "seq", "ord")
        level = durable(dealt.mapInPandas(_merge_pass, PAIR_SCHEMA))
    return reduce(DataFrame.unionByName, settled).drop("slice", "seq", "ord", "event", "epoch")


def call_depth(pairs: DataFrame, bucket: int = 100_000) -> DataFrame:
    """fiber, call_seq, depth: open frames right after each call."""
    opened = pairs.filter("call_seq IS NOT NULL").select("fiber", F.col("call_seq").alias("seq"), F.lit(1).alias("d"))
    closed = pairs.filter("status = 'paired'").select("fiber", F.col("return_seq").alias("seq"), F.lit(-1).alias("d"))
    moves = opened.unionByName(closed)
    depth = running_sum(moves, ["fiber"], F.floor(F.col("seq") / bucket), [F.col("seq")], F.col("d"), "depth")
    return depth.filter("d = 1").select("fiber", F.col("seq").alias("call_seq"), "depth")


def epoch_of(events: DataFrame, bucket: int = 100_000) -> DataFrame:
    """Adds ``epoch``: raises of the fiber up to and including each event."""
    raised = F.when(F.col("event") == "raise", 1).otherwise(0)
    return running_sum(events, ["fiber"], F.floor(F.col("seq") / bucket), [F.col("seq")], raised, "epoch")


def counted_return(value: Column, raised: Column) -> Column:
    """Return type a sample contributes: a value always, ``nil`` only when
    nothing was raised since the call."""
    return F.when(value.isNotNull(), value).when(~raised, F.lit(X.NIL))


def observed_signatures(pairs: DataFrame) -> DataFrame:
    """symbol, parameter_types(array), return_type, samples, fingerprint.

    ``pairs``: symbol, call_seq, arg_types(array), return_type (null when none
    counts), fingerprint. Types are made distinct per slot before they are
    collected, so no group is larger than its number of types.
    """
    slots = (
        pairs.select("symbol", F.posexplode("arg_types").alias("slot", "t")).distinct()
        .groupBy("symbol", "slot").agg(X.union_types(F.collect_list("t")).alias("t"))
        .groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("slot", "t"))).alias("s"))
        .select("symbol", F.col("s.t").alias("parameter_types"))
    )
    returns = X.union_agg(pairs.filter("return_type IS NOT NULL"), ["symbol"], "return_type", "return_type")
    totals = pairs.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("samples"), F.min_by("fingerprint", "call_seq").alias("fingerprint")
    )
    return totals.join(slots, "symbol", "left").join(returns, "symbol", "left").select(
        "symbol", F.coalesce("parameter_types", F.array().cast("array<string>")).alias("parameter_types"),
        F.coalesce("return_type", F.lit(X.UNKNOWN)).alias("return_type"), "samples", "fingerprint",
    )


def run_totals(runs: DataFrame, signatures: DataFrame) -> DataFrame:
    """run_id, sample_count, method_count; a failed run counts nothing.

    ``runs``: run_id, ok; ``signatures``: run_id, samples."""
    sums = signatures.groupBy("run_id").agg(F.sum("samples").alias("s"), F.count(F.lit(1)).alias("m"))
    zero = F.lit(0).cast("bigint")
    return runs.join(sums, "run_id", "left").select(
        "run_id",
        F.when(F.col("ok"), F.coalesce("s", zero)).otherwise(zero).alias("sample_count"),
        F.when(F.col("ok"), F.coalesce("m", zero)).otherwise(zero).alias("method_count"),
    )


def current_evidence(runs: DataFrame, signatures: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Signatures of the latest successful run whose code is still the same.

    ``runs``: repo, run_id, ok, finished; ``fingerprints``: repo, symbol,
    fingerprint."""
    latest = runs.filter("ok").groupBy("repo").agg(F.max_by("run_id", F.struct("finished", "run_id")).alias("run_id"))
    replaced = signatures.join(latest, ["repo", "run_id"], "left_semi")
    return invalidate_changed(replaced, fingerprints)


def invalidate_changed(signatures: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Evidence whose fingerprint still is the current one."""
    return signatures.join(fingerprints.select("repo", "symbol", "fingerprint"), ["repo", "symbol", "fingerprint"], "left_semi")


def fingerprint(text: Column, line: Column) -> Column:
    return F.concat(F.sha2(F.encode(text, "UTF-8"), 256), F.lit(":"), line.cast("string"))


def publish_latest(results: DataFrame, bucket: int = 100_000) -> DataFrame:
    """Results that may be shown: of the buffer open at that moment, and not
    older than one already shown for it. A result without a generation is only
    held back by a higher version.

    ``results``: uri, arrival, buffer_id (rising as buffers are opened), version,
    generation."""
    order, b = [F.col("arrival")], F.floor(F.col("arrival") / bucket)
    opened = running_max(results, ["uri"], b, order, F.col("buffer_id"), "_open")
    ranked = running_max(opened, ["uri", "buffer_id"], b, order, F.struct("version", "generation"), "_best")
    dated = F.col("generation").isNull() | (F.col("generation") == F.col("_best.generation"))
    shown = (F.col("buffer_id") == F.col("_open")) & (F.col("version") == F.col("_best.version")) & dated
    return ranked.filter(shown).drop("_open", "_best")


def publish_open(results: DataFrame, buffers: DataFrame, bucket: int = 100_000) -> DataFrame:
    """Results that may be shown while buffers are opened, edited and closed.

    ``buffers``: uri, seq, kind (open, edit, close), buffer_id, version; an edit counts
    for the buffer that is open. ``results``: uri, seq, buffer_id, version,
    generation; one without a version was read from disk.

    A result from disk is shown only while no buffer is open; any other one only if it
    is of the open buffer, of no version that is still to come, and not older than one
    shown before; of two results about one version the earlier generation gives way,
    where one without a generation leaves the last known one standing. A close
    forgets all of this.

    Both tables run as one line per file, spread over stretches of ``bucket``; what
    was last opened, closed or edited is carried along it.
    """
    moved = buffers.select("uri", "seq", F.lit(0).alias("side"), "kind", "buffer_id", "version")
    shown = results.select(
        "uri", "seq", F.lit(1).alias("side"), F.lit("result").alias("kind"), "buffer_id", "version", "generation")
    line = moved.unionByName(shown, allowMissingColumns=True)
    at, order = F.floor(F.col("seq") / bucket), [F.col("seq"), F.col("side")]
    kind = F.col("kind")
    door = F.when(kind.isin("open", "close"), F.struct(kind.alias("kind"), "buffer_id"))
    line = last_value_before(line, ["uri"], at, order, door, "_door")
    line = last_value_before(line, ["uri"], at, order, F.when(kind.isin("open", "edit"), F.col("version")), "_edited")
    line = running_sum(line, ["uri"], at, order, F.when(kind == "close", 1).otherwise(0), "_life")
    is_open = F.coalesce(F.col("_door.kind") == "open", F.lit(False))
    asked = line.filter("side = 1").withColumn("_is_open", is_open)
    from_disk = asked.filter("version IS NULL AND NOT _is_open")
    current = asked.filter(F.col("_is_open") & (F.col("buffer_id") == F.col("_door.buffer_id")) & (F.col("version") <= F.col("_edited")))
    order = [F.col("seq")]
    newest = running_max(current, ["uri", "_life", "buffer_id"], at, order, F.col("version"), "_newest").filter("version = _newest")
    before = previous_row(newest, ["uri", "_life"], at, order, ["buffer_id", "version"], "_p_")
    same = (F.col("_p_buffer_id") == F.col("buffer_id")) & (F.col("_p_version") == F.col("version"))
    fresh = ~F.coalesce(same, F.lit(False)) & F.col("generation").isNotNull()
    known = running_sum(before, ["uri", "_life"], at, order, F.when(fresh, 1).otherwise(0), "_run")
    dated = running_max(known, ["uri", "_life", "_run"], at, order, F.col("generation"), "_best")
    good = dated.filter(F.col("generation").isNull() | (F.col("generation") == F.col("_best")))
    columns = ["uri", "seq", "buffer_id", "version", "generation"]
    return good.select(*columns).unionByName(from_disk.select(*columns))


def coalesce_changes(changes: DataFrame, gap_seconds: int) -> DataFrame:
    """uri, first_ts, n, version: one analysis per burst of changes, of its last
    version. A burst ends when nothing follows within the gap.

    The changes of one file are spread over stretches of time, so a file that is
    edited all day is not one task's work."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    stretch = F.floor(at / (64 * gap_seconds * 1_000_000))
    order = [F.col("ts"), F.col("version")]
    prev = previous_row(changes, ["uri"], stretch, order, ["ts"], "_p_")
    fresh = F.when(at < F.unix_micros(F.col("_p_ts").cast("timestamp")) + gap_seconds * 1_000_000, 0).otherwise(1)
    numbered = running_sum(prev.withColumn("_f", fresh).drop("_p_ts"), ["uri"], stretch, order, F.col("_f"), "burst")
    return numbered.groupBy("uri", "burst").agg(
        F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n"), F.max("version").alias("version")
    ).drop("burst")


def collapse_requests(requests: DataFrame, passes: DataFrame) -> DataFrame:
    """repo, start of the passes that really run, and the requests each serves: a
    pass that begins takes every request made before it that no earlier one took;
    one without a request is not run.

    ``requests``: repo, at; ``passes``: repo, start (possible starts, at any time).
    Both run as one sequence, spread over days."""
    begins = passes.select("repo", F.col("start").alias("at"), F.lit(0).alias("asked")).distinct()
    line = begins.union(requests.select("repo", "at", F.lit(1).alias("asked")))
    day, order = F.to_date("at"), [F.col("at"), F.col("asked")]
    counted = running_sum(line, ["repo"], day, order, F.col("asked"), "so_far").filter("asked = 0")
    before = previous_row(counted, ["repo"], day, [F.col("at")], ["so_far"], "_p_")
    n = F.col("so_far") - F.coalesce("_p_so_far", F.lit(0))
    return before.select("repo", F.col("at").alias("start"), n.alias("n")).filter("n > 0")


def evidence_lookup(requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """receiver_type, name, return_type from (receiver_type, receiver, name,
    rank, symbol): the first symbol with evidence per receiver (the exact one
    has rank -1), an Unknown answer counting as none, members combined."""
    hits = requests.join(evidence.select("symbol", F.col("return_type").alias("t")), "symbol")
    first = pick_first(hits, ["receiver_type", "receiver", "name"], [F.col("rank")], ["t"])
    return X.union_agg(first.filter(F.col("t") != X.UNKNOWN), ["receiver_type", "name"], "t", "return_type")
