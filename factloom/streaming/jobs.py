"""Structured Streaming forms of the trace and change jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factloom.functions import typeexpr as X
from factloom.operators import traces as T
from factloom.sources.sinks import scratch_dir

PAIRED = "fiber bigint, call_key string, call_seq bigint, return_seq bigint, raised boolean, call_payload string, return_payload string, status string"
_EVENT = ["seq", "event", "call_key", "call_payload", "return_payload"]
_FRAME = "call_key string, call_seq bigint, epoch bigint, call_payload string"
# How long a fiber may be silent before its open frames are given up.
FRAME_TTL_MS = 3_600_000


class CallStack(StatefulProcessor):
    """One stack per fiber that is touched only where a batch moves it.

    Frames lie in a map by depth, so a batch writes the frames it leaves open and
    removes those it pops from below; what it both opens and closes never reaches
    the state. Depth, epoch and last place are one small value. An event that is not
    behind the last place of its fiber comes too late to be put in order and is
    reported as ``late``. With ``ttl_ms``, a timer gives up the frames of a fiber
    that has been silent for so long (``abandoned``) and forgets the fiber.
    """

    def __init__(self, ttl_ms: int | None) -> None:
        self._ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._frames = handle.getMapState("frames", "depth bigint", _FRAME)
        self._place = handle.getValueState("place", "depth bigint, epoch bigint, last_seq bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fiber, out = key[0], []
        depth, epoch, last = self._place.get() if self._place.exists() else (0, 0, None)
        below, opened = depth, []  # frames in the state, frames of this batch above them
        for batch in self._in_order(rows):
            for seq, event, call_key, call_payload, return_payload in zip(*[batch[c].tolist() for c in _EVENT], strict=True):
                if last is not None and seq <= last:
                    called = event == "call"
                    out.append((fiber, call_key, seq if called else None, None if called else seq, None, call_payload, return_payload, "late"))
                    continue
                last = seq
                if event == "call":
                    opened.append((call_key, seq, epoch, call_payload))
                elif event == "raise":
                    epoch += 1
                else:
                    top = opened[-1] if opened else tuple(self._frames.getValue((below,))) if below else None
                    if top and top[0] == call_key:
                        if opened:
                            opened.pop()
                        else:
                            self._frames.removeKey((below,))
                            below -= 1
                        out.append((fiber, call_key, top[1], seq, epoch > top[2], top[3], return_payload, "paired"))
                    else:
                        out.append((fiber, call_key, None, seq, None, None, return_payload, "ignored"))
        for at, frame in enumerate(opened, below + 1):
            self._frames.updateValue((at,), frame)
        if last is not None:
            self._place.update((below + len(opened), epoch, last))
        if self._ttl is not None:
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(self._now(timerValues) + self._ttl)
        yield _frame(out)

    @staticmethod
    def _in_order(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.concat(list(rows)).sort_values("seq", kind="stable")

    @staticmethod
    def _now(timer_values) -> int:
        return timer_values.getCurrentProcessingTimeInMs()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        depth = self._place.get()[0] if self._place.exists() else 0
        frames = [self._frames.getValue((at,)) for at in range(1, depth + 1)]
        self._frames.clear()
        self._place.clear()
        yield _frame([(key[0], k, seq, None, None, payload, None, "abandoned") for k, seq, _, payload in frames])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in PAIRED.split(", ")])
    for c in ("call_seq", "return_seq"):
        out[c] = out[c].astype("Int64")
    out["raised"] = out["raised"].astype("boolean")
    return out


def pair_stream(events: DataFrame, ttl_ms: int | None = FRAME_TTL_MS) -> DataFrame:
    """Call/return pairing on a stream of (fiber, seq, event, call_key, call_payload,
    return_payload): paired, ignored and late events as they come.

    Frames of a fiber that is silent for ``ttl_ms`` of processing time are given up
    as ``abandoned``; with None they stay, which suits a job that only drains what is
    there. Needs the RocksDB state store.
    """
    return events.groupBy("fiber").transformWithStateInPandas(
        CallStack(ttl_ms), PAIRED, "Append", "None" if ttl_ms is None else "ProcessingTime")


def trace_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of trace events."""
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    raw = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)
    )
    kind = F.col("event_type")
    return raw.select(
        F.col("user_id").alias("fiber"), F.col("event_id").alias("seq"), "ts",
        F.when(kind.isin("click", "view"), "call").when(kind == "error", "raise").otherwise("return").alias("event"),
        F.when(kind.isin("click", "purchase"), "A").otherwise("B").alias("call_key"),
        F.when(F.col("value") < 50, "Integer").otherwise("Float").alias("call_payload"),
        F.when(F.col("value") < 20, None).when(F.col("value") < 60, "String").otherwise("User").alias("return_payload"),
    )


SAMPLES = "symbol string, call_seq bigint, arg_types array<string>, fingerprint string, return_type string"


def samples_of(pairs: DataFrame) -> DataFrame:
    """One sample per pair, as ``observed_signatures`` takes them."""
    return pairs.filter("status = 'paired'").select(
        F.concat(F.lit("::U"), (F.col("fiber") % 10).cast("string"), F.lit("#"), "call_key").alias("symbol"), "call_seq",
        F.array("call_payload").alias("arg_types"), F.lit("").alias("fingerprint"),
        T.counted_return(F.col("return_payload"), F.col("raised")).alias("return_type"),
    )


def observed_updates(samples: DataFrame) -> DataFrame:
    """Streaming form of ``observed_signatures``, for update mode: the row of every
    symbol that a batch has touched, over all of its samples so far.

    The state of a symbol is its sets of types by slot, not its samples.
    """
    slots = F.transform("arg_types", lambda t, i: F.struct(i.alias("slot"), t.alias("t")))
    seen = samples.withColumn("slots", slots).groupBy("symbol").agg(
        F.collect_set("slots").alias("slot_lists"), F.collect_set("return_type").alias("returns"),
        F.count(F.lit(1)).alias("samples"), F.min_by("fingerprint", "call_seq").alias("fingerprint"),
    )
    flat = F.flatten("slot_lists")
    count = F.coalesce(F.array_max(F.transform(flat, lambda x: x["slot"])) + 1, F.lit(0))
    of_slot = lambda i: X.union_types(F.array_distinct(F.transform(F.filter(flat, lambda x: x["slot"] == i), lambda x: x["t"])))
    return seen.select(
        "symbol", F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), of_slot)).otherwise(F.array().cast("array<string>")).alias("parameter_types"),
        F.when(F.size("returns") > 0, X.union_types(F.col("returns"))).otherwise(F.lit(X.UNKNOWN)).alias("return_type"), "samples", "fingerprint",
    )


def _drain(stream: DataFrame, folder: str, name: str, mode: str = "append") -> None:
    """Append what a stream emits to a table by exactly-once files, until its source is dry.

    Updates go there with their batch, a batch that is run again replacing itself. An
    empty file goes first, so that the table is there when nothing is emitted.
    """
    first = f"{folder}/{name}" if mode == "append" else f"{folder}/{name}/batch=-1"
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("append").parquet(first)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress-{name}").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{folder}/{name}")
    else:
        writer = writer.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}"))
    writer.start().awaitTermination()


def latest_updates(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest row of every key from a table of updates."""
    rows = spark.read.parquet(path)
    value = [c for c in rows.columns if c not in (key, "batch")]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*value), "batch").alias("v"))
    return newest.select(key, "v.*")


def observe(events: DataFrame, folder: str) -> DataFrame:
    """Observed signatures of all that a stream holds now: one query appends pairs,
    the next one reads them as a stream and updates the signatures by symbol."""
    spark = events.sparkSession
    _drain(pair_stream(events, None), folder, "pairs")
    samples = samples_of(spark.readStream.schema(PAIRED).parquet(f"{folder}/pairs"))
    _drain(observed_updates(samples), folder, "signatures", "update")
    return latest_updates(spark, f"{folder}/signatures", "symbol")


def observe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed signatures of the event table, read as a stream."""
    return observe(trace_stream(spark, sf_dir), scratch_dir(spark))


def coalesced_stream(changes: DataFrame, gap: str, late: str) -> DataFrame:
    """Bursts of changes (uri, ts, version), each emitted once it can no longer
    grow: uri, first_ts, n, version."""
    bursts = changes.withWatermark("ts", late).groupBy("uri", F.session_window("ts", gap).alias("w"))
    return bursts.agg(F.count(F.lit(1)).alias("n"), F.max("version").alias("version")).select(
        "uri", F.col("w.start").alias("first_ts"), "n", "version"
    )


SHOWN = "uri string, seq bigint, buffer_id bigint, version bigint, generation bigint"


class Publisher(StatefulProcessor):
    """What may be shown of one file, as buffers open, change and close: the open
    buffer with its version, and the buffer, version and generation shown last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState(
            "file", "open_buffer bigint, open_version bigint, buffer_id bigint, version bigint, generation bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        open_buffer, open_version, buffer_id, version, generation = self._state.get() if self._state.exists() else (None,) * 5
        shown = []
        batch = pd.concat(list(rows)).sort_values(["seq", "side"], kind="stable")
        columns = ("seq", "kind", "buffer_id", "version", "generation")
        for at, kind, *given in zip(*[batch[c].tolist() for c in columns], strict=True):
            b, v, g = (None if pd.isna(x) else int(x) for x in given)
            if kind == "open":
                open_buffer, open_version = b, v
            elif kind == "edit":
                open_version = v
            elif kind == "close":
                open_buffer = buffer_id = version = generation = None
            elif v is None:
                if open_buffer is None:
                    shown.append((key[0], at, b, v, g))
            elif open_buffer is not None and b == open_buffer and v <= open_version:
                same = b == buffer_id
                older = same and v < version
                dated = same and v == version and None not in (g, generation) and g < generation
                if not older and not dated:
                    buffer_id, version, generation = b, v, generation if g is None else g
                    shown.append((key[0], at, b, v, g))
        self._state.update((open_buffer, open_version, buffer_id, version, generation))
        out = pd.DataFrame(shown, columns=[c.split()[0] for c in SHOWN.split(", ")])
        yield out.astype({c: "Int64" for c in ("buffer_id", "version", "generation")})

    def close(self) -> None:
        pass


def publish_stream(line: DataFrame) -> DataFrame:
    """Streaming form of ``publish_open``: (uri, seq, kind, buffer_id, version, generation)
    in order of time, where ``kind`` is open, edit, close or result."""
    sided = line.withColumn("side", (F.col("kind") == "result").cast("int"))
    return sided.groupBy("uri").transformWithStateInPandas(Publisher(), SHOWN, "Append", "None")


def publish_table(line: DataFrame) -> DataFrame:
    """All that a stream of buffers and results may show now."""
    spark = line.sparkSession
    folder = scratch_dir(spark)
    _drain(publish_stream(line), folder, "shown")
    return spark.read.schema(SHOWN).parquet(f"{folder}/shown")
