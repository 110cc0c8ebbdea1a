"""Call pairing against a plain stack, whole and cut into slices."""

import random
import time

import pytest
from pyspark.sql import functions as F

from factloom.operators import traces as T
from factloom.streaming import jobs

EVENTS = "fiber long, seq long, event string, call_key string, call_payload string, return_payload string"


def generate(seed, n=200):
    rng = random.Random(seed)
    return [(seed, i, rng.choice(["call", "call", "return", "return", "raise"]), rng.choice("abc"), "Integer", None) for i in range(n)]


def model(events):
    stack, epoch, out = [], 0, []
    for fiber, seq, event, key, *_ in events:
        if event == "call":
            stack.append((key, seq, epoch))
        elif event == "raise":
            epoch += 1
        elif stack and stack[-1][0] == key:
            _, call_seq, at = stack.pop()
            out.append((fiber, call_seq, seq, epoch > at, "paired"))
        else:
            out.append((fiber, None, seq, None, "ignored"))
    return out + [(events[0][0], s, None, None, "open") for _, s, _ in stack]


def rows(df):
    return {(r.fiber, r.call_seq, r.return_seq, r.raised, r.status) for r in df.collect()}


@pytest.mark.parametrize("slices", [1, 7, 40])
def test_slices_do_not_change_the_answer(spark, slices):
    per_fiber = [generate(s) for s in range(20)] + [generate(99, 4000)]
    events = spark.createDataFrame([e for f in per_fiber for e in f], EVENTS)
    expected = {r for f in per_fiber for r in model(f)}
    assert rows(T.pair_calls(events, slices)) == expected


def test_nothing_returns_until_the_end(spark):
    calls = [(1, i, "call", f"k{i}", "A", None) for i in range(500)]
    returns = [(1, 500 + i, "return", f"k{499 - i}", None, "B") for i in range(500)]
    got = T.pair_calls(spark.createDataFrame(calls + returns, EVENTS), 9)
    assert got.filter("status = 'paired' AND return_seq - call_seq = 999 - 2 * call_seq").count() == 500


def test_one_deep_fiber_is_merged_in_a_tree(spark):
    n = 100_000
    calls = spark.range(n).selectExpr("7L AS fiber", "id AS seq", "'call' AS event", "concat('k', id % 97) AS call_key", "'A' AS call_payload", "CAST(NULL AS STRING) AS return_payload")
    back = spark.range(n).selectExpr("7L", f"{n} + id", "'return'", f"concat('k', ({n} - 1 - id) % 97)", "CAST(NULL AS STRING)", "'B'")
    got = T.pair_calls(calls.union(back), 64, fan_in=2)
    assert got.filter(f"status = 'paired' AND call_seq + return_seq = 2 * {n} - 1 AND NOT raised").count() == n
    assert got.count() == n


def test_raises_count_across_slices(spark):
    steps = [(1, 0, "call", "a", "A", None), *[(1, i, "call", "x", None, None) for i in range(1, 50)], (1, 50, "raise", None, None, None),
            *[(1, 50 + i, "return", "x", None, None) for i in range(1, 50)], (1, 100, "return", "a", None, "B"), (1, 101, "return", "a", None, None)]
    events = spark.createDataFrame([(f, *r[1:]) for f in (1, 2) for r in steps], EVENTS)
    got = T.pair_calls(events, 16, fan_in=2).filter("call_key = 'a'")
    assert rows(got) == {(f, *t) for f in (1, 2) for t in ((0, 100, True, "paired"), (None, 101, None, "ignored"))}


def stream_of(spark, folder, batches):
    """A stream that gives one batch per list of events."""
    folder.mkdir()
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(str(folder / f"batch{i:02}"))
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


@pytest.mark.parametrize("cuts", [1, 4])
def test_stream_agrees_with_the_table(spark, tmp_path, cuts):
    events = [e for s in range(5) for e in generate(s)]
    batches = [[e for e in events if e[1] * cuts // 200 == c] for c in range(cuts)]
    folder = str(tmp_path / "out")
    got = jobs.observe(stream_of(spark, tmp_path / "in", batches), folder)
    expected = {r for s in range(5) for r in model(generate(s)) if r[-1] != "open"}
    pairs = spark.read.schema(jobs.PAIRED).parquet(folder + "/pairs")
    assert rows(pairs) == expected
    want = T.observed_signatures(jobs.samples_of(T.pair_calls(spark.createDataFrame(events, EVENTS), 3)))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_a_stream_of_nothing_observes_nothing(spark, tmp_path):
    assert jobs.observe(stream_of(spark, tmp_path / "in", [[]]), str(tmp_path / "out")).count() == 0


def test_an_event_out_of_place_is_late(spark, tmp_path):
    first = [(1, 5, "call", "a", "A", None), (1, 9, "call", "b", "A", None)]
    second = [(1, 7, "return", "a", None, "B"), (1, 10, "return", "b", None, "B"), (1, 6, "call", "c", "A", None), (1, 11, "return", "a", None, "B")]
    jobs._drain(jobs.pair_stream(stream_of(spark, tmp_path / "in", [first, second]), None), str(tmp_path / "out"), "pairs")
    assert rows(spark.read.schema(jobs.PAIRED).parquet(str(tmp_path / "out" / "pairs"))) == {
        (1, None, 7, None, "late"), (1, 6, None, None, "late"), (1, 9, 10, False, "paired"), (1, 5, 11, False, "paired")}


def test_frames_of_a_silent_fiber_are_given_up(spark, tmp_path):
    stream = stream_of(spark, tmp_path / "in", [[(1, 1, "call", "a", "A", None), (1, 2, "call", "b", "A", None), (1, 3, "return", "b", None, None)]])
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    query = jobs.pair_stream(stream, 200).writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).start()
    found, waited = set(), 0
    while not any(r[-1] == "abandoned" for r in found) and waited < 60:
        time.sleep(1)
        waited += 1
        if (tmp_path / "out" / "_spark_metadata").exists():
            found = rows(spark.read.schema(jobs.PAIRED).parquet(out))
    query.stop()
    assert found == {(1, 2, 3, False, "paired"), (1, 1, None, None, "abandoned")}


def test_raise_hides_a_nil_return(spark):
    df = spark.createDataFrame([(None, False), (None, True), ("User", True)], "v string, r boolean")
    got = [r[0] for r in df.select(T.counted_return(F.col("v"), F.col("r"))).collect()]
    assert got == ["nil", None, "User"]


def test_requests_are_served_by_the_next_pass(spark):
    asked = spark.createDataFrame([("r", "2024-01-01 10:30:00"), ("r", "2024-01-01 11:00:00"), ("r", "2024-01-03 14:00:00")], "repo string, at string").withColumn("at", F.col("at").cast("timestamp"))
    passes = spark.createDataFrame([("r", f"2024-01-0{d}") for d in ("1 08:00:00", "1 11:15:00", "2 14:00:00", "3 14:00:00", "4 02:07:00")], "repo string, start string").withColumn("start", F.col("start").cast("timestamp"))
    assert sorted((str(r.start), r.n) for r in T.collapse_requests(asked, passes).collect()) == [("2024-01-01 11:15:00", 2), ("2024-01-04 02:07:00", 1)]


def test_result_without_generation_is_shown(spark):
    rows = [("u", 1, 1, 1, 4), ("u", 2, 1, 1, None), ("u", 3, 1, 1, 3), ("u", 4, 1, 1, 5), ("u", 5, 1, 0, None)]
    got = T.publish_latest(spark.createDataFrame(rows, "uri string, arrival long, buffer_id long, version long, generation long")).collect()
    assert sorted(r.arrival for r in got) == [1, 2, 4]


LINE = "uri string, seq long, kind string, buffer_id long, version long, generation long"


def test_what_is_shown_of_open_and_closed_buffers(spark):
    steps = [
        ("result", 1, None, 3), ("open", 7, 1, None), ("result", 7, 1, 5), ("result", None, None, 9), ("result", 7, 2, 6), ("edit", None, 2, None),
        ("result", 7, 2, None), ("result", 7, 2, 4), ("result", 7, 2, 5), ("result", 7, 1, 9), ("result", 6, 2, 9), ("close", None, None, None),
        ("result", 7, 2, 9), ("result", None, None, None), ("open", 8, 1, None), ("result", 8, 1, 1), ("open", 9, 1, None), ("result", 9, 1, None), ("result", 9, 1, 0)]
    rows = [(u, i, *s) for u in ("a", "b") for i, s in enumerate(steps)]
    line = spark.createDataFrame(rows, LINE)
    got = T.publish_open(line.filter("kind = 'result'"), line.filter("kind <> 'result'"), bucket=4)
    shown = [0, 2, 6, 8, 13, 15, 17]
    assert sorted((r.uri, r.seq) for r in got.collect()) == [(u, n) for u in ("a", "b") for n in shown]
