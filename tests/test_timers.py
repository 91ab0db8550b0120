"""Streams with timers and expiry: against their batch twins on event time, and as they close and forget on the machine's."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from graphlens.streaming import timers

BASE = dt.datetime(2024, 1, 1)


def at(ms):
    return BASE + dt.timedelta(milliseconds=ms)


def written(spark, folder, parts, schema):
    """A stream that reads each part as a batch of its own, in order."""
    for part in parts:
        spark.createDataFrame(part, schema).repartition(1).write.mode("append").parquet(folder)
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drained(frame, name, spark, checkpoint):
    q = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in spark.table(name).collect()]


def polled(frame, name, spark, checkpoint, files, meanwhile=None):
    """Rows once ``files`` batches of input are read: on the machine's time, with timers, a query never says that it is done."""
    q = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime="200 milliseconds").start()
    until, read = time.time() + 60, set()
    try:
        while time.time() < until and (len(read) < files):
            time.sleep(0.2)
            read |= {p["batchId"] for p in q.recentProgress if p["numInputRows"]}
        if meanwhile:
            meanwhile(q)
    finally:
        q.stop()
    assert len(read) >= files
    return [tuple(r) for r in spark.table(name).collect()]


def plain_batches(rows, quiet, ceiling, most):
    found, state = [], {}
    for ms, repo, path in sorted((r[2], r[0], r[1]) for r in rows):
        held = state.get(repo)
        if held and ms >= min(held["last"] + quiet, held["opened"] + ceiling):
            found.append(state.pop(repo) | {"repo": repo})
            held = None
        held = held or state.setdefault(repo, {"opened": ms, "paths": [], "full": False})
        held["last"] = ms
        if path not in held["paths"]:
            held["paths" if len(held["paths"]) < most else "rest"] = [*held["paths"], path]
            held["full"] = held["full"] or "rest" in held
    found += [s | {"repo": r} for r, s in state.items()]
    return sorted((s["repo"], at(s["opened"]), at(min(s["last"] + quiet, s["opened"] + ceiling)), sorted(s["paths"]), s["full"]) for s in found)


CHANGES = "repo string, path string, ts timestamp"


def changes(seed):
    rng, rows, ms = random.Random(seed), [], 0
    for _ in range(160):
        ms += rng.choice([0, 5, 30, 49, 50, 51, 200])
        rows.append((rng.choice("ab"), f"p{rng.randrange(6)}", ms))
    return rows + [("c", "x", 10), ("c", "x", 10)] + [("d", "y", k * 40) for k in range(40)]


@pytest.mark.parametrize(("quiet", "ceiling", "most"), [(50, 300, 3), (50, 2000, 4096), (1, 1, 1)])
def test_change_batches(spark, quiet, ceiling, most):
    rows = changes(1)
    frame = spark.createDataFrame([(r, p, at(ms)) for r, p, ms in rows] + [(None, "x", at(1)), ("e", None, at(1)), ("e", "x", None)], CHANGES)
    got = timers.change_batches(frame.repartition(3), quiet, ceiling, most)
    assert sorted(map(tuple, got.collect())) == plain_batches(rows, quiet, ceiling, most)
    assert timers.change_batches(frame.limit(0)).count() == 0


def test_change_batches_on_event_time(spark, tmp_path):
    """Micro-batches cut the changes anywhere; the batches are those of the finished table."""
    rows = sorted(changes(2), key=lambda r: r[2])
    parts = [rows[k : k + 45] for k in range(0, len(rows), 45)] + [[("z", "end", 10_000_000)], [("z", "end", 10_000_001)]]
    stream = written(spark, f"{tmp_path}/in", [[(r, p, at(ms)) for r, p, ms in part] for part in parts], CHANGES)
    got = drained(timers.change_batches_stream(stream.withWatermark("ts", "0 seconds"), 50, 300, 3, event_time=True), "event_batches", spark, f"{tmp_path}/c")
    assert sorted(r for r in got if r[0] != "z") == plain_batches(rows, 50, 300, 3)


def test_a_batch_closes_under_constant_change(spark, tmp_path):
    """On the machine's time, with a change in every trigger, the ceiling closes the batch; then silence closes the last one."""
    stream = spark.readStream.format("rate").option("rowsPerSecond", 20).load().select(F.lit("r").alias("repo"), F.concat(F.lit("p"), (F.col("value") % 5).cast("string")).alias("path"), F.col("timestamp").alias("ts"))
    found = timers.change_batches_stream(stream, quiet=60_000, ceiling=2_000)
    q = found.writeStream.format("memory").queryName("constant").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="300 milliseconds").start()
    until = time.time() + 60
    while time.time() < until and spark.table("constant").count() < 2:
        time.sleep(0.3)
    q.stop()
    rows = spark.table("constant").collect()
    assert len(rows) >= 2 and all((r["closed"] - r["opened"]).total_seconds() == 2 and not r["full"] and set(r["paths"]) <= {f"p{k}" for k in range(5)} for r in rows)
    assert all(a["closed"] <= b["opened"] for a, b in zip(sorted(rows, key=lambda r: r["opened"]), sorted(rows, key=lambda r: r["opened"])[1:], strict=False))


EVENTS = "task_id string, sequence long, event_id string"


def test_sequences_and_their_expiry(spark, tmp_path):
    parts = [[("t", 1, "a"), ("t", 2, "b"), ("u", 5, "a"), ("t", 2, "c")], [("t", 3, "b"), ("t", 4, "d"), ("u", 4, "z"), ("t", 3, "e")]]
    got = polled(timers.sequence_violations(written(spark, f"{tmp_path}/e", parts, EVENTS)), "kept_ids", spark, f"{tmp_path}/c", 2)
    assert sorted(got) == [("t", 2, "order"), ("t", 3, "duplicate"), ("t", 3, "order"), ("u", 4, "order")]
    # with a short time to live, what was seen is forgotten, and the state shrinks
    folder, held = f"{tmp_path}/short", []
    source = written(spark, folder, [[("t", k, f"i{k}") for k in range(50)]], EVENTS)

    def later(q):
        held.append(max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]))
        time.sleep(2)
        written(spark, folder, [[("t", 0, "i0")]], EVENTS)
        until = time.time() + 30
        while time.time() < until and sum(p["numInputRows"] > 0 for p in q.recentProgress) < 2:
            time.sleep(0.2)
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])

    assert polled(timers.sequence_violations(source, 1_000), "short_ids", spark, f"{tmp_path}/s", 1, later) == []
    assert held[0] >= 50 and held[1] < held[0]


def plain_calls(events, pending_limit, completed_limit):
    out, state = [], {}
    for session, _, _, call, phase, ms in sorted((s, ms, seq, c, p, ms) for s, c, p, ms, seq in events):
        pending, done = state.setdefault(session, ([], []))
        told = [x for x in done if x[0] == call]
        if told:
            out.append((session, call, "duplicate", at(told[0][1]), at(ms)))
            continue
        mine = [x for x in pending if x[0] == call]
        if not mine:
            pending.append((call, ms))
            if len(pending) > pending_limit:
                c, started = pending.pop(0)
                out.append((session, c, "evicted", at(started), None))
        elif phase == "before":
            out.append((session, call, "duplicate", at(mine[0][1]), at(ms)))
        if phase == "after":
            mine = [x for x in pending if x[0] == call]
            pending.remove(mine[0])
            done.append(mine[0])
            out.append((session, call, "completed", at(mine[0][1]), at(ms)))
            if len(done) > completed_limit:
                c, started = done.pop(0)
                out.append((session, c, "forgotten", at(started), None))
    return sorted(out, key=str)


CALLS = "session string, call_id string, phase string, ts timestamp, seq long"


@pytest.mark.parametrize("limits", [(3, 2), (1, 1), (1024, 1024)])
def test_recorded_calls(spark, limits):
    rng = random.Random(4)
    events = [(rng.choice("xyz"), f"c{rng.randrange(9)}", rng.choice(["before", "after"]), 10 * rng.randrange(400), k) for k in range(500)]
    frame = spark.createDataFrame([(s, c, p, at(ms), k) for s, c, p, ms, k in events], CALLS)
    got = timers.recorded_calls(frame.repartition(3), *limits)
    assert sorted(map(tuple, got.collect()), key=str) == plain_calls(events, *limits)
    stats = {r["session"]: r for r in timers.recorder_stats(got).collect()}
    want = plain_calls(events, *limits)
    assert all(stats[s][k] == sum(r[0] == s and r[2] == k for r in want) for s in "xyz" for k in ("completed", "duplicate", "evicted", "forgotten"))
    assert timers.recorded_calls(frame.limit(0)).count() == 0


def test_recorded_calls_on_a_stream(spark, tmp_path):
    rng = random.Random(6)
    events = [(rng.choice("xy"), f"c{rng.randrange(7)}", rng.choice(["before", "after"]), 10 * k, k) for k in range(300)]
    parts = [[(s, c, p, at(ms), k) for s, c, p, ms, k in events[n : n + 100]] for n in range(0, 300, 100)]
    got = polled(timers.recorded_calls_stream(written(spark, f"{tmp_path}/r", parts, CALLS), 3, 2), "stream_calls", spark, f"{tmp_path}/c", 3)
    assert sorted(got, key=str) == plain_calls(events, 3, 2)
