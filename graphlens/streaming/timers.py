"""Stateful streams with timers and expiry, and batch twins that give the same rows.

Each operator is one fold over a key's rows in order of time. Its state is small and bounded: a set of changed paths up to a
limit, the ids of a time to live, two queues of fixed length. The streams keep it in the state store (RocksDB, as ``transformWithState``
asks for) and close what is due by timers; the twins run the same fold over a finished table. On the machine's time a query goes on
for ever (timers and expiry want batches without input), so it takes a trigger by interval, not ``availableNow``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> None:
    """State stores that the streams of this module need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _millis(column: pd.Series) -> list[int]:
    return (column.astype("datetime64[us]").astype("int64") // 1000).tolist()


# --- change batches ---

BATCH = "repo string, opened timestamp_ntz, closed timestamp_ntz, paths array<string>, full boolean"


def _batch(repo: str, opened: int, closed: int, paths: Iterable[str], full: bool) -> pd.DataFrame:
    return pd.DataFrame({"repo": [repo], "opened": [pd.Timestamp(opened, unit="ms")], "closed": [pd.Timestamp(closed, unit="ms")], "paths": [sorted(paths)], "full": [full]})


class Debounce(StatefulProcessor):
    """A batch of changed paths closes ``quiet`` milliseconds after its last change, and ``ceiling`` after its first one at
    the latest, under constant change too. Beyond ``most`` distinct paths none is added, and ``full`` asks for a whole
    listing. State of a repository: its open paths, when the batch opened and changed last, the one timer that closes it.

    Time is that of the changes where the stream runs on event time (a timer fires when the watermark passes it), else that of
    the machine.
    """

    def __init__(self, quiet: int = 50, ceiling: int = 2_000, most: int = 4_096, event_time: bool = False) -> None:
        self.quiet, self.ceiling, self.most, self.event_time = quiet, ceiling, most, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "path string", "at long")
        self.span = handle.getValueState("span", "opened long, changed long, held long, full boolean")

    def due(self, opened: int, changed: int) -> int:
        return min(changed + self.quiet, opened + self.ceiling)

    def _flush(self, repo: str) -> pd.DataFrame:
        opened, changed, _, full = self.span.get()
        out = _batch(repo, opened, self.due(opened, changed), [k[0] for k in self.paths.keys()], full)
        self.paths.clear()
        self.span.clear()
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        now = timerValues.getCurrentProcessingTimeInMs()
        times = _millis(frame["ts"]) if self.event_time else [now] * len(frame)
        for at, path in sorted(zip(times, frame["path"].tolist(), strict=True)):
            opened = changed = None
            held, full = 0, False
            if self.span.exists():
                opened, changed, held, full = self.span.get()
                if at >= self.due(opened, changed):
                    self.handle.deleteTimer(self.due(opened, changed))
                    yield self._flush(key[0])
                    opened, held, full = None, 0, False
            before = None if opened is None else self.due(opened, changed)
            opened, changed = (at, at) if opened is None else (opened, max(at, changed))
            if not self.paths.containsKey((path,)):
                if held < self.most:
                    self.paths.updateValue((path,), (at,))
                    held += 1
                else:
                    full = True
            self.span.update((opened, changed, held, full))
            if before != self.due(opened, changed):
                if before is not None:
                    self.handle.deleteTimer(before)
                self.handle.registerTimer(self.due(opened, changed))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.span.exists():
            opened, changed, *_ = self.span.get()
            if self.due(opened, changed) <= expiredTimerInfo.getExpiryTimeInMs():
                yield self._flush(key[0])

    def close(self) -> None:
        pass


def change_batches_stream(changes: DataFrame, quiet: int = 50, ceiling: int = 2_000, most: int = 4_096, event_time: bool = False) -> DataFrame:
    """Batches of a stream of changes (repo, path, ts); on event time the stream must have a watermark on ``ts``."""
    with_rocksdb(changes.sparkSession)
    mode = "eventTime" if event_time else "processingTime"
    narrow = changes.select("repo", "path", "ts")
    return narrow.groupBy("repo").transformWithStateInPandas(Debounce(quiet, ceiling, most, event_time), BATCH, "append", mode)


def change_batches(changes: DataFrame, quiet: int = 50, ceiling: int = 2_000, most: int = 4_096) -> DataFrame:
    """The batches of a finished table of changes (repo, path, ts).

    A pause of ``quiet`` always ends a batch, so a window over the changes' times finds the islands between pauses, and only
    within one island are batches cut one after the other, each from the first change at or after the last one's ceiling.
    What is folded are an island's distinct milliseconds, not its paths. Rows without a repository, path or time are no changes.
    """
    known = changes.select("repo", "path", F.unix_millis(F.col("ts").cast("timestamp")).alias("at")).na.drop()
    moments = known.select("repo", "at").distinct()
    w = Window.partitionBy("repo").orderBy("at")
    moments = moments.withColumn("_new", F.coalesce((F.col("at") - F.lag("at").over(w) >= quiet).cast("int"), F.lit(1)))
    islands = moments.withColumn("_island", F.sum("_new").over(w)).groupBy("repo", "_island").agg(F.array_sort(F.collect_list("at")).alias("_at"))

    def cut(starts, at):
        return F.when(F.size(starts) == 0, F.array(at)).when(at >= F.element_at(starts, -1) + ceiling, F.concat(starts, F.array(at))).otherwise(starts)

    starts = islands.select("repo", F.explode(F.aggregate("_at", F.array().cast("array<bigint>"), cut)).alias("opened"))
    # the last start at or before each change: starts and changes in one order of time
    both = known.withColumn("opened", F.lit(None).cast("long")).unionByName(starts.select("repo", F.lit(None).cast("string").alias("path"), F.col("opened").alias("at"), "opened"))
    order = Window.partitionBy("repo").orderBy("at", F.col("path").isNotNull())
    placed = both.withColumn("opened", F.last("opened", ignorenulls=True).over(order)).where("path is not null")
    firsts = placed.groupBy("repo", "opened", "path").agg(F.min("at").alias("_first"), F.max("at").alias("_last"))
    # beyond the limit, the paths that came last are left out
    nth = F.row_number().over(Window.partitionBy("repo", "opened").orderBy("_first", "path"))
    closing = F.least(F.max("_last") + quiet, F.col("opened") + ceiling)
    time = lambda c: F.timestamp_millis(c).cast("timestamp_ntz")
    return firsts.withColumn("_n", nth).groupBy("repo", "opened").agg(closing.alias("closed"), F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.col("path")))).alias("paths"), (F.max("_n") > most).alias("full")).select("repo", time(F.col("opened")).alias("opened"), time(F.col("closed")).alias("closed"), "paths", "full")


# --- order of events ---

VIOLATION = "task_id string, sequence long, problem string"


class Sequences(StatefulProcessor):
    """Repeated ids, and sequences that do not rise, within a task. An id is held for ``ttl`` milliseconds after it came and
    the last sequence for as long after it rose, so a task that has ended leaves nothing behind."""

    def __init__(self, ttl: int | None) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getMapState("ids", "event_id string", "sequence long", self.ttl)
        self.last = handle.getValueState("last", "sequence long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = []
        for frame in rows:
            for sequence, event_id in zip(frame["sequence"].tolist(), frame["event_id"].tolist(), strict=True):
                if self.ids.containsKey((event_id,)):
                    found.append((key[0], sequence, "duplicate"))
                elif self.last.exists() and sequence <= self.last.get()[0]:
                    found.append((key[0], sequence, "order"))
                else:
                    self.last.update((sequence,))
                    self.ids.updateValue((event_id,), (sequence,))
        if found:
            yield pd.DataFrame(found, columns=["task_id", "sequence", "problem"])

    def close(self) -> None:
        pass


def sequence_violations(events: DataFrame, ttl_millis: int | None = 3_600_000) -> DataFrame:
    """(task_id, sequence, problem) of a stream of events (task_id, sequence, event_id): an id seen before, or a sequence that
    does not follow the last accepted one. Both are errors, not late data; nothing is put in order for them."""
    with_rocksdb(events.sparkSession)
    return events.select("task_id", "sequence", "event_id").groupBy("task_id").transformWithStateInPandas(Sequences(ttl_millis), VIOLATION, "append", "processingTime")


# --- the call recorder ---

RECORDED = "session string, call_id string, status string, started timestamp_ntz, ended timestamp_ntz"


@dataclass
class Recorder:
    """Calls that have begun and calls that have ended, two queues of fixed length. A call enters the first with its first
    event, whichever that is, and moves to the second with its end. What falls out of the first is ``evicted`` (an end that
    comes later begins it anew), what falls out of the second is ``forgotten`` (later events of it are no repeats)."""

    pending_limit: int = 1_024
    completed_limit: int = 1_024
    pending: dict[str, int] = field(default_factory=dict)
    completed: dict[str, int] = field(default_factory=dict)

    def feed(self, call_id: str, phase: str, at: int) -> Iterator[tuple[str, str, int, int | None]]:
        """(call, status, started, ended) of what an event changes."""
        if call_id in self.completed:
            yield call_id, "duplicate", self.completed[call_id], at
            return
        if call_id not in self.pending:
            self.pending[call_id] = at
            while len(self.pending) > self.pending_limit:
                oldest = next(iter(self.pending))
                yield oldest, "evicted", self.pending.pop(oldest), None
        elif phase == "before":
            yield call_id, "duplicate", self.pending[call_id], at
        if phase == "before" or call_id not in self.pending:
            return
        self.completed[call_id] = started = self.pending.pop(call_id)
        yield call_id, "completed", started, at
        while len(self.completed) > self.completed_limit:
            oldest = next(iter(self.completed))
            yield oldest, "forgotten", self.completed.pop(oldest), None


def _recorded(session: str, rows: list[tuple]) -> pd.DataFrame:
    stamp = lambda v: pd.NaT if v is None else pd.Timestamp(v, unit="ms")
    return pd.DataFrame([(session, c, s, stamp(a), stamp(b)) for c, s, a, b in rows], columns=["session", "call_id", "status", "started", "ended"])


def _fed(recorder: Recorder, frame: pd.DataFrame) -> list[tuple]:
    ordered = sorted(zip(_millis(frame["ts"]), frame["seq"].tolist(), frame["call_id"].tolist(), frame["phase"].tolist(), strict=True))
    return [row for at, _, call_id, phase in ordered for row in recorder.feed(call_id, phase, at)]


class Calls(StatefulProcessor):
    """The recorder of each session, its two queues as one value; a session that is silent for ``ttl`` milliseconds goes."""

    def __init__(self, pending_limit: int, completed_limit: int, ttl: int | None) -> None:
        self.limits, self.ttl = (pending_limit, completed_limit), ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        queue = "array<struct<call_id: string, started: bigint>>"
        self.state = handle.getValueState("queues", f"pending {queue}, completed {queue}", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        recorder = Recorder(*self.limits)
        if self.state.exists():
            for held, queue in zip((recorder.pending, recorder.completed), self.state.get(), strict=True):
                held.update({call[0]: call[1] for call in queue or []})
        found = _fed(recorder, pd.concat(list(rows)))
        self.state.update((list(recorder.pending.items()), list(recorder.completed.items())))
        if found:
            yield _recorded(key[0], found)

    def close(self) -> None:
        pass


def recorded_calls_stream(events: DataFrame, pending_limit: int = 1_024, completed_limit: int = 1_024, ttl_millis: int | None = 3_600_000) -> DataFrame:
    """(session, call_id, status, started, ended) from a stream of events (session, call_id, phase, ts, seq), phase ``before`` or
    ``after``: calls that ended, and beside them, as counts of what was dropped, repeats and calls that fell out of a queue."""
    with_rocksdb(events.sparkSession)
    narrow = events.select("session", "call_id", "phase", "ts", "seq")
    return narrow.groupBy("session").transformWithStateInPandas(Calls(pending_limit, completed_limit, ttl_millis), RECORDED, "append", "processingTime")


def recorded_calls(events: DataFrame, pending_limit: int = 1_024, completed_limit: int = 1_024) -> DataFrame:
    """The same of a finished table, a session's events in order of (ts, seq), read from a sorted partition as they come."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, recorder = None, Recorder(pending_limit, completed_limit)
        for frame in batches:
            for name, part in frame.groupby("session", sort=False):
                if name != session:
                    session, recorder = name, Recorder(pending_limit, completed_limit)
                yield _recorded(name, _fed(recorder, part))

    narrow = events.select("session", "call_id", "phase", F.col("ts").cast("timestamp_ntz").alias("ts"), "seq").na.drop()
    return narrow.repartition("session").sortWithinPartitions("session", "ts", "seq").mapInPandas(run, RECORDED)


def recorder_stats(recorded: DataFrame) -> DataFrame:
    """Of each session, how many calls ended, repeated, and fell out of each queue."""
    count = lambda s: F.count_if(F.col("status") == s)
    return recorded.groupBy("session").agg(*[count(s).alias(s) for s in ("completed", "duplicate", "evicted", "forgotten")])
