"""Telemetry and delivery: sessions, tool sequences, patterns, costs, event logs, queues, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions import text as T


def segments(turns: DataFrame, session: str, order: list[str], role: str = "role") -> DataFrame:
    """Turns with ``segment`` (from 1): a new one at each user turn; turns before the first are dropped."""
    w = Window.partitionBy(session).orderBy(*order)
    return turns.withColumn("segment", F.sum(F.when(F.col(role) == "user", 1).otherwise(0)).over(w)).where("segment > 0")


def tool_bigrams(calls: DataFrame, session: str, order: list[str], name: str) -> DataFrame:
    """(bigram, n): ``A>B`` for calls that follow each other in a session."""
    before = F.lag(name).over(Window.partitionBy(session).orderBy(*order))
    return calls.withColumn("_p", before).where(F.col("_p").isNotNull()).groupBy(F.concat("_p", F.lit(">"), name).alias("bigram")).agg(F.count("*").alias("n"))


def top_counts(rows: DataFrame, column: str, k: int) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def patterns(observed: DataFrame, least: int = 3) -> DataFrame:
    """(repo, trigger_hash, successes, failures, tools, solution) of triggers that were seen ``least`` times or more and
    accepted in more than 70 %: the most frequent tool sequence (ties: the smallest), the latest solution (ties likewise).

    ``observed``: repo, trigger, outcome, ts, tools (text), solution; rows without an outcome are skipped.
    """
    rows = observed.where("outcome is not null").withColumn("_t", T.normalize_trigger(F.col("trigger"))).where("_t <> ''").withColumn("trigger_hash", F.sha2("_t", 256))
    good = F.col("outcome") == "accepted"
    groups = rows.groupBy("repo", "trigger_hash").agg(F.count_if(good).alias("successes"), F.count_if(~good).alias("failures"), F.max(F.when(good, F.col("ts"))).alias("_last"))
    groups = groups.where((F.col("successes") + F.col("failures") >= least) & (F.col("successes") * 100 > (F.col("successes") + F.col("failures")) * 70))
    key = ["repo", "trigger_hash"]
    counted = rows.where(good).groupBy(*key, "tools").agg(F.count("*").alias("_n"))
    mode = counted.groupBy(*key).agg(F.min(F.struct((-F.col("_n")).alias("a"), "tools")).alias("_m")).select(*key, "_m.tools")
    last = rows.where(good).join(groups.select(*key, "_last"), key).where(F.col("ts") == F.col("_last")).groupBy(*key).agg(F.min("solution").alias("solution"))
    return groups.drop("_last").join(mode, key).join(last, key)


def cost(input_: Column, output: Column, cache_read: Column, cache_write: Column, cache_write_1h: Column, rates: dict[str, Column]) -> Column:
    """Microdollars: tokens times rates per million, rounded once, half up. One-hour writes are part of all writes."""
    hour = F.least(F.greatest(cache_write_1h, F.lit(0)), cache_write)
    scaled = input_ * rates["input"] + output * rates["output"] + cache_read * rates["cache_read"] + (cache_write - hour) * rates["cache_write"] + hour * rates["cache_write_1h"]
    up = scaled.cast("long") + 500_000
    return ((up - F.pmod(up, F.lit(1_000_000))) / 1_000_000).cast("long")


def with_tier(calls: DataFrame, prices: DataFrame, prompt: str = "prompt_tokens") -> DataFrame:
    """Calls with the rates of the highest tier whose threshold the whole prompt exceeds; unpriced models stay, null."""
    tiers = prices.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("above", "input", "output"))).alias("_tiers"))
    joined = calls.join(tiers, "model", "left")
    fits = F.filter("_tiers", lambda t: (t["above"] < F.col(prompt)) | (t["above"] == 0))
    return joined.withColumn("rate", F.element_at(fits, -1)).drop("_tiers")


def budget_level(used: Column, limit: Column) -> Column:
    ratio = used / limit
    return F.when(limit <= 0, "normal").when(ratio >= 1, "stop").when(ratio >= 0.9, "warn").when(ratio >= 0.75, "aggressive").when(ratio >= 0.5, "increased").otherwise("normal")


def compression_threshold(base: Column, level: Column) -> Column:
    scaled = F.when(level == "normal", base).when(level == "increased", F.floor(base / 2)).when(level == "aggressive", F.floor(base / 4)).otherwise(F.floor(base / 8))
    return F.when(level == "normal", base).otherwise(F.greatest(scaled, F.lit(50)))


def distinct_calls(calls: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first delivery of each call."""
    names = calls.columns
    return calls.groupBy(*key).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_r")).select("_r.*")


def usage_by_status(calls: DataFrame, group: list[str]) -> DataFrame:
    """Cumulative usage: settled and reserved amounts, unknown costs, and whether all costs are known."""
    return calls.groupBy(*group).agg(
        F.count("*").alias("calls"),
        F.sum(F.when(F.col("status") == "completed", F.col("amount")).otherwise(0)).alias("spent"),
        F.sum(F.when(F.col("status") == "reserved", F.col("amount")).otherwise(0)).alias("outstanding"),
        F.count_if(F.col("status") == "unknown").alias("unknown_calls"),
        F.bool_and(F.col("status") != "unknown").alias("cost_known"),
    )


def replay_violations(events: DataFrame, key: str, seq: str, state: str, legal: DataFrame) -> DataFrame:
    """(key, seq, problem): gaps or repeats in the sequence, and transitions (src, dst) that are not legal."""
    w = Window.partitionBy(key).orderBy(seq, state)
    both = events.withColumns({"_s": F.lag(seq).over(w), "_p": F.lag(state).over(w)})
    ok = legal.select(F.col("src").alias("_p"), F.col("dst").alias(state), F.lit(True).alias("_ok"))
    joined = both.join(ok, ["_p", state], "left")
    problem = F.when(F.col("_s").isNotNull() & (F.col(seq) != F.col("_s") + 1), "sequence").when(F.col("_p").isNotNull() & F.col("_ok").isNull(), "transition")
    return joined.select(key, seq, problem.alias("problem")).where("problem is not null")


def queue_claim(queue: DataFrame, group: str, now) -> DataFrame:
    """The next due item of each queue: ready, retry or a lease that ran out; the claim raises its epoch."""
    due = (F.col("status").isin("ready", "retry") & (F.col("available_at") <= now)) | ((F.col("status") == "leased") & (F.col("lease_expires_at") < now))
    order = F.struct("available_at", "created_at", "id")
    first = queue.where(due).groupBy(group).agg(F.min_by(F.struct("id", "epoch"), order).alias("_r"))
    return first.select(group, "_r.id", (F.col("_r.epoch") + 1).alias("epoch"))


def fenced(changes: DataFrame, leases: DataFrame, now) -> DataFrame:
    """Changes whose lease is still theirs: same owner and epoch, not expired."""
    return changes.join(leases.where(F.col("lease_expires_at") > now).select("id", "owner", "epoch"), ["id", "owner", "epoch"], "left_semi")


def current_checks(checks: DataFrame, writes: DataFrame, task: str) -> DataFrame:
    """Checks with ``current``: passed, and no later write overlaps them.

    Scopes: (kind, path), kind workspace, directory or exact. A scope meets another if one holds the other; both sides
    explode their folders, so the overlap is an equi-join.
    """

    def ancestors(path: Column) -> Column:
        parts = F.split(path, "/")
        return F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))

    w = writes.select(task, F.col("seq").alias("_ws"), F.col("kind").alias("_wk"), F.col("path").alias("_wp"))
    wide = lambda k: F.when(k == "workspace", F.lit("."))
    c = checks.withColumn("_id", F.monotonically_increasing_id()) if "check_id" not in checks.columns else checks.withColumn("_id", F.col("check_id"))
    area = F.coalesce(wide(F.col("kind")), F.col("path"))
    warea = F.coalesce(wide(F.col("_wk")), F.col("_wp"))
    # a check that covers a folder (or all) meets writes below it, and a write to a folder meets checks below it
    down = c.where("kind <> 'exact'").select("_id", task, "seq", area.alias("_a")).join(w.select(task, "_ws", F.explode(ancestors(warea)).alias("_a")), [task, "_a"])
    up = c.select("_id", task, "seq", F.explode(ancestors(area)).alias("_a")).join(w.where("_wk <> 'exact'").select(task, "_ws", warea.alias("_a")), [task, "_a"])
    exact = c.select("_id", task, "seq", area.alias("_a")).join(w.select(task, "_ws", warea.alias("_a")), [task, "_a"])
    cols = ["_id", "seq", "_ws"]
    stale = down.select(*cols).union(up.select(*cols)).union(exact.select(*cols)).where(F.col("_ws") > F.col("seq")).select("_id").distinct().withColumn("_stale", F.lit(True))
    return c.join(stale, "_id", "left").withColumn("current", F.col("passed") & F.col("_stale").isNull()).drop("_id", "_stale")


def obligation_status(per_path: DataFrame, key: str) -> DataFrame:
    """The worst status of an obligation's paths: failed, cancelled, stale, pending, else satisfied."""
    order = F.when(F.col("status") == "failed", 0).when(F.col("status") == "cancelled", 1).when(F.col("status") == "stale", 2).when(F.col("status") == "pending", 3).otherwise(4)
    return per_path.groupBy(key).agg(F.element_at(F.array(*map(F.lit, ("failed", "cancelled", "stale", "pending", "satisfied"))), F.min(order) + 1).alias("status"))


def first_exhausted(events: DataFrame, key: str, order: list[str], limits: dict[str, int]) -> DataFrame:
    """(key, dimension, seq): where a task first exceeds one of its limits; the dimension named first wins a tie."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = events.withColumns({f"_{d}": F.sum(d).over(w) for d in limits})
    hit = F.lit(None).cast("string")
    for d, limit in reversed(limits.items()):
        hit = F.when(F.col(f"_{d}") > limit, d).otherwise(hit)
    return running.withColumn("dimension", hit).where("dimension is not null").groupBy(key).agg(F.min(F.struct(*order, "dimension")).alias("_m")).select(key, "_m.dimension", *[f"_m.{c}" for c in order])


def confidence(signals: DataFrame, key: str, base: float = 0.5) -> DataFrame:
    """Base plus .05 for accepted, less .10 for rejected or ignored, less .15 for reverted; between 0 and 1."""
    delta = F.when(F.col("kind") == "accepted", 5).when(F.col("kind") == "rejected", -10).when(F.col("kind") == "reverted", -15).otherwise(0)
    return signals.groupBy(key).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(base) + F.sum(delta) / 100)).alias("confidence"))


def repeated_calls(events: DataFrame, session: str, order: list[str], call: str, write: Column, threshold: int = 3) -> DataFrame:
    """(session, epoch, call, n) of calls made ``threshold`` times or more between two writes."""
    epoch = F.sum(F.when(write, 1).otherwise(0)).over(Window.partitionBy(session).orderBy(*order))
    return events.withColumn("epoch", epoch).where(~write).groupBy(session, "epoch", call).agg(F.count("*").alias("n")).where(F.col("n") >= threshold)


def failure_streaks(events: DataFrame, session: str, order: list[str], command: str, failed: Column, threshold: int = 3) -> DataFrame:
    """(session, command, streak): the longest run of consecutive failures of a command, if it reaches the threshold."""
    w = Window.partitionBy(session, command).orderBy(*order)
    island = F.row_number().over(w) - F.sum(F.when(failed, 1).otherwise(0)).over(w)
    runs = events.withColumn("_i", island).where(failed).groupBy(session, command, "_i").agg(F.count("*").alias("n"))
    return runs.groupBy(session, command).agg(F.max("n").alias("streak")).where(F.col("streak") >= threshold)


def futility_notices(events: DataFrame, calls: int = 3, checks: int = 2, failures: int = 3) -> DataFrame:
    """(session, round, seq, kind, what, n): what a session is told of its futile steps, each once for a state. A ``call`` is the third identical one since anything was
    written, a ``check`` the second one of a command with the same exit, a ``failure`` each failed check from the third in a row of its command
    on (whatever was written), once for its number. A round's writes come before its calls and checks.

    ``events``: session, round, seq (in order within and over rounds), kind (write, call, check), what (a call with its canonical arguments, a command), exit, passed.
    """
    first = F.row_number().over(Window.partitionBy("session", "round", "kind").orderBy("seq")) == 1
    epoch = F.sum(F.when((F.col("kind") == "write") & F.col("_first"), 1).otherwise(0)).over(Window.partitionBy("session").orderBy("round").rangeBetween(Window.unboundedPreceding, 0))
    every = events.withColumn("_first", first).withColumn("_epoch", epoch).where("kind <> 'write'")
    exit_ = F.when(F.col("kind") == "check", F.coalesce(F.col("exit").cast("string"), F.lit("?"))).otherwise("")
    same = F.row_number().over(Window.partitionBy("session", "_epoch", "kind", "what", exit_).orderBy("seq"))
    repeated = every.withColumn("n", same).where(F.col("n") == F.when(F.col("kind") == "call", calls).otherwise(checks)).select("session", "round", "seq", "kind", "what", "n")
    # a run of failures ends at a check that passes
    by_command = Window.partitionBy("session", "what").orderBy("seq")
    runs = every.where("kind = 'check'").withColumn("_run", F.sum(F.when(F.col("passed"), 1).otherwise(0)).over(by_command)).where("not passed")
    runs = runs.withColumn("n", F.row_number().over(Window.partitionBy("session", "what", "_run").orderBy("seq"))).where(F.col("n") >= failures)
    once = F.row_number().over(Window.partitionBy("session", "_epoch", "what", "n").orderBy("seq")) == 1
    failed = runs.withColumn("_once", once).where("_once").select("session", "round", "seq", F.lit("failure").alias("kind"), "what", "n")
    return repeated.unionByName(failed)


def kept_turns(turns: DataFrame, session: str, order: list[str], tokens: str, limit: int) -> DataFrame:
    """Whole user turns from the newest back while they fit; the latest is always kept."""
    seg = segments(turns, session, order)
    sums = seg.groupBy(session, "segment").agg(F.sum(tokens).alias("_t"))
    back = Window.partitionBy(session).orderBy(F.desc("segment"))
    kept = sums.withColumns({"_run": F.sum("_t").over(back), "_k": F.row_number().over(back)}).where((F.col("_run") <= limit) | (F.col("_k") == 1))
    return kept.select(session, "segment", F.col("_t").alias("tokens"))


def changed_blocks(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys whose value differs between two versions, or that only one has."""
    a, b = before.select(*key, F.col(value).alias("_a")), after.select(*key, F.col(value).alias("_b"))
    return a.join(b, key, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*key)


def correlate(starts: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """Calls with both ends: the first start and the first end of each id."""
    return distinct_calls(starts, [key], ["ts"]).alias("a").join(distinct_calls(ends, [key], ["ts"]).alias("b"), key).select(key, F.col("a.ts").alias("started"), F.col("b.ts").alias("ended"))


def calibrated_scale(rows: DataFrame, key: str, order: list[str], weight: float = 0.3, low: float = 1.0, high: float = 2.0, least: int = 4000) -> DataFrame:
    """Exponentially weighted ratio of actual to estimated tokens, each clamped, folded in order from one. Estimates under
    ``least`` and calls without an actual number teach nothing."""
    ratio = F.greatest(F.lit(low), F.least(F.lit(high), F.col("actual") / F.col("estimated")))
    every = rows.where((F.col("estimated") >= least) & (F.col("actual") > 0)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, ratio.alias("r")))).alias("_a"))
    return every.select(key, F.aggregate("_a", F.lit(1.0), lambda acc, x: acc * (1 - weight) + x["r"] * weight).alias("scale"))


def check_roots(changed: DataFrame, manifests: DataFrame) -> DataFrame:
    """(family, root, paths): changed paths grouped by the nearest folder above them with a manifest of the family."""
    parts = F.split("path", "/")
    folders = F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    up = changed.select("path", F.explode(folders).alias("root"))
    found = up.join(manifests.select("family", "root").distinct(), "root")
    deep = found.groupBy("path", "family").agg(F.max_by("root", F.length("root")).alias("root"))
    return deep.groupBy("family", "root").agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("paths"))


def prometheus(samples: DataFrame, metric: str, labels: list[str], value: str) -> DataFrame:
    """Sorted lines ``name{labels} value``."""
    escaped = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    text = F.concat_ws(",", *[F.concat(F.lit(f'{x}="'), escaped(F.coalesce(F.col(x).cast("string"), F.lit(""))), F.lit('"')) for x in labels])
    return samples.select(F.concat(F.lit(metric + "{"), text, F.lit("} "), F.col(value).cast("string")).alias("line")).orderBy("line")
