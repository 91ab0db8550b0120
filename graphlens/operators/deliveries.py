"""Deliveries: replay of an event log into its state, and mutations guarded by a version and an idempotency key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Events that carry the next version; all others extend the log and change nothing.
VERSIONED = ("transitioned", "goal_revised", "requirement_updated", "decision_requested", "decision_resolved")


def replay(events: DataFrame, legal: DataFrame) -> DataFrame:
    """(delivery, state, version, events, broken_at, problem): each log read from its start to its end, or to the first event that cannot follow those
    before it: a ``sequence`` that isn't the next one, an ``admission`` that isn't the first or is missing there, a ``version`` that isn't one more, a
    ``transition`` from another state than the present one or that isn't legal. State and version are those before that event.

    ``events``: delivery, sequence (from 1), type, version, src, dst (of transitions, and the state of an admission in dst); ``legal``: src, dst. What stands before an event
    is the last state and version of the rows before it, which holds as long as those were right, so the first problem is found without a fold.
    """
    own = Window.partitionBy("delivery").orderBy("sequence", "type", "version")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    carried = events.withColumns({
        "_n": F.row_number().over(own),
        "_state": F.last(F.when(F.col("type").isin("admitted", "transitioned"), F.col("dst")), ignorenulls=True).over(before),
        "_version": F.last(F.when(F.col("type").isin("admitted", *VERSIONED), F.col("version")), ignorenulls=True).over(before),
    })
    allowed = carried.join(F.broadcast(legal.select("src", "dst", F.lit(True).alias("_legal")).distinct()), ["src", "dst"], "left")
    problem = (
        F.when(F.col("sequence") != F.col("_n"), "sequence")
        .when((F.col("type") == "admitted") != (F.col("_n") == 1), "admission")
        .when(F.col("type").isin(*VERSIONED) & ~F.coalesce(F.col("version") == F.col("_version") + 1, F.lit(False)), "version")
        .when((F.col("type") == "transitioned") & (F.col("_legal").isNull() | ~F.coalesce(F.col("src") == F.col("_state"), F.lit(False))), "transition")
    )
    judged = allowed.withColumn("_problem", problem)
    broken = judged.where("_problem is not null").groupBy("delivery").agg(F.min(F.struct("_n", "sequence", "_problem", "_state", "_version")).alias("_b"))
    last = judged.groupBy("delivery").agg(
        F.count("*").alias("events"),
        F.max_by("dst", F.when(F.col("type").isin("admitted", "transitioned"), F.col("_n"))).alias("state"),
        F.max_by("version", F.when(F.col("type").isin("admitted", *VERSIONED), F.col("_n"))).alias("version"),
    )
    joined = last.join(broken, "delivery", "left")
    ok = F.col("_b").isNull()
    return joined.select("delivery", F.when(ok, F.col("state")).otherwise(F.col("_b._state")).alias("state"), F.when(ok, F.col("version")).otherwise(F.col("_b._version")).alias("version"), F.when(ok, F.col("events")).otherwise(F.col("_b._n") - 1).cast("long").alias("events"), F.col("_b.sequence").alias("broken_at"), F.col("_b._problem").alias("problem"))


def mutations(requests: DataFrame, current: DataFrame) -> DataFrame:
    """(delivery, seq, outcome, version) of each request in order: ``applied`` if it expects the present version, which it raises by one, else ``stale``; a key that was
    applied before is ``replayed`` if the request is the same, a ``conflict`` if it isn't; ``missing`` without a delivery. ``version``: that after the request.

    ``requests``: delivery, seq, key, fingerprint, expected; ``current``: delivery, version. A delivery's requests are one short array, as each depends on the one before.
    """
    held = requests.join(current.select("delivery", F.col("version").cast("long").alias("_v")), "delivery", "left")
    rows = held.groupBy("delivery", "_v").agg(F.array_sort(F.collect_list(F.struct("seq", "key", "fingerprint", F.col("expected").cast("long").alias("expected")))).alias("_r"))
    seq = dict(requests.dtypes)["seq"]

    def step(state, r):
        said = F.element_at(state["keys"], r["key"])
        outcome = F.when(said.isNotNull(), F.when(said == r["fingerprint"], "replayed").otherwise("conflict")).when(r["expected"] == state["version"], "applied").otherwise("stale")
        applied = outcome == "applied"
        version = state["version"] + F.when(applied, 1).otherwise(0)
        keys = F.when(applied, F.map_concat(state["keys"], F.map_from_arrays(F.array(r["key"]), F.array(r["fingerprint"])))).otherwise(state["keys"])
        return F.struct(version.alias("version"), keys.alias("keys"), F.concat(state["out"], F.array(F.struct(r["seq"].alias("seq"), outcome.alias("outcome"), version.alias("version")))).alias("out"))

    start = F.struct(F.col("_v").alias("version"), F.create_map().cast("map<string,string>").alias("keys"), F.array().cast(f"array<struct<seq: {seq}, outcome: string, version: bigint>>").alias("out"))
    missing = F.transform("_r", lambda r: F.struct(r["seq"].alias("seq"), F.lit("missing").alias("outcome"), F.lit(None).cast("long").alias("version")))
    told = rows.select("delivery", F.explode(F.when(F.col("_v").isNull(), missing).otherwise(F.aggregate("_r", start, step, lambda s: s["out"]))).alias("o"))
    return told.select("delivery", "o.*")
