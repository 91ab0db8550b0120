"""Versioned tables: latest rows, listing differences, compaction plans, retention, layering, writes as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list, deleted: Column | None = None) -> DataFrame:
    """The newest row of each key; keys whose newest row is a tombstone are gone.

    ``max_by`` on a struct aggregates before it shuffles: only one row of a key and task travels.
    """
    names = rows.columns
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("_r")).select("_r.*")
    return newest.where(~deleted) if deleted is not None else newest


def listing_diff(listed: DataFrame, live: DataFrame, key: str, state: list[str]) -> DataFrame:
    """(key, change): added, deleted, changed or same; one full outer join."""
    a, b = listed.select(key, F.struct(*state).alias("_a")), live.select(key, F.struct(*state).alias("_b"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "deleted").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def reuse_split(listed: DataFrame, known: DataFrame, key: str, stat: list[str], content: str) -> DataFrame:
    """(key, action): skip when the stat columns agree, reuse when only the content hash does, else extract."""
    old = known.select(key, *[F.col(c).alias(f"_{c}") for c in dict.fromkeys([*stat, content])])
    same = F.lit(True)
    for c in stat:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = listed.join(old.withColumn("_known", F.lit(True)), key, "left")
    return joined.select(key, F.when(F.col("_known").isNull(), "extract").when(same, "skip").when(F.col(content) == F.col(f"_{content}"), "reuse").otherwise("extract").alias("action"))


def compaction_due(overlays: Column, overlay_bytes: Column, base_bytes: Column) -> Column:
    """16 overlays, or 16 MiB of them, or four that make up more than a quarter of the base."""
    return (overlays >= 16) | (overlay_bytes >= 16 << 20) | ((overlays >= 4) & (overlay_bytes * 4 > base_bytes))


def retention(items: DataFrame, scope: str, key: str, updated: str, size: str, older_than=None, most: int | None = None, most_bytes: int | None = None) -> DataFrame:
    """Items that a policy removes: too old, beyond the newest ``most``, or oldest beyond ``most_bytes`` in a scope."""
    newest = Window.partitionBy(scope).orderBy(F.desc(updated), key)
    out = items.withColumns({"_n": F.row_number().over(newest), "_run": F.sum(size).over(newest.rowsBetween(Window.unboundedPreceding, 0))})
    gone = F.lit(False)
    if older_than is not None:
        gone = gone | (F.col(updated) < older_than)
    if most is not None:
        gone = gone | (F.col("_n") > most)
    if most_bytes is not None:
        gone = gone | (F.col("_run") > most_bytes)
    return out.where(gone).drop("_n", "_run")


def retention_batch(candidates: DataFrame, scope: str, key: str, updated: str, batch: int = 100) -> DataFrame:
    """The oldest ``batch`` of each scope."""
    return candidates.withColumn("_n", F.row_number().over(Window.partitionBy(scope).orderBy(updated, key))).where(F.col("_n") <= batch).drop("_n")


def layered(layers: DataFrame, key: list[str], rank: str) -> DataFrame:
    """Whole entries of the highest layer win."""
    return latest(layers, key, [rank])


def insert_new(rows: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """What an insert that ignores conflicts would add: new keys, one row each."""
    return rows.join(existing.select(*key), key, "left_anti").dropDuplicates(key)


def upsert(existing: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table after rows replace those of equal keys."""
    return latest(existing.withColumn("_v", F.lit(0)).unionByName(rows.withColumn("_v", F.lit(1))), key, ["_v"]).drop("_v")


def compare_and_set(current: DataFrame, changes: DataFrame, key: str, version: str, expected: str) -> DataFrame:
    """Changes with ``status``: applied (the first whose expected version is current), conflict, or missing."""
    joined = changes.join(current.select(key, version), key, "left").withColumn("_fits", F.col(version) == F.col(expected))
    first = F.row_number().over(Window.partitionBy(key, F.col("_fits")).orderBy("seq"))
    return joined.withColumn("status", F.when(F.col(version).isNull(), "missing").when(F.col("_fits") & (first == 1), "applied").otherwise("conflict")).drop("_fits")


def cascade(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Children whose parent stays."""
    return children.join(parents.select(key), key, "left_semi")


def covered(asked: DataFrame, seen: DataFrame, key: list[str], keep: int = 64) -> DataFrame:
    """``asked`` (key, start, end) with ``covered``: the newest ``keep`` delivered ranges of the key, merged where they
    touch, hold it whole."""
    recent = seen.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("seq")))).where(F.col("_k") <= keep)
    w = Window.partitionBy(*key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = recent.withColumn("_new", F.when(F.col("start") <= reach + 1, 0).otherwise(1)).withColumn("_i", F.sum("_new").over(w))
    merged = islands.groupBy(*key, "_i").agg(F.min("start").alias("_s"), F.max("end").alias("_e")).drop("_i")
    joined = asked.join(merged, key, "left").withColumn("_in", F.coalesce((F.col("_s") <= F.col("start")) & (F.col("_e") >= F.col("end")), F.lit(False)))
    return joined.groupBy(*asked.columns).agg(F.max("_in").alias("covered"))
