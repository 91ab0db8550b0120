"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are put in a random, reproducible order. A document's virtual finish time is the number of its
source's words up to and with it, divided by the source's target. A source that is to give more than it has starts
again, up to three times. All copies are sorted by finish time, and the sorted stream is cut at the total budget.

Targets: sources in code-point order, null last, weigh 5, 2, 1, repeating, and share the budget (all words). A target
stops at three times its source's size; the excess is shared again by weight. Sources are few against documents, but
their number isn't bounded, so targets come from window functions over one row per source, not from the driver.

Running sums are salted (``common.with_rank``): a source with a third of all rows is dealt over many tasks. The stream is
a table of copies without their texts, dealt by ranges of finish time and sorted within them; a sum for each range finds
the one in which the budget runs out, and a running sum over that range alone finds the copy that would pass it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.llm import common

WEIGHTS, EPOCHS, RANGE_ROWS = (5, 2, 1), 3, 500_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = EPOCHS) -> DataFrame:
    """From (source, source_size): the same with ``target``, filled like communicating vessels.

    Source i is full if, with all sources of a smaller size-to-weight ratio full, its share would reach its limit.
    """
    big = "decimal(38,0)"
    every = Window.partitionBy()
    ratio_order = Window.orderBy("_ratio", "_n").rowsBetween(Window.unboundedPreceding, -1)
    weighed = sizes.withColumn("_n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = weighed.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), F.col("_n") % len(weights) + 1).cast(big)).withColumn("_limit", (F.col("source_size") * most).cast(big))
    weighed = weighed.withColumn("_ratio", F.col("_limit").cast("double") / F.col("_w").cast("double"))
    weighed = weighed.withColumns({"_all": F.sum("source_size").over(every).cast(big), "_weights": F.sum("_w").over(every).cast(big), "_p": F.coalesce(F.sum("_limit").over(ratio_order), F.lit(0)).cast(big), "_pw": F.coalesce(F.sum("_w").over(ratio_order), F.lit(0)).cast(big)})
    full = F.col("_limit").cast("double") * (F.col("_weights") - F.col("_pw")).cast("double") <= F.col("_w").cast("double") * (F.col("_all") - F.col("_p")).cast("double")
    weighed = weighed.withColumn("_full", full)
    weighed = weighed.withColumns({"_taken": F.coalesce(F.sum(F.when(F.col("_full"), F.col("_limit"))).over(every), F.lit(0)), "_gone": F.coalesce(F.sum(F.when(F.col("_full"), F.col("_w"))).over(every), F.lit(0))})
    share = F.col("_w").cast("double") * (F.col("_all") - F.col("_taken")).cast("double") / (F.col("_weights") - F.col("_gone")).cast("double")
    return weighed.select("source", "source_size", F.when(F.col("_full"), F.col("_limit").cast("double")).otherwise(share).alias("target"))


def _sized(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, source, ``_size``, ``_crc``, ``_key``; with ``whole`` the row itself as ``_row``, out of reach of these names."""
    text = F.col("text").cast("string")
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if whole else []
    return docs.select("doc_id", "source", common.n_words(text).alias("_size"), F.coalesce(F.crc32(text), F.lit(-1)).alias("_crc"), F.xxhash64(F.col("doc_id"), text, F.lit("mix")).alias("_key"), *row)


def _queued(sized: DataFrame, rows: int, goals: DataFrame) -> DataFrame:
    """With ``_before`` (words of the source that come earlier), ``_source_size`` and ``_target``."""
    ranked = common.with_rank(sized, ["source"], ["_key", "doc_id", "_size", "_crc"], common.buckets_for(rows), "_before", "_size")
    goals = goals.select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    return ranked.join(goals, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def finish_time(epoch: Column) -> Column:
    """Null where nothing is to be taken."""
    return F.when((F.col("_size") > 0) & (F.col("_target") > 0), (epoch * F.col("_source_size") + F.col("_before") + F.col("_size")).cast("double") / F.col("_target"))


def _cut(queued: DataFrame, rows: int, budget: int) -> float:
    """The finish time at which the sorted stream would pass the budget: copies before it are taken, whole."""
    times = F.transform(F.array(*map(F.lit, range(EPOCHS))), finish_time)
    copies = queued.select(F.explode(times).alias("t"), "_key", "doc_id", "_size").where("t is not null")
    order = ["t", "_key", "doc_id", "_size"]
    ranges = max(int(queued.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(EPOCHS * rows / RANGE_ROWS))
    stream = common.materialize(copies.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()))
    before = 0
    for r in stream.groupBy("_range").agg(F.sum("_size").alias("s")).orderBy("_range").collect():  # a row for each range
        if before + r["s"] > budget:
            w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
            first = stream.where(F.col("_range") == r["_range"]).withColumn("_sum", F.sum("_size").over(w)).where(F.col("_sum") > budget - before).agg(F.min("t")).first()[0]
            common.release(stream)
            return first
        before += r["s"]
    common.release(stream)
    return math.inf


def _planned(docs: DataFrame) -> tuple[DataFrame, DataFrame, int, float]:
    """One row per document without its text, the sources' targets, the number of rows and the cut."""
    narrow = common.materialize(_sized(docs))
    goals = common.materialize(targets(narrow.groupBy("source").agg(F.sum("_size").cast("long").alias("source_size"))))
    rows, budget = narrow.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    queued = common.materialize(_queued(narrow, rows, goals))
    common.release(narrow)
    return queued, goals, rows, _cut(queued, rows, budget)


def allot(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs`` (doc_id, text, source; other columns are ignored).

    A null text has size 0 and gives nothing; null sources are one source, the last. Repeated rows count each. Ties in
    a source's order are settled by doc_id, size and checksum; rows that agree in all are interchangeable. Copies of one
    finish time are taken together or not at all. An empty table gives no rows.
    """
    queued, _, _, cut = _planned(docs)
    taken = sum((F.coalesce((finish_time(F.lit(e)) < F.lit(cut)).cast("long"), F.lit(0)) for e in range(EPOCHS)), F.lit(0)) * F.col("_size")
    return queued.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken.cast("long").alias("taken"))


def mix(docs: DataFrame, finish: str | None = "finish_time") -> DataFrame:
    """The mixed corpus: the rows of ``docs`` as often as the mix takes them, sorted by finish time over all partitions.

    ``finish`` names a column for the finish time (None: none); where ``docs`` has a column of that name, the new one
    gets as many underscores at its end as make it unlike all others. All columns of ``docs`` stay as they are.
    """
    queued, goals, rows, cut = _planned(docs)
    common.release(queued)
    times = F.filter(F.transform(F.array(*map(F.lit, range(EPOCHS))), finish_time), lambda t: t < F.lit(cut))
    # a table, so that the files of the shuffles by source are gone before those of the sort are written
    mixed = common.materialize(_queued(_sized(docs, whole=True), rows, goals).select("_row", "doc_id", "_key", F.explode(times).alias("_t")))
    taken = mixed.sort("_t", "_key", "doc_id")
    if finish is None:
        return taken.select("_row.*")
    while finish.lower() in {c.lower() for c in docs.columns}:
        finish += "_"
    return taken.select("_row.*", F.col("_t").alias(finish))


def op3_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allot(common.table(spark, sf_dir, "documents"))
