"""Connected components by alternating large-star and small-star rounds (Kiveris and others, 2014)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm import common


def _forest(edges: DataFrame) -> DataFrame:
    """The edges of each batch replaced by stars of the batch's own components: no more edges, mostly far fewer."""

    def run(batches):
        for batch in batches:
            ends = np.stack([np.asarray(batch.column(c), dtype=np.int64) for c in ("a", "b")])
            ids, flat = np.unique(ends, return_inverse=True)
            parent = np.arange(len(ids))
            # ids are sorted, so the smallest place is the smallest id
            a, b = flat.reshape(2, -1)
            while True:
                x, y = parent[a], parent[b]
                if (x == y).all():
                    break
                np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
                while (parent[parent] != parent).any():
                    parent = parent[parent]
            own = parent != np.arange(len(ids))
            yield [ids[own], ids[parent[own]]]

    return common.mapped(edges, run, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of all ids in ``edges`` (a long, b long, no nulls); the component is its smallest id.

    Each round groups neighbours with partial aggregation, so a hub is no hot task; rounds are written as tables. Loops
    and repeated edges do no harm; no edges give no rows.
    """
    mark = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    stars = common.materialize(_forest(edges.where("a <> b").select("a", "b")).distinct())
    before = stars.agg(*mark).first()
    while before[0]:
        both = stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # every edge now points down: small star
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b")))
        stars = common.materialize(small.distinct())
        after = stars.agg(*mark).first()
        if after == before:
            break
        before = after
    found = stars.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    return found.union(stars.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct().join(found.select("id"), "id", "left_anti"))
