"""Exact top-k search by a three-phase uniform threshold, over vectors that are split by dimension.

A list is a block of dimensions: it knows every vector's partial score with a query, and the score is the sum over the
lists. Rows travel as blocks: a task packs its vectors into matrices of at most ``BLOCK`` rows, and a cell is a query
block against a row block within one list, joined by key and multiplied as a whole.

1. Every cell sends its best ``k`` partial scores of each query, and the least; of these, each list's best ``k`` are kept.
   They are scored exactly. The k-th best of these scores is safe: at least k vectors reach it.
2. The cut-off goes to the lists: above its least partial score, each list gets an equal share of what a vector needs to
   reach the safe score. A vector below its share in every list cannot reach it. Cells send all entries at or above.
   Vectors that every list sent have exact scores now, and the k-th best of these raises the safe score. With the shares
   as bounds for what wasn't sent, vectors that cannot reach it are dropped.
3. Those of the rest that some list did not send are scored exactly, and all are ranked.

The query set is stated by the caller and goes against all rows in blocks; nothing is broadcast. Each cell is bounded by
the block sizes; names of blocks are paired first, and their vectors join by block, so cells are spread over all tasks.
Matrix products are exact while scores are below 2^53; longer vectors than allow that raise an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.llm import common

LISTS, BLOCK, QUERY_BLOCK = 2, 4096, 512


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null where the vector is null or has null or non-finite components.
    What is beyond 2^62 becomes that: ``top_k`` refuses such vectors by name, where the cast alone would only overflow."""
    x = embedding.cast("array<double>")
    sound = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(x.isNotNull() & F.coalesce(sound, F.lit(False)), F.transform(x, lambda v: F.floor(F.least(F.greatest(v * scale, F.lit(-(2.0**62))), F.lit(2.0**62))).cast("long")))


def _blocks(vectors: DataFrame, block: int, lists: int, width: int) -> DataFrame:
    """(list, block, ids, keys, data) from (id, key, v): the vectors of a task in blocks, the dimensions of a list as a
    matrix. Shorter vectors are filled up with zeros."""
    edges = np.linspace(0, width, lists + 1).astype(int)

    def run(batches):
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                matrix = np.zeros((part.num_rows, width), np.float64)
                column = part.column("v")
                lengths = np.diff(np.asarray(column.offsets))
                flat = np.asarray(column.values.slice(column.offsets[0].as_py(), int(lengths.sum())), dtype=np.float64)
                matrix[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths] or [[]]).astype(int)] = flat
                ids, keys = (np.asarray(part.column(c), dtype="<i8").tobytes() for c in ("id", "key"))
                yield [list(range(lists)), [(task << 32) + number] * lists, [ids] * lists, [keys] * lists, [matrix[:, edges[j] : edges[j + 1]].astype("<f8").tobytes() for j in range(lists)]]
                number += 1

    return common.mapped(vectors, run, "list int, block long, ids binary, keys binary, data binary")


def _cells(queries: DataFrame, rows: DataFrame) -> DataFrame:
    q = queries.select("list", F.col("ids").alias("q_ids"), F.col("keys").alias("q_keys"), F.col("data").alias("q_data"), *[c for c in queries.columns if c == "cut"], F.col("block").alias("q_block"))
    # every query block meets every row block of its list, by name
    names = q.select("list", "q_block").join(rows.select("list", "block"), "list")
    cells = names.join(q, ["list", "q_block"]).join(rows.select("list", "block", "ids", "keys", "data"), ["list", "block"])
    return cells.repartition("list", "block", "q_block")


def _products(cell: dict):
    q_ids, ids = np.frombuffer(cell["q_ids"], "<i8"), np.frombuffer(cell["ids"], "<i8")
    left, right = np.frombuffer(cell["q_data"], "<f8").reshape(len(q_ids), -1), np.frombuffer(cell["data"], "<f8").reshape(len(ids), -1)
    scores = left @ right.T
    q_keys, keys = np.frombuffer(cell["q_keys"], "<i8"), np.frombuffer(cell["keys"], "<i8")
    return q_keys, keys, scores, q_ids[:, None] == ids[None, :]


def _first(cells: DataFrame, k: int) -> DataFrame:
    """Phase 1 of each cell: (list, query, row, part) of the best k, and with a null row the least part."""

    def run(batches):
        for batch in batches:
            for cell in batch.to_pylist():
                queries, rows, scores, own = _products(cell)
                least = scores.min(axis=1)
                scores[own] = -np.inf
                top = np.argsort(-scores, axis=1, kind="stable")[:, :k] if scores.shape[1] <= 4 * k else np.argpartition(-scores, k - 1, axis=1)[:, :k]
                best = np.take_along_axis(scores, top, axis=1)
                r, c = np.nonzero(np.isfinite(best))
                n = len(queries)
                yield [[cell["list"]] * (len(r) + n), np.concatenate([queries[r], queries]), [*rows[top[r, c]].tolist(), *[None] * n], np.concatenate([best[r, c], least]).astype(np.int64)]

    return common.mapped(cells, run, "list int, query long, row long, part long")


def _second(cells: DataFrame) -> DataFrame:
    """Phase 2 of each cell: all entries at or above the query's cut-off in the list."""

    def run(batches):
        for batch in batches:
            for cell in batch.to_pylist():
                queries, rows, scores, own = _products(cell)
                scores[own] = -np.inf
                cut = np.frombuffer(cell["cut"], "<f8")
                r, c = np.nonzero((scores >= cut[:, None]) & np.isfinite(scores))
                yield [np.full(len(r), cell["list"], np.int32), queries[r], rows[c], scores[r, c].astype(np.int64)]

    return common.mapped(cells, run, "list int, query long, row long, part long")


def _exact(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query, row, score) of (query, row) pairs, from whole vectors; the inner product counts missing components as 0."""
    product = F.aggregate(F.zip_with("qv", "v", lambda a, b: F.coalesce(a, F.lit(0)) * F.coalesce(b, F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)
    q = queries.select(F.col("key").alias("query"), F.col("v").alias("qv"))
    return pairs.join(vectors.select(F.col("key").alias("row"), "v"), "row").join(q, "query").select("query", "row", product.alias("score"))


def _kth(scored: DataFrame, k: int) -> DataFrame:
    """(query, safe): the k-th best score of each query that has so many."""
    ranked = scored.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"))))
    return ranked.where(F.col("_n") <= k).groupBy("query").agg(F.min("score").alias("safe"), F.count("*").alias("_n")).where(F.col("_n") == k).drop("_n")


def _numbered(vectors: DataFrame) -> DataFrame:
    """(id, v, key) as a table of its own, with a number for each row: rows of one id are told apart."""
    sound = vectors.where("id is not null and v is not null").select("id", "v")
    # |q . v| is at most |q| |v|, so below 2^53 if no vector is longer than its root
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    said = F.concat(F.lit("the vector of id "), F.col("id").cast("string"), F.lit(" is too long for exact scores: its squared length is 2^53 or more"))
    sound = sound.withColumn("v", F.when(length >= float(1 << 53), F.raise_error(said).cast("array<long>")).otherwise(F.col("v")))
    return common.materialize(common.materialize(sound).withColumn("key", F.monotonically_increasing_id()))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, lists: int = LISTS, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query, rank (from 1), id, score: the ``k`` best of the rows of other ids by inner product, ties to the smaller id.

    ``vectors``: id long, v array<long> (null vectors and null ids take no part). Rows of one id are candidates each, so
    an id can come up more than once; a query's rows of its own id are none of its candidates. Of several query rows of
    one id each has its own ranks. With fewer than ``k`` others, all are returned; an empty table gives no rows. Vectors
    of unlike length are compared as if filled up with zeros. A vector whose squared length is 2^53 or more raises an
    error that names its id.
    """
    sound = _numbered(vectors)
    width = sound.agg(F.max(F.size("v"))).first()[0] or 0
    lists = max(1, min(lists, width))
    queries = sound.where(is_query)
    rows = common.materialize(_blocks(sound, block, lists, width))
    asked = common.materialize(_blocks(queries, query_block, lists, width))

    sent = common.materialize(_first(_cells(asked, rows), k))
    least = sent.where("row is null").groupBy("list", "query").agg(F.min("part").alias("least"))
    local = sent.where("row is not null").withColumn("_n", F.row_number().over(Window.partitionBy("list", "query").orderBy(F.desc("part"), "row"))).where(F.col("_n") <= k)
    safe = _kth(_exact(local.select("query", "row").distinct(), queries, sound), k)
    lows = least.groupBy("query").agg(F.sum("least").alias("_low"))
    shares = least.join(lows, "query").join(safe, "query", "left").select("list", "query", "safe", (F.col("least") + F.floor((F.col("safe") - F.col("_low")) / lists)).alias("cut"))
    shares = common.materialize(shares)

    sent = _second(_cells(_with_cuts(asked, shares), rows))
    seen = sent.join(shares.select("list", "query", "cut"), ["list", "query"]).groupBy("query", "row").agg(F.sum("part").alias("score"), F.sum("cut").alias("_own"), F.count("*").alias("_lists"))
    seen = common.materialize(seen)
    full = F.col("_lists") == lists
    higher = _kth(seen.where(full).select("query", "score"), k).select("query", F.col("safe").alias("_higher"))
    cuts = shares.groupBy("query").agg(F.max("safe").alias("safe"), F.sum("cut").alias("_cuts")).join(higher, "query", "left").select("query", "_cuts", F.greatest("safe", "_higher").alias("safe"))
    # what a list did not send is below its cut; what all lists sent is known
    able = seen.join(cuts, "query").where(F.col("safe").isNull() | (F.col("score") + F.when(full, 0).otherwise(F.col("_cuts") - F.col("_own")) >= F.col("safe")))
    final = able.where(full).select("query", "row", "score").unionByName(_exact(able.where(~full).select("query", "row"), queries, sound))
    named = final.join(sound.select(F.col("key").alias("row"), "id"), "row")
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id", "row")))
    return ranked.where(F.col("rank") <= k).join(queries.select(F.col("key").alias("query"), F.col("id").alias("_id")), "query").select(F.col("_id").alias("query"), "rank", "id", "score")


def _with_cuts(asked: DataFrame, shares: DataFrame) -> DataFrame:
    """Query blocks with the cut-off of each of their queries; minus infinity where nothing is safe."""

    def places(batches):
        for batch in batches:
            for lst, block, keys in zip(batch.column("list").to_pylist(), batch.column("block").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                own = np.frombuffer(keys, "<i8")
                yield [np.full(len(own), lst, np.int32), np.full(len(own), block), own, np.arange(len(own), dtype=np.int32)]

    def packed(batches):
        for batch in batches:
            lists = [[x["c"] for x in own] for own in batch.column("cuts").to_pylist()]
            yield [batch.column("list"), batch.column("block"), [np.array([-np.inf if c is None else c for c in own], "<f8").tobytes() for own in lists]]

    at = common.mapped(asked.select("list", "block", "keys"), places, "list int, block long, query long, at int")
    grouped = at.join(shares, ["list", "query"], "left").groupBy("list", "block").agg(F.array_sort(F.collect_list(F.struct("at", F.col("cut").cast("double").alias("c")))).alias("cuts"))
    cuts = common.mapped(grouped, packed, "list int, block long, cut binary")
    return asked.join(cuts, ["list", "block"])


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding")).alias("v"))
    found = top_k(vectors, F.col("id") % 50 == 0)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
