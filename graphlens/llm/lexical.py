"""Ranked lexical search: an inverted index as a DataFrame, and the documents of the highest integer scores for each item.

The index is a table of posting lists: a row holds a term's bucket (a hash), the term, and of some documents (those of
one slice of a task's input) how often the term occurs and how many terms the document has. Each task writes the lists of the documents that it
has read, sorted by bucket, so building it shuffles nothing, makes one file a task, and a reader leaves out the row groups of
buckets that no item asks for. One list more a slice, of a null term, holds every document's length; number and total length are sums over those.

Searching joins items' terms to posting lists on bucket and term, scores every match and sums by item and document. Where the
items' terms are few enough to be broadcast (their number is checked), the scored postings that any item asks for are dealt by
document first: a term that half of all documents hold is spread with them, every sum is local, and only the best ``k`` of
an item leave a task. Beyond that bound, postings and terms are shuffled by term and a salt of the document, as many
salts as the most frequent term needs, and the sums follow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.llm import common

BUCKETS, BROADCAST_ROWS, TASK_ROWS = 256, 200_000, 2_000_000
#: Fixed by the contract: a term's characters are 0-9, A-Z, a-z and all from U+0080; A-Z in lower case. Others become spaces.
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20
_FOLDED[ord("A") : ord("Z") + 1] += 32


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Terms of whole texts: offsets by text, a code for each term, and the distinct terms that the codes stand for."""
    texts = common.strings(texts)
    if texts.buffers()[2] is not None:
        folded = _FOLDED[np.frombuffer(texts.buffers()[2], np.uint8)]
        texts = pa.Array.from_buffers(pa.large_string(), len(texts), [None, texts.buffers()[1], pa.py_buffer(folded)], offset=texts.offset)
    return common.tokenize(texts, lower=False)


def _bucket(term: str | F.Column, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, term, and four arrays in step: ids, rows (a number of the row in ``docs``), tfs and lengths, of ``docs``
    (doc_id, text) by slices; for a null term, of all documents that have terms. Rows that repeat an id are documents each. A
    null text has no terms. Other columns are left out, whatever their names."""

    def run(batches):
        for batch in common.slices(batches, "text", 8 << 20):
            offsets, codes, distinct = terms(batch.column("text"))
            lengths = np.diff(offsets)
            n_docs = len(lengths)
            pairs, tfs = np.unique(codes.astype(np.int64) * n_docs + np.repeat(np.arange(n_docs), lengths), return_counts=True)
            code, doc = pairs // n_docs, pairs % n_docs
            full = np.flatnonzero(lengths)
            starts = np.concatenate([np.flatnonzero(np.diff(code, prepend=-1)), [len(code), len(code) + len(full)]])
            doc = np.concatenate([doc, full])
            term = pa.concat_arrays([distinct.take(pa.array(code[starts[:-2]])), pa.nulls(1, distinct.type)]).cast(pa.string())
            lists = (batch.column("doc_id").take(pa.array(doc)), batch.column("row").take(pa.array(doc)), np.concatenate([tfs, lengths[full]]), lengths[doc])
            yield [term, *(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, pa.int64())) for x in lists)]

    kept = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    found = common.mapped(kept, run, f"term string, ids array<{dict(docs.dtypes)['doc_id']}>, rows array<long>, tfs array<long>, lengths array<long>")
    return found.select(_bucket("term", buckets).alias("bucket"), "*").sortWithinPartitions("bucket")


class Index:
    """The postings as a table, with the number of documents that have terms and the number of all their terms."""

    def __init__(self, docs: DataFrame, buckets: int = BUCKETS) -> None:
        self.buckets = buckets
        self.table = common.materialize(postings(docs, buckets))
        lengths = self.table.where("term is null").select(F.explode("lengths").alias("n"))
        self.n_docs, self.n_terms = lengths.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    def asked(self, items: DataFrame) -> DataFrame:
        """bucket, term and item_id of each distinct term of each item; rows that share an item_id are one item."""

        def run(batches):
            for batch in common.slices(batches, "text"):
                offsets, codes, distinct = terms(batch.column("text"))
                at = pa.array(np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)))
                yield [batch.column("item_id").take(at), distinct.take(pa.array(codes)).cast(pa.string())]

        kept = items.select("item_id", F.col("text").cast("string").alias("text"))
        found = common.mapped(kept, run, f"item_id {dict(items.dtypes)['item_id']}, term string").distinct()
        return common.materialize(found.select(_bucket("term", self.buckets).alias("bucket"), "term", "item_id"))

    def search(self, items: DataFrame, k: int = 50, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
        """item_id, rank (from 1), doc_id and score of the ``k`` documents with the highest scores above 0 (all, if
        fewer) for each row of ``items`` (item_id, text), equal scores by doc_id, a null id last.

        Items without terms, without matches, an empty table of items and one of documents give no rows. Rows of
        documents that repeat an id are ranked each. Sums that pass 64 bits raise an error.
        """
        asked = self.asked(items)
        n_asked, n_terms = asked.agg(F.count("*"), F.count_distinct("term")).first()
        small = n_asked <= broadcast_rows
        wanted = asked.select("bucket", "term").distinct()
        wanted = F.broadcast(wanted) if small else wanted
        held = self.table.where("term is not null")
        if small and n_terms < self.buckets:
            held = held.where(F.col("bucket").isin([r[0] for r in asked.select("bucket").distinct().collect()]))
        counted = held.join(wanted, ["bucket", "term"], "left_semi").groupBy("bucket", "term").agg(F.sum(F.size("rows")).alias("df"))
        weight = F.floor(1000 * F.log((2.0 * F.lit(self.n_docs) + 2) / (2.0 * F.col("df") + 1))).cast("long")
        weighed = common.materialize(counted.withColumn("w", weight).where("w > 0").withColumn("t", F.monotonically_increasing_id()))
        items_of = common.materialize(asked.join(weighed, ["bucket", "term"]).select("t", "item_id", "df"))
        matches, most = items_of.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.max("df"), F.lit(0))).first()
        parts = max(int(matches // TASK_ROWS) + 1, int(self.table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        lists = held.join(F.broadcast(weighed) if small else weighed, ["bucket", "term"])
        entries = lists.select("t", "w", F.inline(F.arrays_zip("ids", "rows", "tfs", "lengths")))
        m = f"50 + (50 * lengths * {self.n_docs}L) div {max(self.n_terms, 1)}L"
        scored = entries.select("t", F.col("ids").alias("doc_id"), F.col("rows").alias("row"), F.expr(f"w * ((1000000000 * tfs) div (1000 * tfs + 20 * ({m})))").alias("v"))
        if small:
            matched = scored.repartition(parts, "row").join(F.broadcast(items_of.drop("df")), "t")
        else:
            salts = int(most // TASK_ROWS) + 1
            spread = items_of.drop("df").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            matched = scored.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")).join(spread, ["t", "salt"])
        summed = matched.groupBy("item_id", "doc_id", "row").agg(F.sum("v").alias("score")).where("score > 0")
        best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
        return summed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH doc_terms AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents),
postings AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY doc_id, term),
lengths AS (SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
weights AS (
    SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term, docs),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark),
scored AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * docs) // terms)))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), totals
    GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 50"""


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Index(common.table(spark, sf_dir, "documents")).search(common.table(spark, sf_dir, "benchmark"))
