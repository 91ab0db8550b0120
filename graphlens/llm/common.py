"""Helpers that the training-data operators share: tables, scratch space, words, scalable ranks and running sums."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed by the contracts: a word is a run of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark's own reader, so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``). Where it is unset, a local session gets a folder of
    its own, as in tests; on a cluster a machine's own folder would lose rows, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="graphlens-")
        spark.sparkContext.setCheckpointDir(named)
    return named


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Within this, the shuffle files of a query go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: it is computed once, its lineage is cut, and
    the loss of executors loses nothing. Its shuffle files go when the table is written."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    with shuffles_cleaned(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(conf).delete(path, True)


def unused(df: DataFrame):
    """A function from a short name to a column name that ``df`` does not have."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return lambda name: prefix + name


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case. On bytes, lower() and split() know ASCII only, as the contracts ask."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def unsigned_crc32(column: Column) -> Column:
    return F.crc32(column).cast("long")


def mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with a function from a record batch to a dict of columns (or None)."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in function(batches):
            if columns is not None:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t.type, from_pandas=False) for x, t in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def buckets_for(rows: int, per_bucket: int = 20_000, least: int = 16) -> int:
    """Number of hash buckets that keeps each at about ``per_bucket`` rows, whatever the size of the input."""
    return 1 << max(least.bit_length() - 1, int(np.ceil(np.log2(max(rows, 1) / per_bucket + 1))))


def with_rank(df: DataFrame, group: list[str], order: list[str], n_buckets: int, name: str = "rank", value: str | None = None) -> DataFrame:
    """Add a gapless 0-based rank of the rows of each group (or, with ``value``, the sum of ``value`` before the row).

    One window per group would put a hot group into one task. Here the first order column is a uniform hash; a
    bucket is a range of it, a window runs over (group, bucket), and the bucket's start is added from a table with one
    row per group and bucket. Rows that agree in all order columns are interchangeable.
    """
    low = F.lit(-(1 << 63)).cast("decimal(20,0)")
    width = (1 << 64) // n_buckets
    bucketed = df.withColumn("_b", F.least(F.floor((F.col(order[0]).cast("decimal(20,0)") - low) / F.lit(width).cast("decimal(20,0)")), F.lit(n_buckets - 1)).cast("int"))
    unit = F.col(value) if value else F.lit(1)
    sums = bucketed.groupBy(*group, "_b").agg(F.sum(unit).cast("long").alias("_n"))
    starts = sums.withColumn("_start", F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = Window.partitionBy(*group, "_b").orderBy(*order)
    before = F.coalesce(F.sum(value).over(local.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if value else F.row_number().over(local) - 1
    ranked = bucketed.withColumn("_local", before)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, "_b"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return ranked.alias("l").join(starts.alias("r"), cond).select("l.*", (F.col("_local") + F.col("_start")).cast("long").alias(name)).drop("_b", "_local", "_start")


def strings(array: pa.Array) -> pa.Array:
    """A string column of a batch as large_string, null as empty.

    A slice is copied first: casting one to large_string can leave its offsets pointing before its data.
    """
    import pyarrow.compute as pc

    if array.offset:
        array = array.take(pa.array(np.arange(len(array))))
    return pc.fill_null(array.cast(pa.large_string()), "")


def tokenize(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of whole texts: offsets by text, a code for each word, and the distinct words that the codes stand for.

    ``ascii_split_whitespace`` splits at the six characters that the contracts name; ``ascii_lower`` changes A-Z only.
    """
    import pyarrow.compute as pc

    texts = strings(texts)
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets = offsets - offsets[0]
    codes, distinct = np.asarray(flat.indices), flat.dictionary
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if empty >= 0:
        full = codes != empty
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        codes = codes[full]
    return offsets, codes, distinct


def hash64(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word, the same in every process."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, (x.encode("utf-8", "surrogatepass") for x in distinct.to_pylist())), dtype=np.uint64, count=len(distinct))


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Unused memory goes back to the system: a Python worker lives on after its task, beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each have about ``most_bytes`` at most (one text may have more)."""
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
            give_back()


def most_frequent(counted: DataFrame, most: int) -> DataFrame:
    """The rows of the largest ``count``, as many whole counts as ``most`` rows hold: a threshold, found from the counts
    of counts, so nothing is sorted and equal counts are treated alike."""
    held = counted.groupBy("count").agg(F.count("*").alias("n"))
    above = held.withColumn("_n", F.sum("n").over(Window.orderBy(F.desc("count"))))
    least = above.where(F.col("_n") <= most).agg(F.min("count")).first()[0]
    return counted.where(F.col("count") >= least) if least is not None else counted.limit(0)
