"""Streams against their batch twins."""

import datetime as dt

from graphlens.operators import telemetry
from graphlens.sources.generations import Store
from graphlens.streaming import streams


def stream(spark, df, folder):
    df.repartition(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drained(query_of, name, spark, checkpoint, mode="append"):
    q = query_of.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_correlation(spark, tmp_path):
    a = spark.createDataFrame([("x", at(0)), ("x", at(1)), ("y", at(5)), ("z", at(6))], "call_id string, ts timestamp")
    b = spark.createDataFrame([("x", at(3)), ("y", at(9)), ("w", at(9))], "call_id string, ts timestamp")
    got = drained(streams.correlate(stream(spark, a, f"{tmp_path}/a"), stream(spark, b, f"{tmp_path}/b")), "correlated", spark, f"{tmp_path}/c")
    assert sorted(map(tuple, got)) == sorted(map(tuple, telemetry.correlate(a, b, "call_id").collect()))


def test_rate_limit(spark, tmp_path):
    df = spark.createDataFrame([("a", at(s)) for s in (0, 1, 2, 9, 10, 11)] + [("b", at(5))], "client string, ts timestamp")
    batch = sorted(map(tuple, streams.rate_limited(df, 2, 10).collect()))
    assert [r[2] for r in batch] == [True, True, False, False, True, True, True]
    got = drained(streams.rate_limited_stream(stream(spark, df, f"{tmp_path}/r"), 2, 10), "limited", spark, f"{tmp_path}/c")
    assert sorted(map(tuple, got)) == batch


def test_batches_become_generations(spark, tmp_path):
    folder = f"{tmp_path}/s"
    for part in ([("a", 1, False), ("b", 2, False)], [("a", 3, False), ("b", None, True)]):
        source = stream(spark, spark.createDataFrame(part, "path string, hash int, deleted boolean"), folder)
    s = Store(spark, f"{tmp_path}/store", ["path"])
    streams.publish_batches(source, s, f"{tmp_path}/c").awaitTermination()
    assert [(r["path"], r["hash"]) for r in s.read().collect()] == [("a", 3)] and s.manifest()["generation"] >= 1
    before = s.manifest()["generation"]
    again = spark.createDataFrame([("c", 9, False)], "path string, hash int, deleted boolean")
    assert s.publish(again, batch=(f"{tmp_path}/c", 0)) == before and s.publish(again, batch=(f"{tmp_path}/c", 99)) == before + 1
