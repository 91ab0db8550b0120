"""The store's shards: what a compaction touches, splits and drops, what validation finds, and builds in two steps."""

import os

import pytest

from graphlens.sources.generations import Store

SCHEMA = "path string, n long, hash string, deleted boolean"


def frame(spark, rows):
    return spark.createDataFrame([(p, n, h, h is None) for p, n, h in rows], SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"), ["path", "n"], shard_rows=10)
    s.publish(frame(spark, [(f"d{k // 10}", k % 10, f"h{k}") for k in range(100)]).repartition(3), base=True)
    return s


def held(s, manifest=None):
    return {(r["path"], r["n"]): r["hash"] for r in s.read(manifest).collect()}


def stamps(s):
    return {e["path"]: os.stat(f"{s.root}/{e['path']}").st_mtime_ns for e in s.manifest()["shards"]}


def test_shards_are_bounded_and_in_order(store):
    shards = store.manifest()["shards"]
    assert sum(e["rows"] for e in shards) == 100 and all(0 < e["rows"] <= 10 for e in shards)
    assert all(a["hi"] < b["lo"] for a, b in zip(shards, shards[1:], strict=False))
    assert store.validate().count() == 0


def test_one_key_rewrites_one_shard(spark, store):
    before, files = held(store), stamps(store)
    store.publish(frame(spark, [("d4", 3, "new")]))
    pinned = store.manifest()
    store.compact()
    after = stamps(store)
    assert len(set(files) - set(after)) == 1 and len(set(after) - set(files)) == 1
    assert all(files[p] == t for p, t in after.items() if p in files)
    assert held(store) == before | {("d4", 3): "new"} == held(store, pinned)
    assert store.compact() == store.manifest()["generation"]  # nothing to do
    assert store.validate().count() == 0


def test_shards_split_and_vanish(spark, store):
    before, files = held(store), stamps(store)
    gone = [(f"d{k // 10}", k % 10, None) for k in range(100) if any(e["lo"] <= [f"d{k // 10}", k % 10] <= e["hi"] for e in store.manifest()["shards"][2:3])]
    new = [("d9", 100 + k, f"x{k}") for k in range(75)] + [("a", 0, "first")]
    store.publish(frame(spark, gone))
    store.publish(frame(spark, new))
    store.compact()
    want = {k: v for k, v in before.items() if (*k, None) not in gone} | {(p, n): h for p, n, h in new}
    shards = store.manifest()["shards"]
    assert held(store) == want and all(e["rows"] <= 10 for e in shards) and sum(e["rows"] for e in shards) == len(want)
    assert all(a["hi"] < b["lo"] for a, b in zip(shards, shards[1:], strict=False))
    assert len(set(files) & set(stamps(store))) >= len(files) - 4 and store.validate().count() == 0
    store.publish(frame(spark, [(*k, None) for k in want]))
    store.compact()
    assert held(store) == {} and store.manifest()["shards"] == []
    store.publish(frame(spark, [("b", 1, "again")]))
    store.compact()
    assert held(store) == {("b", 1): "again"}


def test_validation(spark, store):
    shards = store.manifest()["shards"]
    with open(f"{store.root}/{shards[1]['path']}", "r+b") as f:
        f.seek(20)
        byte = f.read(1)
        f.seek(20)
        f.write(bytes([byte[0] ^ 1]))
    folder, name = os.path.split(f"{store.root}/{shards[1]['path']}")
    os.remove(f"{folder}/.{name}.crc")  # a local file system's own sums, which other stores don't have
    os.remove(f"{store.root}/{shards[4]['path']}")
    wrong = store.manifest()
    wrong["shards"][6] = {**shards[6], "rows": 3}
    wrong["shards"][7] = {**shards[7], "hi": ["zz", 1]}
    found = sorted(map(tuple, store.validate(wrong).collect()))
    assert sorted(found) == sorted([(shards[1]["path"], "checksum"), (shards[4]["path"], "missing"), (shards[6]["path"], "rows"), (shards[7]["path"], "range"), *([(shards[8]["path"], "overlap")] if len(shards) > 8 else [])])


def test_first_build_in_two_steps(spark, tmp_path):
    s = Store(spark, str(tmp_path / "two"), ["path"], shard_rows=50)
    rows = spark.createDataFrame([(f"f{k:03d}", k) for k in range(200)], "path string, hash long")
    wanted = spark.createDataFrame([(f"f{k:03d}", k) for k in (7, 150, 3, 999)], "path string, rank long")
    assert s.build(rows, wanted, most=3) == 2
    first, last = s._manifest("000000000001.json"), s.manifest()
    assert first["coverage"] == "partial" and sorted(r["path"] for r in s.read(first).collect()) == ["f003", "f007", "f150"]
    assert last["coverage"] == "full" and s.read().count() == 200
    copy = Store(spark, str(tmp_path / "copy"), ["path"])
    copy.load(s)
    assert sorted(r["path"] for r in copy.read().collect()) == sorted(r["path"] for r in s.read().collect())


def test_expiry(spark, store):
    old = stamps(store)
    for k in range(3):
        store.publish(frame(spark, [("d0", 1, f"v{k}")]))
        store.compact()
    gone = store.expire(keep=1)
    assert gone and all(not os.path.exists(f"{store.root}/{p}") for p in gone) and set(gone) & set(old)
    assert held(store)[("d0", 1)] == "v2" and store.validate().count() == 0
