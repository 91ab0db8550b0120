"""A table store of generations: a manifest names the shards of the base, each a file with a range of keys, and the overlays.

Readers pin a manifest, so they see one generation while later ones are written. The manifest is written to a new file
and renamed through Spark's file system, so any store with an atomic rename will do. It holds one entry a shard, with its
key range, rows, bytes and hash, so a write to a few keys finds the shards that they fall into without reading the others.
"""

from __future__ import annotations

import bisect
import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphlens.operators.store import compaction_due, latest

FORMAT, SHARD_ROWS, WORKING_SET = 2, 1_000_000, 5_000
#: What an empty store says.
EMPTY = {"format": FORMAT, "generation": 0, "coverage": "none", "schema": None, "shards": [], "overlays": [], "batches": {}}


class Store:
    """Rows keyed by ``key`` (strings or integers, never null); ``deleted`` (boolean) marks tombstones, ``generation`` is added
    on publishing. A shard of the base holds at most ``shard_rows`` rows."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], shard_rows: int = SHARD_ROWS) -> None:
        self.spark, self.root, self.key, self.shard_rows = spark, root.rstrip("/"), key, shard_rows

    # --- the manifest ---

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.root}/{folder}")
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def _manifest(self, name: str) -> dict:
        found = json.loads("\n".join(r["value"] for r in self.spark.read.text(f"{self.root}/_manifests/{name}").collect()))
        return found if found.get("format") == FORMAT else {**EMPTY, "generation": found.get("generation", 0)}

    def manifest(self) -> dict:
        """The newest manifest; a store without one is empty. Another format is an empty store, to be rebuilt."""
        names = [n for n in self._names("_manifests") if n.endswith(".json")]
        return self._manifest(names[-1]) if names else dict(EMPTY)

    def _swap(self, manifest: dict) -> None:
        target = f"{self.root}/_manifests/{manifest['generation']:012d}.json"
        fs, temporary = self._fs(f"{self.root}/_manifests/.{uuid.uuid4().hex}")
        stream = fs.create(temporary)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        if not fs.rename(temporary, self._fs(target)[1]):
            fs.delete(temporary, False)
            raise FileExistsError(f"generation {manifest['generation']} is already published")

    # --- files ---

    def _read(self, schema: str, entries: list[dict]) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*[f"{self.root}/{e['path']}" for e in entries]) if entries else self.spark.createDataFrame([], kind)

    def _relative(self, path: Column, folder: str) -> Column:
        return F.concat(F.lit(folder), F.substring_index(path, folder, -1))

    def _measured(self, files: list[str], folder: str = "data/") -> DataFrame:
        """path, bytes and hash of files, read where they lie."""
        found = self.spark.read.format("binaryFile").load(files)
        return found.select(self._relative(F.col("path"), folder).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("hash"))

    def _ranges(self, rows: DataFrame, folder: str = "data/") -> DataFrame:
        """path, rows, and the least and greatest key of each file."""
        keys = F.struct(*self.key)
        found = rows.groupBy(F.col("_metadata.file_path").alias("_p")).agg(F.count("*").alias("rows"), F.min(keys).alias("lo"), F.max(keys).alias("hi"))
        return found.select(self._relative(F.col("_p"), folder).alias("path"), "rows", "lo", "hi")

    def _entries(self, folder: str, schema: str) -> list[dict]:
        """The files under a new folder as entries, in order of their keys."""
        path = f"{self.root}/{folder}"
        rows = self.spark.read.schema(StructType.fromJson(json.loads(schema))).option("recursiveFileLookup", "true").parquet(path)
        measured = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
        measured = measured.select(self._relative(F.col("path"), "data/").alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("hash"))
        found = self._ranges(rows).join(measured, "path").collect()
        entries = [{"path": r["path"], "rows": r["rows"], "bytes": r["bytes"], "hash": r["hash"], "lo": list(r["lo"]), "hi": list(r["hi"])} for r in found]
        return sorted(entries, key=lambda e: e["lo"])

    def _folder(self, generation: int) -> str:
        return f"data/{generation:012d}-{uuid.uuid4().hex[:8]}"

    def shard_of(self, shards: list[dict]) -> Column:
        """Number of the shard that a key falls into: the last one that begins at or before it, else the first."""
        starts = [tuple(e["lo"]) for e in shards]

        @F.pandas_udf("int")
        def place(*columns: pd.Series) -> pd.Series:
            return pd.Series([max(bisect.bisect_right(starts, k) - 1, 0) for k in zip(*(c.tolist() for c in columns), strict=True)], dtype="int32")

        return place(*self.key)

    # --- writing and reading ---

    def publish(self, rows: DataFrame, base: bool = False, coverage: str = "full", batch: tuple[str, int] | None = None) -> int:
        """Write a base (which replaces all; its keys are distinct) or an overlay; returns the new generation. An empty overlay is not written, nor a
        ``batch`` (a stream's name and the number of its micro-batch) that an earlier generation holds already."""
        now = self.manifest()
        if batch and now["batches"].get(batch[0], -1) >= batch[1]:
            return now["generation"]
        if not base and rows.isEmpty():
            return now["generation"]
        generation = now["generation"] + 1
        rows = rows.withColumn("generation", F.lit(generation).cast("long"))
        schema = rows.schema.json()
        if base and "deleted" in rows.columns:
            rows = rows.where("deleted is null or not deleted")
        folder = self._folder(generation)
        rows.repartitionByRange(*self.key).sortWithinPartitions(*self.key).write.option("maxRecordsPerFile", self.shard_rows).parquet(f"{self.root}/{folder}")
        entries = self._entries(folder, schema)
        batches = {**now["batches"], batch[0]: batch[1]} if batch else now["batches"]
        if base:
            parts = {"shards": entries, "overlays": [], "coverage": coverage}
        else:
            parts = {"shards": now["shards"], "overlays": [*now["overlays"], entries], "coverage": now["coverage"] if now["generation"] else coverage}
        self._swap({"format": FORMAT, "generation": generation, "schema": schema, "batches": batches, **parts})
        return generation

    def build(self, rows: DataFrame, working_set: DataFrame, most: int = WORKING_SET) -> int:
        """A first build in two steps: the keys of ``working_set`` (key, rank), the ``most`` first ones, are published before
        all, with coverage ``partial``, so that readers are answered while the rest is written."""
        first = working_set.orderBy("rank", *self.key).limit(most).select(*self.key).distinct()
        early = rows.join(F.broadcast(first), self.key, "left_semi")
        if not early.isEmpty():
            self.publish(early, base=True, coverage="partial")
        return self.publish(rows, base=True)

    def read(self, manifest: dict | None = None) -> DataFrame | None:
        """Live rows of a pinned manifest (default: the newest): the newest row of each key, without tombstones."""
        m = manifest or self.manifest()
        if not m["schema"]:
            return None
        base = self._read(m["schema"], m["shards"])
        if not m["overlays"]:
            return base
        over = self._read(m["schema"], [e for part in m["overlays"] for e in part])
        return latest(base.unionByName(over), self.key, ["generation"], F.coalesce(F.col("deleted"), F.lit(False)))

    def due(self) -> bool:
        m = self.manifest()
        size = lambda entries: F.lit(sum(e["bytes"] for e in entries)).cast("long")
        row = self.spark.range(1).select(compaction_due(F.lit(len(m["overlays"])), size([e for p in m["overlays"] for e in p]), size(m["shards"])).alias("due")).first()
        return bool(m["overlays"]) and row["due"]

    def compact(self) -> int:
        """Fold the overlays into the base. Only shards that an overlay's key falls into are read and written anew; one that
        grew beyond ``shard_rows`` is split, one without rows is dropped, the files of all others stay as they are."""
        m = self.manifest()
        if not m["overlays"]:
            return m["generation"]
        over = latest(self._read(m["schema"], [e for part in m["overlays"] for e in part]), self.key, ["generation"])
        place = self.shard_of(m["shards"])
        over = over.withColumn("_shard", place)
        added = {r["_shard"]: r["n"] for r in over.groupBy("_shard").agg(F.count("*").alias("n")).collect()}
        touched = [m["shards"][k] for k in sorted(added)] if m["shards"] else []
        base = self._read(m["schema"], touched).withColumn("_shard", place)
        live = latest(base.unionByName(over), self.key, ["generation"]).where("deleted is null or not deleted")
        grown = [n + (m["shards"][k]["rows"] if m["shards"] else 0) for k, n in added.items()]
        n_parts = max(1, sum(-(-n // self.shard_rows) for n in grown))
        # a shard that has grown to many is dealt by key ranges, so that no task writes all of it
        dealt = live.repartitionByRange(n_parts, "_shard", *self.key) if max(grown) > 4 * self.shard_rows else live.repartition(n_parts, "_shard")
        folder = self._folder(m["generation"] + 1)
        dealt.sortWithinPartitions("_shard", *self.key).write.partitionBy("_shard").option("maxRecordsPerFile", self.shard_rows).parquet(f"{self.root}/{folder}")
        fresh = self._entries(folder, m["schema"]) if any(n.startswith("_shard=") for n in self._names(folder)) else []
        kept = [e for k, e in enumerate(m["shards"]) if k not in added]
        shards = sorted([*kept, *fresh], key=lambda e: e["lo"])
        self._swap({**m, "generation": m["generation"] + 1, "shards": shards, "overlays": []})
        return m["generation"] + 1

    def load(self, other: Store | DataFrame) -> int:
        """A prebuilt table, or what another store holds, as the new base. Paths are relative, so a copied store is one too."""
        rows = other.read() if isinstance(other, Store) else other
        return self.publish(rows.drop("generation"), base=True)

    # --- upkeep ---

    def validate(self, manifest: dict | None = None) -> DataFrame:
        """(path, problem) of files that are missing, or differ from the manifest in bytes, hash, rows or key range, hold a key twice (shards
        only), and of shards whose ranges overlap. Every file is read where it lies; none gives an empty table."""
        m = manifest or self.manifest()
        entries = [*m["shards"], *(e for part in m["overlays"] for e in part)]
        schema = "path string, problem string"
        if not entries:
            return self.spark.createDataFrame([], schema)
        problems = []
        there = []
        for e in entries:
            fs, p = self._fs(f"{self.root}/{e['path']}")
            (there if fs.exists(p) else problems).append(e if fs.exists(p) else (e["path"], "missing"))
        ordered = m["shards"]
        problems += [(b["path"], "overlap") for a, b in zip(ordered, ordered[1:], strict=False) if b["lo"] <= a["hi"]]
        said = self.spark.createDataFrame([(e["path"], e["bytes"], e["hash"]) for e in there], "path string, _bytes long, _hash string")
        measured = self._measured([f"{self.root}/{e['path']}" for e in there]) if there else None
        found = self.spark.createDataFrame(problems, schema)
        if measured is None:
            return found
        same = (F.col("bytes") == F.col("_bytes")) & (F.col("hash") == F.col("_hash"))
        checked = said.join(measured, "path").withColumn("_same", same)
        found = found.unionByName(checked.where(~F.col("_same")).select("path", F.lit("checksum").alias("problem")))
        whole = {r["path"] for r in checked.where("_same").select("path").collect()}
        sound = [e for e in there if e["path"] in whole]
        if not sound:
            return found
        rows = self._read(m["schema"], sound)
        keys = F.struct(*self.key)
        per_file = rows.groupBy(F.col("_metadata.file_path").alias("_p")).agg(F.count("*").alias("rows"), F.count_distinct(keys).alias("keys"), F.min(keys).alias("lo"), F.max(keys).alias("hi"))
        text = lambda c: F.to_json(F.array(*[F.col(f"{c}.{k}").cast("string") for k in self.key]))
        per_file = per_file.select(self._relative(F.col("_p"), "data/").alias("path"), "rows", "keys", text("lo").alias("lo"), text("hi").alias("hi"))
        spelt = lambda v: json.dumps([str(x) for x in v], separators=(",", ":"), ensure_ascii=False)
        base = {e["path"] for e in m["shards"]}
        want = self.spark.createDataFrame([(e["path"], e["rows"], spelt(e["lo"]), spelt(e["hi"]), e["path"] in base) for e in sound], "path string, _rows long, _lo string, _hi string, _base boolean")
        wrong = F.when(F.coalesce(F.col("rows"), F.lit(0)) != F.col("_rows"), "rows").when((F.col("lo") != F.col("_lo")) | (F.col("hi") != F.col("_hi")), "range").when(F.col("_base") & (F.col("keys") != F.col("rows")), "repeated key")
        return found.unionByName(want.join(per_file, "path", "left").select("path", wrong.alias("problem")).where("problem is not null"))

    def expire(self, keep: int = 2) -> list[str]:
        """Delete manifests but the newest ``keep``, and files that none of those names; returns the files. Readers of an
        older generation must be done."""
        names = [n for n in self._names("_manifests") if n.endswith(".json")]
        kept = [self._manifest(n) for n in names[-keep:]]
        used = {e["path"] for m in kept for part in [m["shards"], *m["overlays"]] for e in part}
        gone = []
        for name in names[:-keep]:
            old = self._manifest(name)
            gone += [e["path"] for part in [old["shards"], *old["overlays"]] for e in part if e["path"] not in used]
            fs, p = self._fs(f"{self.root}/_manifests/{name}")
            fs.delete(p, False)
        for path in sorted(set(gone)):
            fs, p = self._fs(f"{self.root}/{path}")
            fs.delete(p, False)
        return sorted(set(gone))
