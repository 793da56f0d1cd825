"""Sharding by size-tiered compaction, under a versioned manifest.

Arrivals are appended as small immutable shards. Shards of similar size form a tier; once a
tier has enough of them they are merged into files of the target size, which no later merge
touches. Every change is a new manifest, put in place by one rename that fails if another
writer was first; readers see whole versions only. Only DataFrame readers and writers touch
rows; the driver handles file names and sizes, one entry for each shard.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int


class ConcurrentCommit(RuntimeError):
    """Another writer has put the same version in place."""


class ShardStore:
    """A folder of immutable shards with manifests ``_manifests/v<number>.json``."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fan_in: int = 4, least_bytes: int = 1 << 20):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fan_in, self.least_bytes = target_bytes, fan_in, least_bytes
        self.fs, _ = common.hadoop(spark, self.root)

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    # Manifests

    def versions(self) -> list[int]:
        folder = self._path("_manifests")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The given version (the newest one by default); version 0 has no shards."""
        version = (self.versions() or [0])[-1] if version is None else version
        if version == 0:
            return {"version": 0, "schema": None, "shards": []}
        stream = self.fs.open(self._path("_manifests", f"v{version:010d}.json"))
        try:
            text = self.spark._jvm.org.apache.hadoop.shaded.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        return found | {"shards": [Shard(**s) for s in found["shards"]]}

    def commit(self, base: dict, schema: str | None, shards: list[Shard]) -> dict:
        """Puts the version after ``base`` in place, whole or not at all."""
        version = base["version"] + 1
        found = {"version": version, "schema": schema, "shards": [asdict(s) for s in shards]}
        held = self._path("_manifests", f".{uuid.uuid4().hex}")
        stream = self.fs.create(held, False)
        stream.write(bytearray(json.dumps(found).encode()))
        stream.close()
        jvm, final = self.spark._jvm, self._path("_manifests", f"v{version:010d}.json")
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(held, final, options)
        except Exception as error:
            self.fs.delete(held, False)
            if "AlreadyExists" in str(error):
                raise ConcurrentCommit(f"version {version} is in place") from error
            raise
        return found | {"shards": shards}

    # Shards

    def _written(self, folder: str) -> list[Shard]:
        """Shards below a folder that a finished job wrote; files without rows are left out."""
        counts = self.spark.read.option("recursiveFileLookup", "true").parquet(folder).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).count()
        return sorted((Shard(r["path"], r["size"], r["count"]) for r in counts.collect() if r["count"]), key=lambda s: s.path)

    def append(self, rows: DataFrame, arrival: Column | None = None) -> dict:
        """Adds rows as new shards: one version, or one for each value of ``arrival`` in order.

        All arrivals are written in one pass; numbers are ordered as numbers, all else as text.
        A table without rows commits its schema only. If a commit fails, the shards that no
        version names are deleted; arrivals committed before it stay.
        """
        folder = "/".join((self.root, "data", uuid.uuid4().hex))
        schema = rows.schema.json()
        if arrival is None:
            rows.write.option("compression", "zstd").parquet(folder)
            batches = [self._written(folder)]
        else:
            name = next(n for n in (f"_arrival{k}" for k in range(len(rows.columns) + 1)) if n not in rows.columns)
            rows.withColumn(name, arrival).write.option("compression", "zstd").partitionBy(name).parquet(folder)
            by_arrival: dict[str, list[Shard]] = {}
            for s in self._written(folder) if self._any(folder) else []:
                by_arrival.setdefault(s.path.rsplit("/", 2)[1], []).append(s)
            batches = [by_arrival[k] for k in sorted(by_arrival, key=_arrival_order)] or [[]]
        base = self.manifest()
        for k, shards in enumerate(batches):
            try:
                base = self.commit(base, schema, base["shards"] + shards)
            except Exception:
                for path in (s.path for own in batches[k:] for s in own):
                    self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), False)
                raise
        return base

    def _any(self, folder: str) -> bool:
        return any(s.isDirectory() for s in self.fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(folder)))

    def tier(self, shard: Shard) -> int | None:
        """Number of the size class; None for shards that have about the target size and rest."""
        if shard.bytes * 2 > self.target_bytes:
            return None
        return max(0, math.floor(math.log(max(shard.bytes, 1) / self.least_bytes, self.fan_in)))

    def compact(self) -> dict:
        """Merges tiers of ``fan_in`` shards or more, smallest first, until none is left."""
        base = self.manifest()
        while True:
            tiers: dict[int, list[Shard]] = {}
            for s in base["shards"]:
                if (t := self.tier(s)) is not None:
                    tiers.setdefault(t, []).append(s)
            ripe = sorted(t for t, own in tiers.items() if len(own) >= self.fan_in)
            if not ripe:
                return base
            own = tiers[ripe[0]]
            files = max(1, round(sum(s.bytes for s in own) / self.target_bytes))
            folder = "/".join((self.root, "data", uuid.uuid4().hex))
            # Whole input files go to a task, so rows are not shuffled.
            self._read(base["schema"], own).coalesce(files).write.option("compression", "zstd").parquet(folder)
            merged, gone = self._written(folder), {s.path for s in own}
            if sum(s.rows for s in merged) != sum(s.rows for s in own):
                raise RuntimeError("a merge must keep all rows")
            base = self.commit(base, base["schema"], [s for s in base["shards"] if s.path not in gone] + merged)

    def vacuum(self, keep_versions: int = 1) -> int:
        """Deletes older manifests and the shards that only they name; the number of shards deleted."""
        versions = self.versions()
        kept = {s.path for v in versions[-keep_versions:] for s in self.manifest(v)["shards"]}
        old = {s.path for v in versions[:-keep_versions] for s in self.manifest(v)["shards"]} - kept
        for path in sorted(old):
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), False)
        for v in versions[:-keep_versions]:
            self.fs.delete(self._path("_manifests", f"v{v:010d}.json"), False)
        return len(old)

    def _read(self, schema: str | None, shards: list[Shard]) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema)) if schema else T.StructType([])
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[s.path for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version; repeated rows stay as often as they came."""
        found = self.manifest(version)
        return self._read(found["schema"], found["shards"])


def _arrival_order(folder: str) -> tuple:
    """Folder names `_arrival0=<value>`: numbers first, by value."""
    value = folder.split("=", 1)[1]
    try:
        return (0, float(value), value)
    except ValueError:
        return (1, 0.0, value)


def reshard(rows: DataFrame, root: str, arrivals: int = 4, key: str = "doc_id", **sizes) -> ShardStore:
    """Takes a table in as ``arrivals`` batches (by a hash of ``key``), compacts it and drops what the merges replaced.

    Nulls, long and empty texts, repeated rows and any further columns pass through as they
    are; a table without rows gives a store without shards.
    """
    store = ShardStore(rows.sparkSession, root, **sizes)
    store.append(rows, F.pmod(F.xxhash64(key), F.lit(arrivals)))
    store.compact()
    store.vacuum()
    return store
