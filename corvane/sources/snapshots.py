"""Versioned table snapshots: whole new versions, put in place by one rename; a catalog that moves several tables at once."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir; below a temporary folder where none is set (local tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.gettempdir()
    path = f"{base.rstrip('/')}/corvane/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


class VersionTaken(RuntimeError):
    """Another writer has put the same version in place."""


def rename_once(spark: SparkSession, source, target) -> None:
    """Renames a file or folder of the JVM's file system; fails if the target is there already."""
    jvm = spark._jvm
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(source, target, options)
    except Exception as error:
        source.getFileSystem(spark._jsc.hadoopConfiguration()).delete(source, True)
        if "AlreadyExists" in str(error):
            raise VersionTaken(f"{target.getName()} is in place already") from error
        raise


class SnapshotTable:
    """A table of numbered versions below ``root``; a version is there once its folder has its final name."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        if not self.fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(""))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def read(self, version: int | None = None) -> DataFrame:
        """A version, the newest by default; an empty table before the first one."""
        found = self.versions()
        if not found and version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/v{found[-1] if version is None else version:010d}")

    def write(self, rows: DataFrame, keep: int = 2, held: int | None = None) -> int:
        """Writes the next version and drops all but the newest ``keep`` and the ``held`` one; readers see whole versions only."""
        version = (self.versions() or [0])[-1] + 1
        name = f".{uuid.uuid4().hex}"
        rows.select(*[f.name for f in self.schema]).write.parquet(f"{self.root}/{name}")
        rename_once(self.spark, self._path(name), self._path(f"v{version:010d}"))
        for old in self.versions()[:-keep]:
            if old != held:
                self.fs.delete(self._path(f"v{old:010d}"), True)
        return version


class Catalog:
    """Which version of each table is current: small files, so that all tables move together or not at all."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> tuple[int, dict[str, int]]:
        """(number, version of each table); (0, {}) before the first commit."""
        fs = self._fs()
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        newest = max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)
        if not newest:
            return 0, {}
        stream = fs.open(self._path(f"v{newest:010d}.json"))
        try:
            text = self.spark._jvm.org.apache.hadoop.shaded.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return newest, json.loads(text)

    def commit(self, base: int, versions: dict[str, int]) -> None:
        """Makes ``versions`` current if ``base`` still is."""
        held = self._path(f".{uuid.uuid4().hex}")
        stream = self._fs().create(held, False)
        stream.write(bytearray(json.dumps(versions).encode()))
        stream.close()
        rename_once(self.spark, held, self._path(f"v{base + 1:010d}.json"))
