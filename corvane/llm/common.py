"""Shared folder, staging and small helpers for the corpus operators."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors need not have the package installed: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules["corvane"])

#: Rows of text in one Arrow batch; with long documents Spark's default of 10,000 is too many.
TEXT_ROWS_PER_BATCH = 1000


def prepare(spark: SparkSession) -> None:
    """Lowers the Arrow batch size from Spark's default, so that a batch of texts stays small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > TEXT_ROWS_PER_BATCH:
        spark.conf.set(key, str(TEXT_ROWS_PER_BATCH))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir.

    Only where the session names none (tests in local mode) is a temporary folder chosen.
    """
    key = "spark.checkpoint.dir"
    found = spark.sparkContext.getConf().get(key) or spark.conf.get(key, None)
    if not found:
        set_by_call = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_by_call.isDefined():
            return set_by_call.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of the JVM for any URI."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/corvane/{name}-{uuid.uuid4().hex}"
    fs, jpath = hadoop(spark, path)
    fs.deleteOnExit(jpath)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a staged folder that nothing reads any more."""
    fs, jpath = hadoop(spark, path)
    fs.delete(jpath, True)


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes ``df`` as Parquet in the shared folder; (what reads it back, its path).

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def residue(column: str, modulus: int):
    """crc32 of the decimal text of an id, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


#: Bytes up to which a table is broadcast instead of shuffled.
BROADCAST_BYTES = 48_000_000


def small(df: DataFrame, rows: int, bytes_a_row: int) -> DataFrame:
    """``df`` marked for broadcast if its rows, counted before, are few enough; else as it is, for a shuffle join."""
    return F.broadcast(df) if rows * bytes_a_row <= BROADCAST_BYTES else df


#: A key with more than this share of the rows is hot, so there are at most as many hot keys as its inverse.
HOT_SHARE = 0.001


def keyed_join(rows: DataFrame, keyed: DataFrame, n: int, bytes_a_row: int, on: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``keyed``, whose ``n`` rows are few for each key, while one key may have a third of ``rows``.

    ``keyed`` is broadcast if it is small enough. Else the rows of hot keys are joined with
    these keys' part of it, which is broadcast, and only the others are shuffled. ``hot``: the
    hot keys, where they are known from counts taken before.
    """
    if n * bytes_a_row <= BROADCAST_BYTES:
        return rows.join(F.broadcast(keyed), on, how)
    if hot is None:
        least = rows.count() * HOT_SHARE
        hot = rows.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > least).select(*on)
    hot, _ = staged(hot, "hot")
    split = F.broadcast(hot)  # at most 1 / HOT_SHARE keys
    few = rows.join(split, on, "left_anti").join(keyed, on, how)
    many = rows.join(split, on, "left_semi").join(F.broadcast(keyed.join(split, on, "left_semi")), on, how)
    return few.unionByName(many)
