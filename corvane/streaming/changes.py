"""Change streams: an event log applied to a table, newest revision of each path first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import paths
from corvane.operators.chunking import chunk
from corvane.operators.maintenance import delete_by_key, routed
from corvane.schemas import CHUNKS, struct
from corvane.sources.snapshots import SnapshotTable, work_folder

STATE = struct("path string, revision bigint, op string")


def newest(changes: DataFrame) -> DataFrame:
    """The newest revision of each path, with all its columns; partial maxima are taken before the shuffle."""
    rest = [c for c in changes.columns if c not in ("path", "revision")]
    return changes.groupBy("path").agg(F.max(F.struct("revision", *rest)).alias("x")).select("path", "x.*")


def newer(changes: DataFrame, state: DataFrame) -> DataFrame:
    """The changes that no revision in the state overtakes."""
    known = state.select("path", F.col("revision").alias("_known"))
    return changes.join(known, "path", "left").where(F.col("_known").isNull() | (F.col("revision") > F.col("_known"))).drop("_known")


def apply_batch(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The state after a micro-batch. Tombstones stay, so that an older revision that comes late changes nothing."""
    return newest(state.select("path", "revision", "op").unionByName(batch.select("path", "revision", "op")))


def live(state: DataFrame) -> DataFrame:
    return state.where(F.col("op") != "unlink")


def run_changes(
    spark: SparkSession, source: DataFrame, root: str | None = None, on_batch: Callable[[DataFrame], None] | None = None
) -> SnapshotTable:
    """Applies all that a streaming source(path, revision, op, …) has now; returns the state table.

    ``on_batch`` gets the newest change of each path, unless the state knows a newer one, before
    the state is written. Applying a batch twice changes nothing, so a batch that is repeated
    after a failure is safe if ``on_batch`` has that property too.
    """
    root = root or work_folder(spark, "changes")
    table = SnapshotTable(spark, f"{root}/state", STATE)

    def apply(batch: DataFrame, _: int) -> None:
        state = table.read()
        fresh = newer(newest(batch), state)
        if on_batch is not None:
            on_batch(fresh)
        table.write(apply_batch(state, fresh))

    query = source.writeStream.foreachBatch(apply).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return table


def index_changes(spark: SparkSession, source: DataFrame, root: str | None = None) -> SnapshotTable:
    """Keeps a table of chunks in step with a streaming source(path, revision, op, content); returns it.

    Each batch is an immutable snapshot: the chunks of all paths it names are taken out, and
    those of paths that still have a content are put in. Paths that are not indexed are passed
    over. A null content counts as a deletion.
    """
    root = root or work_folder(spark, "changes")
    table = SnapshotTable(spark, f"{root}/chunks", CHUNKS)

    def index(fresh: DataFrame) -> None:
        named = routed(fresh).where("route = 'file'").withColumn("relative_path", paths.normalised(F.col("path")))
        there = named.where((F.col("op") != "unlink") & F.col("content").isNotNull()).select("relative_path", "content")
        rows = chunk(there).withColumn("original_pdf", F.lit(None).cast("string")).select(*CHUNKS.names)
        table.write(delete_by_key(table.read(), named).unionByName(rows))

    run_changes(spark, source, root, index)
    return table


def superseded(changes: DataFrame) -> DataFrame:
    """Revisions that a newer one of their path overtook."""
    order = Window.partitionBy("path").orderBy(F.desc("revision"))
    return changes.withColumn("_n", F.row_number().over(order)).where("_n > 1").drop("_n")
