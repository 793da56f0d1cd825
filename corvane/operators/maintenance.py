"""Index maintenance as joins: reconciliation, replacement by key, repair, migration, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import paths
from corvane.functions.text import content_hash


def twin_pdfs(files: DataFrame, pdfs: DataFrame) -> DataFrame:
    """files(relative_path) with ``original_pdf``: the PDF that belongs to each Markdown file.

    First the same folder and name, then the same name in any case (the least such path), then
    the PDF named like the folder, beside it. pdfs(pdf_path) are regular files of the vault.
    """
    path = F.col("relative_path")
    folder, name = paths.dirname(path), F.concat(paths.stem(path), F.lit(".pdf"))
    markdown = paths.file_type(path) == "markdown"
    inside = lambda f, n: F.when(f == "", n).otherwise(F.concat(f, F.lit("/"), n))
    parent = F.when(folder != "", inside(paths.dirname(folder), F.concat(paths.basename(folder), F.lit(".pdf"))))
    keyed = files.withColumn("_exact", F.when(markdown, inside(folder, name))).withColumn(
        "_folded", F.when(markdown, F.concat(folder, F.lit("\n"), F.lower(name)))
    ).withColumn("_parent", F.when(markdown, parent))
    there = pdfs.select(F.col("pdf_path")).distinct()
    folded = there.groupBy(F.concat(paths.dirname(F.col("pdf_path")), F.lit("\n"), F.lower(paths.basename(F.col("pdf_path")))).alias("_folded")).agg(F.min("pdf_path").alias("_second"))
    out = keyed.join(there.select(F.col("pdf_path").alias("_exact"), F.col("pdf_path").alias("_first")), "_exact", "left")
    out = out.join(folded, "_folded", "left")
    out = out.join(there.select(F.col("pdf_path").alias("_parent"), F.col("pdf_path").alias("_third")), "_parent", "left")
    return out.withColumn("original_pdf", F.coalesce("_first", "_second", "_third")).select(*files.columns, "original_pdf")


def reconcile(scanned: DataFrame, documents: DataFrame, index_version: str, embeddings_disabled: bool = False) -> DataFrame:
    """relative_path and action (deleted, skipped, updated) of a full scan against the stored documents.

    scanned(relative_path, content, original_pdf). Unchanged means: same hash, current version,
    same PDF (null-safe) and vectors complete, unless embeddings are disabled.
    """
    now = scanned.select("relative_path", content_hash(F.col("content")).alias("_hash"), F.col("original_pdf").alias("_pdf"), F.lit(True).alias("_there"))
    both = now.join(documents, "relative_path", "full_outer")
    complete = F.lit(True) if embeddings_disabled else F.col("vectors_complete")
    same = (F.col("content_hash") == F.col("_hash")) & (F.col("index_version") == index_version) & F.col("original_pdf").eqNullSafe(F.col("_pdf")) & complete
    action = F.when(F.col("_there").isNull(), "deleted").when(F.coalesce(same, F.lit(False)), "skipped").otherwise("updated")
    return both.select("relative_path", action.alias("action"))


def index_status(plan: DataFrame, failed: Column | None = None) -> DataFrame:
    """Counters and state of a reconcile plan; one row."""
    failures = F.count_if(failed) if failed is not None else F.lit(0).cast("long")
    counts = plan.agg(
        F.count_if(F.col("action") != "deleted").alias("scanned"), F.count_if(F.col("action") == "updated").alias("updated"),
        F.count_if(F.col("action") == "skipped").alias("skipped"), F.count_if(F.col("action") == "deleted").alias("deleted"), failures.alias("failed"),
    )
    return counts.withColumn("state", F.when(F.col("failed") > 0, "degraded").otherwise("ready"))


def replace_by_key(stored: DataFrame, fresh: DataFrame, key: str = "relative_path") -> DataFrame:
    """All of ``fresh``, and of ``stored`` the keys that fresh has no rows for."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").select(stored.columns).unionByName(fresh.select(stored.columns))


def delete_by_key(stored: DataFrame, gone: DataFrame, key: str = "relative_path") -> DataFrame:
    return stored.join(gone.select(key).distinct(), key, "left_anti").select(stored.columns)


def purge_stale_vectors(vectors: DataFrame, documents: DataFrame, index_version: str) -> DataFrame:
    """Vectors whose document is there at the current version."""
    current = documents.where(F.col("index_version") == index_version).select("relative_path")
    return vectors.join(current, "relative_path", "left_semi")


def repair_completeness(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, index_version: str) -> DataFrame:
    """documents with ``vectors_complete``: version current and as many vectors as chunks (none of both is complete)."""
    n_chunks = chunks.groupBy("relative_path").agg(F.count("*").alias("_chunks"))
    n_vectors = vectors.where(F.col("embedding").isNotNull()).groupBy("relative_path").agg(F.count("*").alias("_vectors"))
    joined = documents.join(n_chunks, "relative_path", "left").join(n_vectors, "relative_path", "left")
    equal = F.coalesce("_chunks", F.lit(0)) == F.coalesce("_vectors", F.lit(0))
    complete = F.coalesce((F.col("index_version") == index_version) & equal, F.lit(False))
    return joined.withColumn("vectors_complete", complete).select(documents.columns)


def add_columns(stored: DataFrame, schema: T.StructType, defaults: dict[str, object]) -> DataFrame:
    """``stored`` with the columns of ``schema``; those it lacks get their default."""
    have = set(stored.columns)
    return stored.select(*[F.col(f.name) if f.name in have else F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in schema])


def document_state(documents: DataFrame, path: str) -> DataFrame:
    return documents.where(F.col("relative_path") == path.replace("\\", "/")).select("relative_path", "content_hash", "index_version", "original_pdf", "vectors_complete")


def vault_stats(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, index_version: str) -> DataFrame:
    """Totals of the three tables; one row from three one-row aggregates."""
    incomplete = (F.col("index_version") != index_version) | ~F.col("vectors_complete")
    d = documents.agg(F.count("*").alias("total_documents"), F.count_if(incomplete).alias("incomplete_documents"), F.count_distinct("original_pdf").alias("bound_pdfs"))
    c, v = chunks.agg(F.count("*").alias("total_chunks")), vectors.agg(F.count("*").alias("total_vectors"))
    return d.crossJoin(c).crossJoin(v).withColumn("vectors_cover_chunks", F.col("total_vectors") >= F.col("total_chunks"))


def latest_revision(changes: DataFrame, by: str = "path", order: str = "revision") -> DataFrame:
    """Each change with ``status``: the newest revision of its path applies (updated or deleted), all others are superseded."""
    newest = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order))) == 1
    status = F.when(~F.col("_newest"), "superseded").when(F.col("op") == "unlink", "deleted").otherwise("updated")
    return changes.withColumn("_newest", newest).withColumn("status", status).drop("_newest")


def routed(changes: DataFrame) -> DataFrame:
    """changes(path, …) with ``route``: one file's reconciliation, a full one (PDF), or none."""
    path = paths.normalised(F.col("path"))
    route = F.when(paths.is_supported(path), "file").when(paths.extension(path) == ".pdf", "vault").otherwise("ignored")
    return changes.withColumn("route", route)
