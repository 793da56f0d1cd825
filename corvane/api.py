"""The engine: an indexed vault with ping, stats, search and read."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import __version__
from corvane.config import Config
from corvane.functions import paths
from corvane.functions.text import content_hash
from corvane.operators import fusion, keyword, maintenance
from corvane.operators.chunking import chunk
from corvane.operators.embedding import EmbeddingService, Model, embed_chunks
from corvane.schemas import CHUNK_KEY, CHUNK_VECTORS, CHUNKS, DOCUMENTS, INDEX_VERSION, INDEXED_CHUNKS
from corvane.sources import vault as files
from corvane.sources.snapshots import Catalog, SnapshotTable

MAX_QUERY = 4000


@dataclass
class IndexStatus:
    state: str = "idle"
    scanned: int = 0
    updated: int = 0
    skipped: int = 0
    deleted: int = 0
    failed: int = 0
    last_error: str | None = None


class Vault:
    """Tables documents, chunks and vectors below ``store``, kept in step with the files below ``root``.

    ``loader`` makes the embedding model; without one, search is by keywords only.
    """

    def __init__(self, spark: SparkSession, root: str, store: str, loader: Callable[[], Model] | None = None):
        self.spark, self.root, self.loader, self.store = spark, root, loader, store.rstrip("/")
        self.documents = SnapshotTable(spark, f"{self.store}/documents", DOCUMENTS)
        self.chunks = SnapshotTable(spark, f"{self.store}/chunks", INDEXED_CHUNKS)
        self.vectors = SnapshotTable(spark, f"{self.store}/vectors", CHUNK_VECTORS)
        self.catalog = Catalog(spark, f"{self.store}/_catalog")
        self.embeddings = EmbeddingService(loader or (lambda: (_ for _ in ()).throw(RuntimeError("no model"))), enabled=loader is not None)
        self.status = IndexStatus()
        self._lock, self._again = threading.Lock(), False

    @classmethod
    def of(cls, spark: SparkSession, config: Config, store: str, loader: Callable[[], Model] | None = None) -> Vault:
        return cls(spark, config.path, store, loader if config.embeddings else None)

    def _tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """documents, chunks and vectors as of one commit."""
        _, at = self.catalog.current()
        return tuple(t.read(at[name]) if at else self.spark.createDataFrame([], t.schema) for name, t in self._named())

    def _named(self) -> list[tuple[str, SnapshotTable]]:
        return [("documents", self.documents), ("chunks", self.chunks), ("vectors", self.vectors)]

    # Index

    def pdfs(self) -> DataFrame:
        """Paths of the vault's PDF files; PDFs are never opened."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(self.root)
        base = self.root.rstrip("/").split(":", 1)[-1]
        path = F.regexp_replace("path", "^[a-z]+:/*", "/")
        return found.select(F.substring(path, len(base) + 2, 1 << 20).alias("pdf_path"))

    def refresh(self) -> IndexStatus:
        """Brings the tables in step with the files: plan, then delete, replace and embed what the plan names.

        One refresh runs at a time; those asked for meanwhile share one further pass. If the
        listing fails nothing is changed, so files that could not be seen are not taken for
        deleted. A file that cannot be read counts as failed and keeps what is stored of it.
        """
        if not self._lock.acquire(blocking=False):
            self._again = True
            self._lock.acquire()
            if not self._again:  # the pass that ran meanwhile has seen it all
                self._lock.release()
                return self.status
        try:
            while True:
                self._again = False
                self._pass(lambda: self.spark.createDataFrame([(p,) for p in files.local_paths(self.root)], "relative_path string"), whole=True)
                if not self._again:
                    return self.status
        finally:
            self._lock.release()

    def on_changes(self, batch: DataFrame) -> IndexStatus:
        """Applies a batch of newest changes(path, op, …): only the files it names are read again.

        A file that is gone is deleted, whatever the event says. A PDF may belong to any file, so
        its event makes a whole refresh.
        """
        routed = maintenance.routed(batch).select(paths.normalised(F.col("path")).alias("relative_path"), "route").distinct()
        if routed.where("route = 'vault'").limit(1).count():
            return self.refresh()
        with self._lock:
            self._pass(lambda: routed.where("route = 'file'").select("relative_path"), whole=False)
            return self.status

    def _pass(self, listing: Callable[[], DataFrame], whole: bool) -> None:
        self.status = IndexStatus(state="indexing")
        staged = f"{self.store}/_staged/{uuid.uuid4().hex}"
        try:
            self._update(listing(), whole, staged)
        except Exception as error:
            self.status.state, self.status.last_error = "error", str(error)
            raise
        finally:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(staged)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def _update(self, names: DataFrame, whole: bool, staged: str) -> None:
        """The listed files are read once, into a staged snapshot that everything else follows from."""

        def keep(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{staged}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{staged}/{name}")

        scanned = keep(maintenance.twin_pdfs(files.read_files(names, self.root), self.pdfs()), "scanned")
        unread, there = scanned.where(F.col("error").isNotNull()), scanned.where(F.col("content").isNotNull())
        base, at = self.catalog.current()
        stored, old_chunks, old_vectors = self._tables()
        visible = stored if whole else stored.join(scanned.select("relative_path"), "relative_path", "left_semi")
        disabled = self.loader is None
        plan = maintenance.reconcile(there, visible, INDEX_VERSION, disabled).join(unread.select("relative_path"), "relative_path", "left_anti")
        plan = keep(plan, "plan")
        counts = maintenance.index_status(plan).first().asDict()
        problems = {r["relative_path"]: r["error"] for r in unread.select("relative_path", "error").limit(1).collect()}
        counts["failed"] = unread.count()
        changed = plan.where(F.col("action") == "updated").select("relative_path")
        gone = plan.where(F.col("action") != "skipped").select("relative_path")
        fresh = there.join(changed, "relative_path", "left_semi")
        chunks = keep(chunk(fresh).join(fresh.select("relative_path", "original_pdf"), "relative_path").select(*CHUNKS.names), "chunks")
        vectors = self.spark.createDataFrame([], CHUNK_VECTORS)
        if not disabled:
            try:
                self.embeddings.load()
                embedded = keep(embed_chunks(chunks, self.loader), "embedded")
                failures = embedded.where(F.col("embedding_error").isNotNull())
                counts["failed"] += failures.select("relative_path").distinct().count()
                problems |= {r["relative_path"]: r["embedding_error"] for r in failures.limit(1).collect()}
                vectors = embedded.where(F.col("embedding").isNotNull()).select(*CHUNK_VECTORS.names)
            except Exception as error:  # no model: texts are stored all the same, and a later pass makes the vectors
                if self.embeddings.state == "ready":
                    raise
                counts["failed"] += changed.count()
                problems[""] = str(error)
        if counts["failed"]:
            counts["state"], self.status.last_error = "degraded", next(iter(problems.values()))
        new = fresh.select(
            "relative_path", "file_type", "original_pdf", "mtime", F.unix_millis(F.current_timestamp()).alias("created_at"),
            content_hash(F.col("content")).alias("content_hash"), F.lit(INDEX_VERSION).alias("index_version"), F.lit(False).alias("vectors_complete"),
        )
        versions = {
            "chunks": self.chunks.write(maintenance.delete_by_key(old_chunks, gone).unionByName(keyword.with_terms(chunks)), held=at.get("chunks")),
            "vectors": self.vectors.write(maintenance.delete_by_key(old_vectors, gone).unionByName(vectors), held=at.get("vectors")),
        }
        documents = maintenance.delete_by_key(stored, gone).unionByName(new)
        repaired = maintenance.repair_completeness(documents, self.chunks.read(versions["chunks"]), self.vectors.read(versions["vectors"]), INDEX_VERSION)
        versions["documents"] = self.documents.write(repaired, held=at.get("documents"))
        self.catalog.commit(base, versions)
        for k, v in counts.items():
            setattr(self.status, k, v)

    # Tools

    def ping(self, message: str | None = None) -> dict:
        return {"message": message, "version": __version__, "index_version": INDEX_VERSION, "index": self.status.state, "embeddings": self.embeddings.state}

    def stats(self) -> str:
        """Totals and states as JSON."""
        row = maintenance.vault_stats(*self._tables(), INDEX_VERSION).first().asDict()
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.store)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        row["store_kib"] = round(fs.getContentSummary(root).getLength() / 1024) if fs.exists(root) else 0
        return json.dumps(row | {"version": __version__, "index_version": INDEX_VERSION, "index": asdict(self.status), "embeddings": self.embeddings.state}, indent=2)

    def search(self, query: str, limit: int = 5) -> DataFrame:
        """The best chunks, fused from keywords and vectors; keywords alone where no query vector can be had."""
        words = query.strip()
        if not 1 <= len(words) <= MAX_QUERY:
            raise ValueError(f"a query has 1 to {MAX_QUERY} characters")
        if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= keyword.MAX_RESULTS:
            raise ValueError(f"the limit is a whole number from 1 to {keyword.MAX_RESULTS}")
        vector = None
        if self.embeddings.state != "disabled":
            try:
                vector = self.embeddings.embed(words)
            except Exception as error:
                self.status.last_error = str(error)
        _, chunks, vectors = self._tables()
        return fusion.hybrid_search(chunks, vectors, words, vector, limit)

    def render(self, query: str, limit: int = 5) -> str:
        """Search results as one text, after what must be known about them."""
        found = self.search(query, limit)
        order = [F.desc("score"), *([F.asc_nulls_last("_kw"), F.asc("_vec")] if "_kw" in found.columns else CHUNK_KEY)]
        rows = found.collect()  # at most 50
        notes = [] if self.status.state == "ready" else ["The index is not ready; candidates may be incomplete."]
        if not any(r["match_type"] != "bm25" for r in rows):
            notes.append("Keyword candidates only.")
        if not rows:
            return "\n".join([*notes, "No candidates; that does not prove that there is no answer."])
        notes.append(f"{len(rows)} candidates; scores rank them and are no probabilities.")
        if all(r["match_type"] == "vector" for r in rows):
            notes.append("Vector candidates only, without keyword evidence.")
        texts = fusion.rendered(self.spark.createDataFrame(rows, found.schema), order).orderBy("ordinal").collect()
        return "\n".join(notes) + "\n\n" + "\n\n".join(r["rendered"] for r in texts)

    def read(self, relative_path: str, start_line: int | None = None, end_line: int | None = None) -> str:
        return files.read_lines(self.root, relative_path, start_line, end_line)
