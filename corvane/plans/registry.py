"""All named queries. Each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import paths, text
from corvane.functions import vectors as V
from corvane.operators import chunking, fusion, keyword, maintenance, vector, windows
from corvane.schemas import DOCUMENTS, INDEX_VERSION
from corvane.session import table
from corvane.sources import vault as files
from corvane.streaming import changes as streams

from . import oracles, views

__all__ = ["ORACLES", "QUERIES"]

#: Keyword query of the retrieval plans: a word, an identifier that is a phrase, and an accented word.
WORDS = "onthe Apache_License éeaux password"
RESULT = ["relative_path", "start_line", "score"]
QUERIES: dict = {}

#: Paths for the path predicates: (path).
PATHS = [
    "notes/a.md", "a.MARKDOWN", "src/x.C", "src/.hidden/a.md", "node_modules/a.js", "A/Build/b.ts", "img/p.png", "deep/Model/x.m", ".md", "x",
    "a\\b\\c.py", "../x.md", "a/../../x.md", "a/./b.md", "/abs.md", "C:/x.md", "\\\\srv\\x.md", "", "a/b/../c.txt", "dist.md", "images/a.md", "a//b.h",
]
LIMITS = [(1, [512.0, 256.0]), (2, [1e30, 300.0]), (3, [0.0, -5.0]), (4, [128.5, 2048.0]), (5, []), (6, [1e6, 1e6 + 1])]


def query(f):
    QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.index(spark, sf_dir)


def _paths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PATHS], "path string")


@query
def hybrid_rrf(spark, sf_dir):
    found = fusion.hybrid_search(_indexed(spark, sf_dir), views.plain_vectors(spark, sf_dir), WORDS, views.query_vector(spark, sf_dir), 10)
    return _rounded(found.select(*RESULT, "match_type", "bm25_rank", "vector_score", F.length("content").alias("content_length")), "score", "bm25_rank", "vector_score")


@query
def bm25_topk(spark, sf_dir):
    return _rounded(keyword.bm25_topk(_indexed(spark, sf_dir), WORDS, 10).select(*RESULT, "bm25_rank"), "score", "bm25_rank")


@query
def bm25_only_fallback(spark, sf_dir):
    found = fusion.hybrid_search(_indexed(spark, sf_dir), views.plain_vectors(spark, sf_dir), WORDS, None, 5)
    return _rounded(found.select(*RESULT, "match_type"), "score")


@query
def vector_topk(spark, sf_dir):
    return _rounded(vector.vector_topk(views.plain_vectors(spark, sf_dir), views.query_vector(spark, sf_dir), 10), "vector_score")


@query
def keyword_or(spark, sf_dir):
    return keyword.matches(_indexed(spark, sf_dir), text.compile_query("onthe Apache_License")).select("relative_path", F.array_max("tf").alias("most"))


@query
def han_bigram_and(spark, sf_dir):
    v = views.vault(spark, sf_dir).select("relative_path", F.lit(1).alias("start_line"), F.lit("Root").alias("heading_path"), "content")
    return keyword.matches(keyword.with_terms(v), text.compile_query("检索引擎分词")).select("relative_path").unionByName(
        keyword.matches(keyword.with_terms(v), text.compile_query("中文API混合检索")).select("relative_path")
    )


@query
def tokenize_terms(spark, sf_dir):
    v = views.vault(spark, sf_dir).select("doc_id", F.explode(text.terms(F.col("content"))).alias("term"))
    return v.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query
def search_text_ngrams(spark, sf_dir):
    v = views.vault(spark, sf_dir)
    return v.select("relative_path", F.array_join(F.filter(text.search_terms(F.col("content"), F.lit(""), F.col("relative_path")), lambda t: t.rlike(text.HAN)), " ").alias("han_terms"))


@query
def chunk_documents(spark, sf_dir):
    found = chunking.chunk(views.vault(spark, sf_dir))
    return found.select("relative_path", "heading_path", "start_line", "end_line", text.content_hash(F.col("content")).alias("content_sha256"))


@query
def heading_breadcrumbs(spark, sf_dir):
    return chunking.chunk(views.vault(spark, sf_dir)).groupBy("heading_path").agg(F.count("*").alias("chunks"), F.min("start_line").alias("first_line"))


@query
def read_line_range(spark, sf_dir):
    return views.vault(spark, sf_dir).select("relative_path", files.line_range(F.col("content"), 2, 5).alias("lines"), F.length(files.line_range(F.col("content"), 4)).alias("rest"))


@query
def scan_supported_files(spark, sf_dir):
    p = F.col("path")
    return _paths(spark).select("path", paths.is_ignored(p).alias("ignored"), paths.is_supported(p).alias("supported"), paths.file_type(p).alias("file_type"))


@query
def path_is_safe(spark, sf_dir):
    return _paths(spark).select("path", paths.is_safe(F.col("path")).alias("safe"))


@query
def twin_pdf_binding(spark, sf_dir):
    return maintenance.twin_pdfs(views.vault(spark, sf_dir).select("relative_path"), views.pdfs(spark, sf_dir))


@query
def reconcile_plan(spark, sf_dir):
    return maintenance.reconcile(views.scanned(spark, sf_dir), views.stored(spark, sf_dir), INDEX_VERSION)


@query
def index_status(spark, sf_dir):
    return maintenance.index_status(reconcile_plan(spark, sf_dir))


@query
def upsert_documents(spark, sf_dir):
    fresh = views.scanned(spark, sf_dir).where(F.col("doc_id") % 10 > 5).select("relative_path", text.content_hash(F.col("content")).alias("content_hash"), F.lit(INDEX_VERSION).alias("index_version"))
    return maintenance.replace_by_key(views.stored(spark, sf_dir).select("relative_path", "content_hash", "index_version"), fresh)


@query
def delete_documents(spark, sf_dir):
    gone = views.vault(spark, sf_dir).where(F.col("doc_id") % 10 == 3)
    return maintenance.delete_by_key(views.stored(spark, sf_dir).select("relative_path", "content_hash"), gone)


@query
def purge_stale_vectors(spark, sf_dir):
    kept = maintenance.purge_stale_vectors(views.plain_vectors(spark, sf_dir), views.stored(spark, sf_dir), INDEX_VERSION)
    return kept.select("relative_path", "start_line")


@query
def repair_completeness(spark, sf_dir):
    repaired = maintenance.repair_completeness(views.stored(spark, sf_dir), views.plain_chunks(spark, sf_dir), views.plain_vectors(spark, sf_dir), INDEX_VERSION)
    return repaired.select("relative_path", "index_version", "vectors_complete")


@query
def migrate_add_columns(spark, sf_dir):
    legacy = views.stored(spark, sf_dir).select("relative_path", "file_type", "original_pdf", "mtime", "created_at")
    return maintenance.add_columns(legacy, DOCUMENTS, {"content_hash": "", "index_version": "", "vectors_complete": False})


@query
def rebuild_search_text(spark, sf_dir):
    return keyword.term_figures(keyword.with_terms(views.plain_chunks(spark, sf_dir)))


@query
def chunk_vector_zip(spark, sf_dir):
    chunks = views.plain_chunks(spark, sf_dir).select("relative_path", F.lit(0).alias("chunk_ix"), F.length("content").alias("n"))
    stored = views.plain_vectors(spark, sf_dir).select("relative_path", F.lit(0).alias("chunk_ix"), "embedding")
    return vector.zip_vectors(chunks, stored).select("relative_path", "chunk_ix", "n", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query
def vector_validation(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    odd = F.when(F.col("vec_id") % 5 == 0, F.array().cast("array<float>")).when(F.col("vec_id") % 7 == 0, F.lit(None).cast("array<float>")).when(
        F.col("vec_id") % 11 == 0, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))
    ).otherwise(F.col("embedding"))
    return e.select("vec_id", V.is_valid(odd).alias("valid"), F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query
def vault_stats(spark, sf_dir):
    stored = views.plain_vectors(spark, sf_dir).where(F.col("embedding").isNotNull())
    return maintenance.vault_stats(views.stored(spark, sf_dir), views.plain_chunks(spark, sf_dir), stored, INDEX_VERSION)


@query
def document_state(spark, sf_dir):
    docs = views.stored(spark, sf_dir)
    return maintenance.document_state(docs, "en\\src1\\doc_1.md").unionByName(maintenance.document_state(docs, "en/none.md"))


@query
def list_document_paths(spark, sf_dir):
    return views.stored(spark, sf_dir).select("relative_path").orderBy("relative_path")


@query
def weighted_pool(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("ix"), (F.col("vec_id") % 7).alias("tokens"), "embedding")
    found = vector.pooled(e, ["label"]).select("label", F.posexplode("embedding").alias("i", "x"))
    return found.select("label", "i", F.round("x", 6).alias("x"))


@query
def token_windows(spark, sf_dir):
    docs = views.plain_chunks(spark, sf_dir)
    return windows.windows(docs, lambda t: len(t) + 2, 402, "relative_path").select("relative_path", "ix", "tokens", F.length("window").alias("n"), text.content_hash(F.col("window")).alias("window_sha256"))


@query
def max_tokens(spark, sf_dir):
    rows = spark.createDataFrame(LIMITS, "id int, limits array<double>")
    return rows.select("id", windows.max_tokens(F.col("limits")).alias("max_tokens"))


@query
def recall_at_k(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    asked = e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("own"))
    few = asked.count() <= 50_000  # a stated query set, of some 300 bytes a row
    scored = e.crossJoin(F.broadcast(asked) if few else asked).where(F.col("vec_id") != F.col("query_id"))
    scored = scored.select("query_id", "vec_id", F.col("label").cast("string").alias("relative_path"), V.dot(F.col("embedding"), F.col("q")).alias("s"))
    top = scored.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id"))).where("n <= 3")
    found = fusion.recall_at_k(top, asked.select("query_id", F.col("own").cast("string").alias("relative_path")))
    return found.select("hits", "queries", F.round("recall", 6).alias("recall"))


@query
def event_routing(spark, sf_dir):
    return maintenance.routed(views.changes(spark, sf_dir)).groupBy("route", "op").agg(F.count("*").alias("events"), F.count_distinct("path").alias("paths"))


@query
def latest_revision(spark, sf_dir):
    return maintenance.latest_revision(views.changes(spark, sf_dir)).groupBy("path").agg(
        F.count_if(F.col("status") == "superseded").alias("superseded"), F.max(F.when(F.col("status") != "superseded", F.col("revision"))).alias("revision"),
        F.max(F.when(F.col("status") != "superseded", F.col("status"))).alias("status"),
    )


@query
def stream_latest_revision(spark, sf_dir):
    schema: T.StructType = table(spark, sf_dir, "events").schema
    # A glob: the source lists files, and a table may be one file or a folder of them.
    log = spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/events.parque[t]")
    return streams.run_changes(spark, views.as_changes(log)).read()


@query
def stream_index(spark, sf_dir):
    schema: T.StructType = table(spark, sf_dir, "events").schema
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir.rstrip('/')}/events.parque[t]")
    found = streams.index_changes(spark, views.as_changes(log, F.concat(F.lit("# "), "event_type", F.lit("\n"), "props").alias("content"))).read()
    return found.select("relative_path", "heading_path", "start_line", "end_line", text.content_hash(F.col("content")).alias("content_sha256"))


@query
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query
def render_candidates(spark, sf_dir):
    found = fusion.hybrid_search(_indexed(spark, sf_dir), views.plain_vectors(spark, sf_dir), WORDS, views.query_vector(spark, sf_dir), 10)
    return fusion.rendered(found, [F.desc("score"), F.asc_nulls_last("_kw"), F.asc("_vec")])


ORACLES = oracles.build()
