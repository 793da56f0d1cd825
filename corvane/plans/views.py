"""The driver's tables as a vault: paths, Markdown texts, PDFs, vectors, stored state, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import content_hash
from corvane.operators import keyword
from corvane.session import spread, table
from corvane.sources.snapshots import work_folder

CODE = "\n### code\n```python\n# not a heading\n~~~\n\nx = 1\n````\n\n"
MATH = "\n$$\n# not a heading\n\n$$ a $$\n$$\n## after\ntext\n"
HAN = "\n混合检索引擎支持C中文API分词 foo_bar\n"


def path(suffix: str = ".md"):
    return F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/doc_"), F.col("doc_id"), F.lit(suffix))


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, relative_path, content: headings, blank lines, code and math blocks, Han text."""
    docs = spread(table(spark, sf_dir, "documents"))
    part = lambda n, s: F.when(F.col("doc_id") % n == 0, s).otherwise("")
    content = F.concat(
        F.lit("# "), "source", F.lit("\n\n## "), "lang", F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")), part(7, CODE), part(11, MATH), part(5, HAN)
    )
    return docs.select("doc_id", path().alias("relative_path"), content.alias("content"))


def plain_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk, for retrieval queries."""
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select(
        "doc_id", path().alias("relative_path"), F.lit(None).cast("string").alias("original_pdf"), F.lit("Root").alias("heading_path"),
        F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.col("text").alias("content"),
    )


#: Folder of the index of each table that this process has indexed: (application, files with size and time).
_INDEXES: dict[tuple, str] = {}


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plain_chunks with their terms, as an index stores them: made once for a table, then read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/documents.parquet")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [fs.getFileStatus(root), *(fs.listStatus(root) if fs.getFileStatus(root).isDirectory() else [])]
    key = (spark.sparkContext.applicationId, *((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))
    indexed = keyword.with_terms(plain_chunks(spark, sf_dir))
    if key not in _INDEXES:
        path = work_folder(spark, "index")
        indexed.write.parquet(path)
        _INDEXES[key] = path
    return spark.read.schema(indexed.schema).parquet(_INDEXES[key])


def plain_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for each chunk, out of all rows of the table; null for each 13th document."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n_vec = max(1, vectors.count())
    docs = table(spark, sf_dir, "documents").select(path().alias("relative_path"), "doc_id", (F.col("doc_id") * 7 % n_vec).alias("vec_id"))
    found = docs.join(vectors, "vec_id")
    vector = F.when(F.col("doc_id") % 13 != 0, F.col("embedding"))
    return found.select("doc_id", "relative_path", F.lit(1).alias("start_line"), vector.alias("embedding"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 3) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


def pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    d = F.col("doc_id")
    same = docs.where(d % 3 == 0).select(path(".pdf").alias("pdf_path"))
    upper = docs.where(d % 3 == 1).select(F.concat("lang", F.lit("/"), "source", F.lit("/DOC_"), "doc_id", F.lit(".PDF")).alias("pdf_path"))
    folder = docs.where((d % 20 < 10) & (F.col("lang") == "en")).select(F.concat("lang", F.lit("/"), "source", F.lit(".pdf")).alias("pdf_path"))
    return same.unionByName(upper).unionByName(folder).distinct()


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as an earlier run left them: some gone since, changed, of an old version or incomplete."""
    d, v = F.col("doc_id"), vault(spark, sf_dir).where(F.col("doc_id") % 10 < 8)
    return v.select(
        "doc_id", "relative_path", F.lit("markdown").alias("file_type"), F.when(d % 4 == 0, F.lit("x.pdf")).alias("original_pdf"),
        F.lit(0).cast("long").alias("mtime"), F.lit(0).cast("long").alias("created_at"),
        F.when(d % 5 == 0, F.lit("stale")).otherwise(content_hash(F.col("content"))).alias("content_hash"),
        F.when(d % 7 == 0, F.lit("0")).otherwise(F.lit("1")).alias("index_version"), (d % 3 != 0).alias("vectors_complete"),
    )


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    v = vault(spark, sf_dir).where(d % 10 != 1)
    return v.select("doc_id", "relative_path", "content", F.when((d % 4 == 0) & (d % 8 != 0), F.lit("x.pdf")).alias("original_pdf"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a change log."""
    return as_changes(table(spark, sf_dir, "events"))


def as_changes(events: DataFrame, *more) -> DataFrame:
    u = F.col("user_id")
    name = F.concat(F.lit("u"), u.cast("string"))
    full = F.when(u % 4 == 0, F.concat(name, F.lit(".md"))).when(u % 4 == 1, F.concat(name, F.lit(".PDF"))).when(u % 4 == 2, F.concat(F.lit("build/"), name, F.lit(".md"))).otherwise(F.concat(name, F.lit("\\a.py")))
    op = F.when(F.col("event_type") == "error", "unlink").otherwise("change")
    return events.select(full.alias("path"), F.col("event_id").cast("long").alias("revision"), op.alias("op"), *more)
