"""Corpus preparation in five stages, from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.
All but the last return the columns of documents. A document without an id is known by its
text; repeated rows of an id count as one document from the second stage on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm import common
from corvane.llm.decontaminate import contaminated
from corvane.llm.langid import UNDETERMINED, fit_language_model, identify_language
from corvane.llm.packing import best_fit_packing
from corvane.llm.secrets import redacted, scan_secrets
from corvane.llm.simhash import similar_documents
from corvane.session import spread, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document stays if its language is likelier than all others together.
LEAST_SCORE = 0.5


def _key() -> Column:
    """The id; without one, a number above all ids that follows from the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is found; a null lang takes the language found."""
    model = fit_language_model(docs, common.residue("doc_id", 5) != 0)
    found = identify_language(docs.select(COLUMNS), model)
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each component of similar texts (five-word shingles, 0.8), once."""
    keyed = docs.select(COLUMNS).withColumn("_key", _key())
    found = similar_documents(keyed.select(F.col("_key").alias("doc_id"), "text"), words=5, similarity=0.8)
    least, _ = common.staged(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_key")).count(), "kept")
    n, repeated = least.agg(F.count("*"), F.count_if(F.col("count") > 1)).first()
    kept = keyed.join(common.small(least.select("_key"), n, 40), "_key", "left_semi")
    if repeated:  # an id that occurs on several rows: the one of least text hash stays
        first = Window.partitionBy("_key").orderBy(F.xxhash64("text"), F.xxhash64("lang", "source", "n_chars"))
        kept = kept.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return kept.select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that cover a benchmark item to 0.8 at least."""
    keyed = docs.select(COLUMNS).withColumn("_key", _key())
    pairs = contaminated(keyed.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), least=5, threshold=0.8)
    hit, _ = common.staged(pairs.select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    return keyed.join(common.small(hit, hit.count(), 40), "_key", "left_anti").select(COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces live-looking credentials by a mark; all documents stay."""
    found = scan_secrets(docs.select(COLUMNS), example_owners=3, keep=COLUMNS)
    text = redacted("text", "live")
    n_chars = F.when(F.size(F.coalesce("live", F.array())) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("text", text).withColumn("n_chars", n_chars).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 1024 tokens."""
    return best_fit_packing(docs, capacity=1024, end_id=2)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secret_scan", secret_scan),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again."""
    docs, path = spread(table(spark, sf_dir, "documents")), None
    for name, stage in STAGES:
        docs, fresh = common.staged(stage(spark, docs, sf_dir), name)
        if path:
            common.drop_path(spark, path)
        path = fresh
    return docs


#: SQL can't express the trained language model, the fingerprints' hash or the packing.
ORACLE_SQL = None
