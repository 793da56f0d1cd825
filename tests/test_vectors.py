"""Every row of the vector table takes part, whatever its size."""

from pyspark.sql import functions as F

from corvane.plans import registry, views
from corvane.session import table

SF = "/root/testdata/sf0.1"


def test_all_vectors_are_searched(spark):
    vectors = views.plain_vectors(spark, SF).where(F.col("embedding").isNotNull())
    assert vectors.select("embedding").distinct().count() == table(spark, SF, "embeddings").count() == 2000
    query = views.query_vector(spark, SF)
    scores = sorted((sum(a * b for a, b in zip(r["embedding"], query, strict=True)) for r in vectors.select("embedding").collect()), reverse=True)
    got = [r["vector_score"] for r in registry.QUERIES["vector_topk"](spark, SF).orderBy(F.desc("vector_score")).collect()]
    assert all(abs(a - b) < 1e-5 for a, b in zip(got, scores, strict=False)) and len(got) == 10
