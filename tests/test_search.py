import math

import pytest

from corvane.functions.text import Phrase, compile_query
from corvane.operators import fusion, keyword, vector

CHUNK = "relative_path string, original_pdf string, heading_path string, start_line int, end_line int, content string"


def indexed(spark, rows):
    return keyword.with_terms(spark.createDataFrame([(f"{i}.md", None, "Root", 1, 1, t) for i, t in enumerate(rows)], CHUNK))


def paths(df):
    return sorted(r["relative_path"] for r in df.collect())


def test_query_compilation():
    assert compile_query("PID控制C中文API foo_bar") == [
        [Phrase(("pid",))], [Phrase(("控制",))], [Phrase(("c",))], [Phrase(("中文",))], [Phrase(("api",))], [Phrase(("foo", "bar"))],
    ]
    assert compile_query("混合检") == [[Phrase(("混合",)), Phrase(("合检",))]]
    assert compile_query("!? ...") == [] and compile_query("字") == [[Phrase(("字",))]]


def test_terms_and_scores(spark):
    df = indexed(spark, ["PID 控制C中文API x", "nothing here", "中文 text", "Éléphant foo_bar", "foo x bar"])
    assert paths(keyword.bm25_topk(df, "中")) == ["0.md", "2.md"]
    assert paths(keyword.bm25_topk(df, "中文")) == ["0.md", "2.md"]
    assert paths(keyword.bm25_topk(df, "api")) == ["0.md"]
    assert paths(keyword.bm25_topk(df, "elephant")) == ["3.md"]
    assert paths(keyword.bm25_topk(df, "foo_bar")) == ["3.md"]
    assert keyword.bm25_topk(df, "?!").count() == 0
    for r in keyword.bm25_topk(df, "中文 nothing").collect():
        assert r["score"] == -r["bm25_rank"] and r["score"] > 0


def test_every_pair_is_required_in_any_order(spark):
    df = indexed(spark, ["混合检索", "检索 合检 混合", "混合检"])
    assert paths(keyword.bm25_topk(df, "混合检索")) == ["0.md", "1.md"]


def test_score_formula(spark):
    rows = ["aa aa bb", "bb cc", "cc dd ee ff", "gg"]
    df = indexed(spark, rows)
    n, lengths = 4, [len(t.split()) + 3 for t in rows]  # "root" and two path terms
    got = {r["relative_path"]: r["score"] for r in keyword.bm25_topk(df, "aa").collect()}
    idf = math.log((n - 1 + 0.5) / 1.5)
    assert got == {"0.md": pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * lengths[0] / (sum(lengths) / n))), abs=1e-12)}


def test_vector_search(spark):
    rows = [("a", 1, [0.1111]), ("b", 1, [0.1122]), ("c", 1, None)]
    df = spark.createDataFrame(rows, "relative_path string, start_line int, embedding array<float>")
    assert [r["relative_path"] for r in vector.vector_topk(df, [1.0]).collect()] == ["b", "a"]
    with pytest.raises(Exception, match="differ in length"):
        vector.vector_topk(df, [1.0, 2.0]).collect()
    for bad in ([], [float("nan")], [float("inf")]):
        with pytest.raises(ValueError):
            vector.vector_topk(df, bad)


def test_fusion_order_and_limits(spark):
    kw = spark.createDataFrame([("a", 1, 3.0, -3.0), ("b", 1, 2.0, -2.0)], "relative_path string, start_line int, score double, bm25_rank double")
    vec = spark.createDataFrame([("c", 1, 0.9), ("b", 1, 0.8)], "relative_path string, start_line int, vector_score double")
    got = [(r["relative_path"], r["match_type"], r["score"]) for r in fusion.fuse(kw, vec, 5).collect()]
    assert got == [("b", "hybrid", 2 / 62), ("a", "bm25", 1 / 61), ("c", "vector", 1 / 61)]
    assert [keyword.clamp_limit(x) for x in (0, -3, 7.9, 99, float("nan"), float("inf"))] == [1, 1, 7, 50, 10, 10]


def test_no_words_no_result_whatever_the_vector_says(spark):
    df = indexed(spark, ["abc"])
    stored = spark.createDataFrame([("0.md", 1, [1.0])], "relative_path string, start_line int, embedding array<float>")
    assert fusion.hybrid_search(df, stored, "...", [1.0]).count() == 0
    found = fusion.hybrid_search(df, stored, "zzz", [1.0]).collect()
    assert [(r["match_type"], r["content"]) for r in found] == [("vector", "abc")]
    plain = fusion.hybrid_search(df, stored, "abc", None).collect()
    assert plain[0]["match_type"] == "bm25" and plain[0]["score"] == -plain[0]["bm25_rank"]


def test_pooling(spark):
    rows = [("x", 0, 1, [1.0, 0.0]), ("x", 1, 2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, ix int, tokens int, embedding array<double>")
    assert vector.pooled(df, ["id"]).first()["embedding"] == pytest.approx([1 / 5**0.5, 2 / 5**0.5])
