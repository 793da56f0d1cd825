"""The pipeline against a plain version of each stage's decision, and the queries on the smallest tables."""

import pytest

import corpus_pipeline
from corvane.llm import queries
from corvane.llm.decontaminate import words
from corvane.session import table

SF = "/root/testdata/sf0.001"


def shingles(text):
    tokens = text.lower().split()
    return {tuple(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))}


def test_stages_by_brute_force(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language_id"](spark, docs, SF).toPandas()
    assert list(first.columns) == corpus_pipeline.COLUMNS and len(first) >= 0.97 * docs.count()
    second = stages["near_dedup"](spark, spark.createDataFrame(first), SF).toPandas()
    sets = {r.doc_id: shingles(r.text) for r in first.itertuples()}
    kept, close, far = set(second["doc_id"]), [], set(sets)
    for a in sets:
        for b in sets:
            if a < b and (similarity := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= 0.8:
                far -= {a, b}
                close.append((a, b))
    assert close and not any(a in kept and b in kept for a, b in close)  # one of a group stays
    assert far <= kept and len(second) == len(kept)
    third = stages["decontaminate"](spark, spark.createDataFrame(second), SF).toPandas()
    items = [" ".join(words(r["text"])) for r in table(spark, SF, "benchmark").collect()]
    verbatim = {r.doc_id for r in second.itertuples() if any(f" {i} " in f" {' '.join(words(r.text))} " for i in items)}
    assert verbatim and not verbatim & set(third["doc_id"]) and len(third) >= len(second) - len(verbatim) - 2
    fourth = stages["secret_scan"](spark, spark.createDataFrame(third), SF).toPandas()
    assert sorted(fourth["doc_id"]) == sorted(third["doc_id"])
    both = third.merge(fourth, on="doc_id")
    changed = both[both["text_x"] != both["text_y"]]
    assert len(changed) and changed["text_y"].str.contains("[SECRET]", regex=False).all()
    last = stages["packing"](spark, spark.createDataFrame(fourth), SF).toPandas()
    assert set(last["doc_id"]) == set(fourth["doc_id"])
    assert corpus_pipeline.run(spark, SF).count() == len(last)


def test_stages_take_awkward_and_empty_documents(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    rows = [(1, None, "en", None, 0, "x"), (None, "a few plain words", None, "s", 17, "x"), (3, "plain words again here", "en", "s", 22, None), (3, "plain words again here", "en", "s", 22, None)]
    for docs in (spark.createDataFrame(rows, kinds), spark.createDataFrame([], kinds)):
        whole = docs.count() > 0
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, SF)
            if name == "packing":
                assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            else:
                assert docs.columns == corpus_pipeline.COLUMNS and (whole or docs.count() == 0)
            if name == "language_id" and whole:  # the text that is null goes; the model knows one language
                assert sorted((r["doc_id"] or 0, r["text"]) for r in docs.collect()) == [(0, "a few plain words"), (3, "plain words again here"), (3, "plain words again here")]
            if name == "near_dedup" and whole:
                assert sorted(r["doc_id"] or 0 for r in docs.collect()) == [0, 3]
        assert docs.select("doc_id").distinct().count() == (2 if whole else 0)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_cover_their_table(spark, name):
    found = queries.QUERIES[name](spark, SF)
    documents = table(spark, SF, "documents").count()
    if name not in ("op2_ann", "op6_decontaminate", "op10_packing"):
        assert found.count() == documents
    elif name == "op10_packing":
        assert found.select("doc_id").distinct().count() == documents
    else:
        assert found.count() > 0
