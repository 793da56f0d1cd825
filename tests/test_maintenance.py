import pytest

from corvane.functions import paths as P
from corvane.operators import maintenance as M
from corvane.operators.embedding import EmbeddingService, HashedModel, embed_chunks, embed_text
from corvane.operators.windows import token_windows
from corvane.sources import vault as V
from corvane.sources.snapshots import SnapshotTable
from corvane.streaming.changes import STATE, apply_batch, live, run_changes
from pyspark.sql import functions as F


def test_twin_pdfs_three_tiers(spark):
    files = spark.createDataFrame([("p/a.md",), ("p/B.md",), ("q/x/any.md",), ("q/y.md",), ("p/a.py",), ("top.md",)], "relative_path string")
    pdfs = spark.createDataFrame([("p/a.pdf",), ("p/A.PDF",), ("p/b.PDF",), ("q/x.pdf",), ("TOP.pdf",)], "pdf_path string")
    got = {r[0]: r[1] for r in M.twin_pdfs(files, pdfs).collect()}
    assert got == {"p/a.md": "p/a.pdf", "p/B.md": "p/b.PDF", "q/x/any.md": "q/x.pdf", "q/y.md": None, "p/a.py": None, "top.md": "TOP.pdf"}


def test_completeness_without_chunks_is_complete(spark):
    docs = spark.createDataFrame([("a", "1", False), ("b", "1", True), ("c", "0", True)], "relative_path string, index_version string, vectors_complete boolean")
    chunks = spark.createDataFrame([("b", 1), ("b", 2)], "relative_path string, start_line int")
    vectors = spark.createDataFrame([("b", 1, [1.0])], "relative_path string, start_line int, embedding array<float>")
    assert {r[0]: r[2] for r in M.repair_completeness(docs, chunks, vectors, "1").collect()} == {"a": True, "b": False, "c": False}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "relative_path string, n int")
    new = spark.createDataFrame([("a", 9)], "relative_path string, n int")
    once = M.replace_by_key(old, new)
    assert sorted(map(tuple, once.collect())) == [("a", 9), ("b", 1)] == sorted(map(tuple, M.replace_by_key(once, new).collect()))


def test_windows():
    assert [w for w, _ in token_windows("abcdefgh", lambda t: len(t) + 2, 4)] == ["ab", "cd", "ef", "gh"]
    for bad in (0, -1, 1.5, True):
        with pytest.raises(ValueError):
            token_windows("a", len, bad)
    with pytest.raises(ValueError):
        token_windows("x", lambda t: len(t) + 2, 2)


def test_service_waits_after_a_failure():
    clock, loads = [0.0], []

    def loader():
        loads.append(1)
        if len(loads) == 1:
            raise OSError("no file")
        return HashedModel(8)

    service = EmbeddingService(loader, now=lambda: clock[0])
    with pytest.raises(OSError):
        service.embed("a")
    assert service.state == "unavailable"
    with pytest.raises(RuntimeError):
        service.embed("a")
    clock[0] = 30.0
    assert len(service.embed("a")) == 8 and service.state == "ready" and len(loads) == 2
    with pytest.raises(RuntimeError):
        EmbeddingService(loader, enabled=False).embed("a")


def test_one_chunk_fails_alone(spark):
    class Odd(HashedModel):
        def vector(self, text):
            if "bad" in text:
                raise ValueError("bad text")
            return super().vector(text)

    df = spark.createDataFrame([("a", "fine"), ("b", "bad")], "relative_path string, content string")
    got = {r["relative_path"]: (r["embedding"] is None, r["embedding_error"]) for r in embed_chunks(df, lambda: Odd(4)).collect()}
    assert got == {"a": (False, None), "b": (True, "bad text")}
    assert abs(sum(x * x for x in embed_text(HashedModel(8), "one two " * 600)) - 1) < 1e-9


def test_paths_and_ranges(tmp_path, spark):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.md").write_bytes(b"one\r\ntwo\nthree\n")
    (tmp_path / "d/.hidden.md").write_text("x")
    (tmp_path / "build").mkdir()
    (tmp_path / "build/b.md").write_text("x")
    (tmp_path / "link.md").symlink_to(tmp_path / "d/a.md")
    root = str(tmp_path)
    assert V.local_paths(root) == ["d/a.md"] and V.has_link(root, "link.md") and not V.has_link(root, "d/a.md")
    assert V.read_lines(root, "d/a.md") == "one\ntwo\nthree\n" and V.read_lines(root, "d\\a.md", 2, 3) == "two\nthree"
    assert V.read_lines(root, "d/a.md", 3) == "three\n" and V.read_lines(root, "d/a.md", 1, 1) == "one" and V.read_lines(root, "d/a.md", 9) == ""
    df = spark.createDataFrame([("one\r\ntwo\nthree\n",)], "c string")
    assert [df.select(V.line_range(F.col("c"), *r)).first()[0] for r in ((None, None), (2, 3), (3, None), (1, 1), (9, None))] == ["one\ntwo\nthree\n", "two\nthree", "three\n", "one", ""]
    for a, b in ((0, None), (1.5, None), (3, 2), (None, 0)):
        with pytest.raises(ValueError):
            V.read_lines(root, "d/a.md", a, b)
    for bad in ("../x", "..\\x", "d/../../x", "/etc/passwd", "C:\\x", "\\\\s\\x", "", "a\0"):
        with pytest.raises(ValueError):
            V.resolve(root, bad)
    with pytest.raises(ValueError):
        V.read_lines(root, "d")
    names = spark.createDataFrame([("x/IMAGES/a.md",), ("a.TXT",), ("a.pdf",)], "p string")
    assert [r[0] for r in names.select(P.is_supported(F.col("p"))).collect()] == [False, True, False]


def test_snapshots_and_stream(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/t", STATE)
    assert table.read().count() == 0
    rows = spark.createDataFrame([("a", 1, "change"), ("a", 3, "unlink"), ("b", 2, "change")], STATE)
    assert [table.write(rows), table.write(rows.limit(1)), table.write(rows.limit(2))] == [1, 2, 3] and table.versions() == [2, 3]
    state = apply_batch(rows, spark.createDataFrame([("a", 2, "change"), ("b", 9, "unlink"), ("c", 1, "change")], STATE))
    assert sorted(map(tuple, state.collect())) == [("a", 3, "unlink"), ("b", 9, "unlink"), ("c", 1, "change")]
    assert [r["path"] for r in live(state).collect()] == ["c"]
    log = f"{tmp_path}/log"
    rows.coalesce(1).write.parquet(log)
    source = spark.readStream.schema(STATE).parquet(log)
    got = run_changes(spark, source, f"file://{tmp_path}/run")
    assert sorted(map(tuple, got.read().collect())) == [("a", 3, "unlink"), ("b", 2, "change")]
    state.coalesce(1).write.mode("append").parquet(log)
    got = run_changes(spark, source, f"file://{tmp_path}/run")
    assert sorted(map(tuple, got.read().collect())) == [("a", 3, "unlink"), ("b", 9, "unlink"), ("c", 1, "change")]


def test_revisions(spark):
    rows = spark.createDataFrame([("a", 1, "change"), ("a", 2, "unlink"), ("b", 1, "change")], STATE)
    assert sorted((r["path"], r["revision"], r["status"]) for r in M.latest_revision(rows).collect()) == [("a", 1, "superseded"), ("a", 2, "deleted"), ("b", 1, "updated")]
