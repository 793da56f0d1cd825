import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from corvane.api import Vault
from corvane.config import Config, read_config
from corvane.operators.embedding import HashedModel
from corvane.schemas import struct
from corvane.sources import vault as files
from corvane.sources.snapshots import Catalog, VersionTaken
from corvane.streaming.changes import index_changes


def test_life_of_a_vault(spark, tmp_path):
    root, store = tmp_path / "vault", f"file://{tmp_path}/store"
    (root / "notes").mkdir(parents=True)
    (root / "notes/pid.md").write_text("# Control\n\nA PID controller with integral windup.\n")
    (root / "notes/other.md").write_text("# Cooking\n\nBoil the water.\n")
    (root / "notes/pid.pdf").write_bytes(b"%PDF")
    (root / "notes/skip.png").write_bytes(b"x")
    words = Vault(spark, str(root), store)
    status = words.refresh()
    assert (status.state, status.scanned, status.updated) == ("ready", 2, 2)
    assert words.refresh().skipped == 2
    top = words.search("pid windup").first()
    assert (top["relative_path"], top["match_type"], top["original_pdf"]) == ("notes/pid.md", "bm25", "notes/pid.pdf")
    both = Vault(spark, str(root), store, HashedModel)
    assert both.refresh().updated == 2  # vectors were missing
    stats = json.loads(both.stats())
    assert stats["total_vectors"] == stats["total_chunks"] == 2 and stats["incomplete_documents"] == 0 and stats["bound_pdfs"] == 1
    assert both.search("pid controller").first()["match_type"] == "hybrid"
    assert "notes/pid.md L1-L4" in both.render("pid controller")
    (root / "notes/pid.pdf").unlink()
    (root / "notes/other.md").unlink()
    (root / "notes/new.py").write_text("# heading in code\nx = 1\n")
    status = both.refresh()
    assert (status.updated, status.deleted, status.skipped) == (2, 1, 0)
    stats = json.loads(both.stats())
    assert stats["bound_pdfs"] == 0 and stats["total_documents"] == 2
    assert not any(r["relative_path"] == "notes/other.md" for r in both.search("boil water").collect())
    assert both.read("notes/new.py", 2, 2) == "x = 1" and both.ping("hi")["message"] == "hi"
    for query, limit in ((" ", 5), ("a", -1), ("a", 1.2), ("a", 51), ("x" * 4001, 5)):
        with pytest.raises(ValueError):
            both.search(query, limit)


CHANGE = "path string, revision bigint, op string"


def texts(vault):
    return sorted(r["relative_path"] for r in vault._tables()[1].collect())


def test_changes_touch_the_named_files_only(spark, tmp_path):
    root = tmp_path / "vault"
    root.mkdir()
    for name in "abc":
        (root / f"{name}.md").write_text(f"# {name}\nfirst text\n")
    vault = Vault(spark, str(root), f"file://{tmp_path}/store", HashedModel)
    vault.refresh()
    (root / "a.md").write_text("# a\nsecond text\n")
    (root / "b.md").unlink()
    (root / "c.md").write_text("# c\nnot announced\n")
    (root / "link.md").symlink_to(root / "a.md")
    batch = spark.createDataFrame([("a.md", 1, "change"), ("b.md", 2, "change"), ("link.md", 3, "add"), ("build/x.md", 4, "change")], CHANGE)
    status = vault.on_changes(batch)
    assert (status.updated, status.deleted, status.scanned, status.state) == (1, 1, 1, "ready") and texts(vault) == ["a.md", "c.md"]
    contents = {r["relative_path"]: r["content"] for r in vault._tables()[1].collect()}
    assert "second" in contents["a.md"] and "first" in contents["c.md"]
    again = vault.on_changes(batch)  # a repeated batch changes nothing
    assert (again.updated, again.deleted, again.skipped) == (0, 0, 1)
    (root / "a.pdf").write_bytes(b"%PDF")  # a PDF's event makes a whole refresh
    assert vault.on_changes(spark.createDataFrame([("a.pdf", 5, "add")], CHANGE)).updated == 2
    assert {r["relative_path"]: r["original_pdf"] for r in vault._tables()[0].collect()} == {"a.md": "a.pdf", "c.md": None}


def test_one_unreadable_file_fails_alone(spark, tmp_path, monkeypatch):
    root = tmp_path / "vault"
    root.mkdir()
    (root / "a.md").write_text("# a\nkept\n")
    (root / "b.md").write_text("# b\nfine\n")
    vault = Vault(spark, str(root), f"file://{tmp_path}/store")
    vault.refresh()
    (root / "b.md").write_text("# b\nchanged\n")
    names = files.read_files

    def broken(listing, where):
        odd = F.col("relative_path") == "a.md"
        found = names(listing, where)
        return found.withColumn("error", F.when(odd, "EIO")).withColumn("content", F.when(~odd, F.col("content")))

    monkeypatch.setattr(files, "read_files", broken)
    status = vault.refresh()
    assert (status.state, status.failed, status.updated, status.deleted, status.last_error) == ("degraded", 1, 1, 0, "EIO")
    assert texts(vault) == ["a.md", "b.md"]


def test_files_that_are_gone_are_not_errors(tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.md").write_bytes(b"caf\xff")
    assert files.read_one(str(tmp_path), "d/a.md")[::2] == ("caf�", None)
    assert files.read_one(str(tmp_path), "none.md") == files.read_one(str(tmp_path), "d/a.md/x.md") == files.read_one(str(tmp_path), "d") == (None, None, None)
    assert files.read_one(str(tmp_path), "n" * 5000 + ".md")[2]


def test_texts_are_stored_without_a_model(spark, tmp_path):
    root = tmp_path / "vault"
    root.mkdir()
    (root / "a.md").write_text("# a\nsome words\n")

    def loader():
        raise OSError("no model")

    vault = Vault(spark, str(root), f"file://{tmp_path}/store", loader)
    status = vault.refresh()
    assert (status.state, status.failed, status.last_error) == ("degraded", 1, "no model") and texts(vault) == ["a.md"]
    stats = json.loads(vault.stats())
    assert stats["incomplete_documents"] == 1 and stats["store_kib"] > 0


def test_tables_move_together(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/c")
    assert catalog.current() == (0, {})
    catalog.commit(0, {"a": 3})
    assert catalog.current() == (1, {"a": 3})
    with pytest.raises(VersionTaken):
        catalog.commit(0, {"a": 4})
    assert catalog.current() == (1, {"a": 3})


def test_requests_during_a_refresh_share_one_pass(spark, tmp_path):
    (tmp_path / "vault").mkdir()
    vault, running, go = Vault(spark, str(tmp_path / "vault"), f"file://{tmp_path}/store"), threading.Event(), threading.Event()
    passes = []

    def slow(listing, whole):
        passes.append(1)
        running.set()
        go.wait(20)

    vault._pass = slow
    threads = [threading.Thread(target=vault.refresh) for _ in range(4)]
    threads[0].start()
    running.wait(20)
    for t in threads[1:]:
        t.start()
    time.sleep(1)  # all three have asked by then
    assert vault._again
    go.set()
    for t in threads:
        t.join(20)
    assert len(passes) == 2


def test_config(monkeypatch, tmp_path):
    monkeypatch.chdir(tmp_path)
    assert read_config([], {}) == Config(str(tmp_path / "sample_vault"))
    assert read_config(["--path", "/v", "--other"], {"VAULT_OFFLINE": "1", "VAULT_EMBEDDINGS": "OFF"}) == Config("/v", True, False)


def test_stream_index_by_batches(spark, tmp_path):
    schema = struct("path string, revision bigint, op string, content string")
    log = f"{tmp_path}/log"
    rows = [
        [("a.md", 2, "change", "# x\nold"), ("b.md", 1, "add", "# y\nb"), ("n.png", 1, "add", "# p")],
        [("a.md", 1, "change", "# x\nolder, late"), ("b.md", 3, "unlink", None), ("c.md", 4, "add", None), ("d\\e.md", 5, "add", "text")],
        [("a.md", 6, "change", "# z\nnew"), ("a.md", 5, "unlink", None), ("b.md", 4, "add", "# back")],
    ]
    want = [{("a.md", "x"), ("b.md", "y")}, {("a.md", "x"), ("d/e.md", "Root")}, {("a.md", "z"), ("b.md", "back"), ("d/e.md", "Root")}]
    for batch, expected in zip(rows, want, strict=True):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(log)
        found = index_changes(spark, spark.readStream.schema(schema).parquet(log), f"file://{tmp_path}/run").read()
        assert {(r["relative_path"], r["heading_path"]) for r in found.collect()} == expected
