"""Removal of repeated passages by suffix arrays, built by external induced sorting.

1. Anchors. Every string of ``length`` bytes has an anchor: the place in it where the hash
   of a shorter gram is least. Equal strings have equal anchors, so the starts of a text
   fall into windows, one for each anchor, and equal strings only occur in windows whose
   anchors' grams are equal. A window is known by its gram and by the hash of its bytes.
2. Grams that occur once in the corpus leave. Windows of the same bytes are one class with
   a count: a class that occurs twice repeats as a whole.
   (Two 64-bit hashes, of the gram and of all bytes, must agree for that.)
3. Classes that share a gram with other classes go, as text, to shards: all classes of a gram
   to the same one. A shard's text goes to a file, its suffixes are sorted with their common
   prefixes by queues and sequences on disk and by recursion; a start whose suffix agrees with
   a neighbour in ``length`` bytes is repeated.
4. The repeated starts go back to all places of their classes, and the bytes they cover are
   taken out of the documents.

Texts are read in place for steps 1, 3 and 4; only windows that must be compared are moved.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .induced import Scratch, sorted_suffixes

LOG = logging.getLogger(__name__)
BASE = 0x9E3779B97F4A7C15
#: Bytes of a text that are hashed at once; an anchor's place must fit the bits below.
CHUNK_BITS = 20
CHUNK = (1 << CHUNK_BITS) - 4096
#: Bytes of a gram, as a share of the length.
GRAM_SHARE = 0.5
#: Bytes of windows in a task, and those that close a shard, which one sort takes (one gram's windows stay together).
TASK_BYTES, SHARD_BYTES = 4_000_000, 6_000_000
#: Memory of a sort: tuples beyond which queues and arrays are in files, and names that are sorted without recursion.
TUPLES, NAMES = 1 << 18, 1 << 19
#: All bytes one higher.
RAISED = bytes(range(1, 256)) + b"\0"
#: Classes of a gram beyond which its windows are divided by offset and content.
HOT_CLASSES = 1000
#: Starts in a part of a divided window.
PART_STARTS = 32


class Anchors:
    """Finds the windows of texts; the powers it needs are computed once."""

    def __init__(self, length: int):
        self.length, self.gram = length, max(1, int(length * GRAM_SHARE))
        n = (1 << CHUNK_BITS) + 1
        self.powers, self.inverse = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
        for powers in (self.powers, self.inverse):
            powers[0] = 1
            np.multiply.accumulate(powers, out=powers)

    def _chunk(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n, k, width = len(data), self.gram, self.length - self.gram + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(data * self.powers[:n], out=sums[1:])
        grams = (sums[k:] - sums[:-k]) * self.inverse[: n - k + 1]
        mixed = grams ^ (grams >> np.uint64(29))
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        place = np.uint64((1 << CHUNK_BITS) - 1)
        keys = (mixed & ~place) | np.arange(len(mixed), dtype=np.uint64)  # of equal hashes the first is least
        rows = np.concatenate((keys, np.full(-len(keys) % width, ~np.uint64(0)))).reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - self.length + 1
        at = (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & place).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        return at[first], first, np.append(first[1:], starts), mixed[at[first]]

    def windows(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, first start, end of starts, hash of the gram) of each window of a text."""
        found, n = [], len(data)
        whole = np.frombuffer(data, np.uint8)
        for at in range(0, n - self.length + 1, CHUNK):
            part = whole[at : at + CHUNK + self.length - 1]
            anchor, first, end, gram = self._chunk(part)
            found.append((anchor + at, first + at, end + at, gram))
        if not found:
            return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
        anchor, first, end, gram = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(found) > 1:  # windows that a chunk's border cut are one
            new = np.concatenate(([True], anchor[1:] != anchor[:-1]))
            last = np.append(new[1:], True)
            anchor, first, end, gram = anchor[new], first[new], end[last], gram[new]
        return anchor, first, end, gram


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


ANCHOR = "doc_id long, text_hash long, first int, starts int, gram long, content long"


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text_hash, text: a row for each window."""
    finder = Anchors(length)
    names = [c.split(" ")[0] for c in ANCHOR.split(", ")]
    for batch in batches:
        at, first, starts, grams, contents, rows = [], [], [], [], [], 0

        def flush(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
            index = pa.array(np.concatenate(at))
            columns = [batch.column(0).take(index), batch.column(1).take(index), pa.array(np.concatenate(first).astype(np.int32)), pa.array(np.concatenate(starts).astype(np.int32))]
            columns += [pa.array(np.concatenate(x).view(np.int64)) for x in (grams, contents)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for i, text in enumerate(batch.column(2).to_pylist()):
            data = utf8(text)
            if len(data) < length:
                continue
            _, begin, end, gram = finder.windows(data)
            view, digest = memoryview(data), xxhash.xxh3_64_intdigest
            contents.append(np.array([digest(view[a:b]) for a, b in zip(begin.tolist(), (end + length - 1).tolist(), strict=True)], np.uint64))
            at.append(np.full(len(begin), i))
            first.append(begin)
            starts.append(end - begin)
            grams.append(gram)
            rows += len(begin)
            if rows >= 200_000:
                yield flush()
                at, first, starts, grams, contents, rows = [], [], [], [], [], 0
        if rows:
            yield flush()


def _window_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """wanted (list of first, starts, gram, content, hot), text: a row for each window or part of a divided window."""
    names = ["part", "gram", "content", "begin", "starts", "bytes"]
    finder, cell_starts = None, max(1, min(PART_STARTS, length // 4))
    for batch in batches:
        rows: list[tuple] = []
        for wanted, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = utf8(text)
            for w in wanted:
                first, starts = w["first"], w["starts"]
                if not w["hot"]:
                    rows.append((w["gram"], w["gram"], w["content"], 0, starts, data[first : first + starts + length - 1]))
                    continue
                # Equal strings lie equally far before their anchor: parts go by that distance.
                finder = finder or Anchors(length)
                anchor = first + int(finder.windows(data[first : first + length])[0][0])
                edges = sorted({first, first + starts, *range(anchor - (anchor - first) // cell_starts * cell_starts, first + starts, cell_starts)})
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    cell = -((a - anchor) // cell_starts)
                    low = anchor - cell * cell_starts  # the cell's starts are [low, low + cell_starts)
                    core = data[low + cell_starts - 1 : low + length]  # in all strings that start in the cell
                    key = xxhash.xxh3_64_intdigest(core, cell & 0xFFFF) ^ (w["gram"] & (2**64 - 1))
                    rows.append((key - (1 << 64) if key >> 63 else key, w["gram"], w["content"], a - first, b - a, data[a : b + length - 1]))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            for k in range(0, len(rows), 20_000):
                columns = zip(*rows[k : k + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


class Shard:
    """Windows laid end to end, each closed by a symbol below all bytes; beyond the budget the text is in a file."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.windows, self.held, self.file, self.size, self.waiting = scratch, [], [], None, 0, 0

    def add(self, window: tuple, data: bytes) -> None:
        """``window``: gram, content, begin, starts."""
        self.windows.append((self.size, *window))
        self.held.append(data.translate(RAISED) + b"\0")  # UTF-8 has no byte 255
        self.size += len(data) + 1
        self.waiting += len(data) + 1
        if self.waiting > self.scratch.tuples:
            self.file = self.file or self.scratch.file()
            self.file.write(b"".join(self.held))
            self.held, self.waiting = [], 0

    def text(self) -> np.ndarray:
        if self.file is None:
            return np.frombuffer(b"".join(self.held), np.uint8)
        self.file.write(b"".join(self.held))
        self.file.flush()
        self.held = []
        return np.asarray(np.memmap(self.file, np.uint8, "r+", shape=(self.size,)))

    def runs(self, length: int, base: int) -> Iterator[tuple]:
        """(gram, content, begin, end): runs of starts of a string of ``length`` bytes that another start of any window begins.

        All suffixes of the shard are sorted; a start whose suffix agrees with a neighbour in
        ``length`` bytes is repeated. No string of a start runs over its window's end.
        """
        text = self.text()
        marked, last = self.scratch.array(len(text), bool), None
        for tuples in sorted_suffixes(text, length, self.scratch, base):
            hit = tuples["lcp"] >= length
            before = np.empty(len(tuples), np.int64)
            before[1:], before[0] = tuples["at"][:-1], tuples["at"][0] if last is None else last
            marked[tuples["at"][hit]] = True
            marked[before[hit]] = True
            last = int(tuples["at"][-1])
        for offset, gram, content, begin, starts in self.windows:
            edges = np.flatnonzero(np.diff(np.concatenate(([0], marked[offset : offset + starts].astype(np.int8), [0]))))
            yield from ((gram, content, begin + a, begin + b) for a, b in edges.reshape(-1, 2).tolist())


def _marked_rows(batches: Iterator[pa.RecordBatch], length: int, shard_bytes: int, tuples: int, base: int, tally: dict) -> Iterator[pa.RecordBatch]:
    """Windows sorted by part: runs of repeated starts of each class (begin and end, counted from the window's first start)."""
    names = ["gram", "content", "begin", "end"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    scratch = Scratch(tuples)

    def flush(shard: Shard) -> pa.RecordBatch:
        columns = list(zip(*shard.runs(length, base), strict=True)) or [()] * 4
        tally["shards"] += 1
        tally["bytes"] += shard.size
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    seen: set[tuple] = set()
    shard, part = Shard(scratch), None
    try:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != part:
                    if shard.size >= shard_bytes:
                        yield flush(shard)
                        shard = Shard(scratch)
                    part, seen = row[0], set()
                key = row[1:4]
                if key not in seen:  # repeated rows of the table bring a window twice
                    seen.add(key)
                    shard.add(row[1:5], row[5])
        if shard.windows:
            yield flush(shard)
    finally:
        scratch.close()
    for name, n in scratch.done.items():
        tally[name] += n


def _cut_rows(batches: Iterator[pa.RecordBatch], length: int, keep_text: bool) -> Iterator[pa.RecordBatch]:
    """doc_id, text, runs (begin and end of repeated starts, or null): the result's rows, and the text that stays."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for batch in batches:
        out = []
        for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = utf8(text)
            kept, spans, removed, at = [], 0, 0, 0
            for a, b in sorted((r["begin"], r["end"] + length - 1) for r in runs or ()):
                if a > at or not spans:
                    spans += 1
                    kept.append(data[at:a])
                    removed += b - a
                    at = b
                elif b > at:
                    removed += b - at
                    at = b
            kept.append(data[at:])
            whole = b"".join(kept)
            out.append((len(data), removed, spans, hashlib.sha256(whole).hexdigest(), whole if keep_text else None))
        columns = zip(*out, strict=True) if out else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)


def remove_repeats(
    docs: DataFrame, length: int = 400, shard_bytes: int = SHARD_BYTES, hot_classes: int = HOT_CLASSES, keep_text: bool = False,
    tuples: int = TUPLES, names: int = NAMES,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the bytes that stay) for each row of docs(doc_id, text).

    A byte is removed if a string of ``length`` bytes over it also starts anywhere else in the
    table, the same document included. A null text counts as empty; texts shorter than
    ``length`` keep everything; repeated rows are documents of their own and repeat each other.
    Bytes are those of UTF-8, so a cut may split a character. An empty table gives no rows.
    ``tuples`` and ``names`` bound the memory of a sort. What the sorts did (shards, bytes,
    spills, recursions, mapped arrays) is logged.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    anchors, anchors_path = common.staged(texts.mapInArrow(lambda it: _anchor_rows(it, length), ANCHOR), "anchors")
    twice, twice_path = common.staged(anchors.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "grams")
    grams, rows = twice.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = twice.where(F.col("n") > rows * common.HOT_SHARE).select("gram")
    found, found_path = common.staged(common.keyed_join(anchors, twice.select("gram"), grams, 40, ["gram"], "left_semi", hot), "windows")
    common.drop_path(spark, anchors_path)
    common.drop_path(spark, twice_path)

    place = F.struct(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "text_hash", "first", "starts")
    classes, classes_path = common.staged(found.groupBy("gram", "content").agg(F.count("*").alias("n"), F.min(place).alias("place")), "classes")
    whole = classes.where("n > 1").select("gram", "content", F.lit(0).alias("begin"), F.col("place.starts").alias("end"))
    shared, shared_path = common.staged(classes.groupBy("gram").agg(F.count("*").alias("classes")).where("classes > 1"), "shared")
    grams, rows_shared = shared.agg(F.count("*"), F.coalesce(F.sum("classes"), F.lit(0))).first()
    several = common.keyed_join(classes, shared, grams, 50, ["gram"], hot=shared.where(F.col("classes") > rows_shared * common.HOT_SHARE).select("gram"))
    compared, compared_path = common.staged(
        several.select("place.doc_id", "place.text_hash", F.struct("place.first", "place.starts", "gram", "content", (F.col("classes") > hot_classes).alias("hot")).alias("w")), "compared"
    )
    n_windows, n_bytes = compared.agg(F.count("*"), F.coalesce(F.sum(F.col("w.starts") + length), F.lit(0))).first()
    wanted = compared.groupBy("doc_id", "text_hash").agg(F.collect_list("w").alias("wanted"))
    keyed = texts.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "text_hash", "text")
    with_text = keyed.join(common.small(wanted, n_windows, 130), ["doc_id", "text_hash"]).select("wanted", "text")
    windows = with_text.mapInArrow(lambda it: _window_rows(it, length), "part long, gram long, content long, begin int, starts int, bytes binary")
    tally = {k: spark.sparkContext.accumulator(0) for k in ("shards", "bytes", "spills", "recursions", "mapped")}
    compared_starts = (
        windows.repartition(max(1, -(-n_bytes // TASK_BYTES)), "part").sortWithinPartitions("part", "gram", "content", "begin")
        .mapInArrow(lambda it: _marked_rows(it, length, shard_bytes, tuples, names, tally), "gram long, content long, begin int, end int")
    )
    marks, marks_path = common.staged(compared_starts.unionByName(whole), "marks")
    LOG.info("windows sorted: %s", {"windows": n_windows} | {k: v.value for k, v in tally.items()})

    hot = classes.where(F.col("n") > rows * common.HOT_SHARE).select("gram", "content")
    hits = common.keyed_join(found, marks, marks.count(), 130, ["gram", "content"], hot=hot)
    runs = hits.select(
        F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "text_hash", (F.col("first") + F.col("begin")).alias("begin"), (F.col("first") + F.col("end")).alias("end")
    )
    runs, runs_path = common.staged(_merged(runs), "runs")
    for path in (found_path, classes_path, shared_path, compared_path, marks_path):
        common.drop_path(spark, path)
    size = runs.agg(F.count("*"), F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()
    keys = (F.coalesce(texts["doc_id"], F.lit(-1)) == runs["doc_id"]) & (texts["text_hash"] == runs["text_hash"])
    joined = texts.join(common.small(runs, size[0] * 5 + size[1], 16), keys, "left").select(texts["doc_id"], texts["text"], runs["runs"])
    out = joined.mapInArrow(lambda it: _cut_rows(it, length, keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep_text else out.drop("kept")


def _merged(runs: DataFrame) -> DataFrame:
    """runs(doc_id, text_hash, begin, end): one row for each document with its runs in order; those that touch or overlap are one."""
    document = ["doc_id", "text_hash"]
    before = Window.partitionBy(*document).orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    until = Window.partitionBy(*document).orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = F.coalesce(F.col("begin") > F.max("end").over(before), F.lit(True)).cast("int")
    islands = runs.withColumn("new", new).withColumn("island", F.sum("new").over(until))
    each = islands.groupBy(*document, "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return each.groupBy(*document).agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("runs"))
