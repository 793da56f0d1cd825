"""Best-fit packing of token sequences, hierarchically.

Each task packs its own pieces best-fit (longest first). Bins that are full, or nearly
so, leave at once; the underfull bins travel on as items. A tree of merge rounds brings
the underfull bins of several tasks together and packs them best-fit again, until one
task packs what is left. A task hands on few underfull bins, so each round is far smaller
than the one before it. Rows carry lengths and checksums only, never the tokens.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters that both libraries split alike; other texts go to `tokenizers` itself.
PLAIN = re.compile("[\t\n\r -~À-ɏ]*")
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
FIELDS = [c.split(" ")[0] for c in PIECE.split(", ")]
BIN = f"ready boolean, bin long, used long, content array<struct<{', '.join(c.replace(' ', ': ', 1) for c in PIECE.split(', '))}>>"

#: Items that a task holds; one that reads more packs them, lets its full bins go and reads on, so its memory is bounded.
HELD_ITEMS = 200_000


def tokenizer_path() -> str:
    """The default vocabulary file; any other file of the `tokenizers` library may be given instead."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Texts to arrays of ids, exactly as the `tokenizers` library gives them.

    A byte-level vocabulary is also loaded as merge ranks: on plain characters the rank
    encoder gives the same ids several times faster. All other texts, those that hold an
    added token of the vocabulary (such as its end mark), and vocabularies of another kind,
    take the library itself, at its defaults.
    """

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.exact.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and PLAIN.fullmatch(text) and not (self.added and self.added.search(text)):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full pieces, but the first may be shorter."""
    first = n % capacity or capacity
    if n <= capacity:
        return [(0, n)]
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def _pieces(batches: Iterator[pa.RecordBatch], capacity: int, end_id: int, paths: tuple) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(*paths)
    for batch in batches:
        rows = []
        for at, text in enumerate(batch.column(1).to_pylist()):
            ids = np.append(encoder.ids(text or ""), np.uint32(end_id)).astype("<u4")
            data = memoryview(ids.tobytes())
            for k, (start, length) in enumerate(cut(len(ids), capacity)):
                rows.append((at, k, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
        at, *columns = zip(*rows, strict=True) if rows else [()] * 5
        doc_ids = batch.column(0).take(pa.array(at, pa.int64()))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([doc_ids, *map(pa.array, columns, kinds)], names=FIELDS)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of positions in ``sizes``; sizes are taken largest first, each into the fullest bin that holds it."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set while some open bin has room r
    bins: list[list[int]] = []
    for at in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[at]
        fitting = rooms >> size
        if size and fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[own].append(at)
        else:
            room, own = capacity, len(bins)
            bins.append([at])
        if room - size:
            by_room[room - size].append(own)
            rooms |= 1 << (room - size)
    return bins


def _pack(batches: Iterator[pa.RecordBatch], capacity: int, slack: int, level: int, final: bool) -> Iterator[pa.RecordBatch]:
    """Items to bins; at level 0 an item is a piece, later an underfull bin. In the final round all bins are ready."""
    prefix = (level << 56) | (TaskContext.get().partitionId() << 32)
    made = 0
    held: list[tuple[int, list]] = []
    kinds = [pa.field(n, pa.int32() if n == "piece" else pa.int64()) for n in FIELDS]

    def rows(found: list[tuple[bool, int, list]]) -> pa.RecordBatch:
        nonlocal made
        columns = [
            pa.array([x[0] for x in found], pa.bool_()),
            pa.array(range(prefix + made, prefix + made + len(found)), pa.int64()),
            pa.array([x[1] for x in found], pa.int64()),
            pa.array([x[2] for x in found], pa.list_(pa.struct(kinds))),
        ]
        made += len(found)
        return pa.RecordBatch.from_arrays(columns, names=["ready", "bin", "used", "content"])

    def packed(items: list[tuple[int, list]], last: bool) -> tuple[list, list]:
        done, rest = [], []
        for own in best_fit([x[0] for x in items], capacity):
            used, content = sum(items[i][0] for i in own), [p for i in own for p in items[i][1]]
            if last or used >= capacity - slack:
                done.append((True, used, content))
            else:
                rest.append((used, content))
        return done, rest

    for batch in batches:
        if level:
            held += zip(batch.column("used").to_pylist(), batch.column("content").to_pylist(), strict=True)
        else:
            held += [(p["length"], [p]) for p in batch.to_pylist()]
        if len(held) >= HELD_ITEMS:  # a very large task packs what it holds and goes on with the rest
            done, held = packed(held, False)
            if done:
                yield rows(done)
    done, rest = packed(held, final)
    found = done + [(False, used, content) for used, content in rest]
    for at in range(0, len(found), 10_000):
        yield rows(found[at : at + 10_000])


def best_fit_packing(
    docs: DataFrame,
    capacity: int = 1024,
    end_id: int = 2,
    slack: int = 2,
    fan_in: int = 8,
    tokenizer: str | None = None,
    ranks: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """Pieces of docs(doc_id, text) with their place in sequences of at most ``capacity`` ids.

    Each document is its ids and then ``end_id``; only documents longer than ``capacity``
    are cut. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null
    or empty text is the end id alone. Repeated rows are packed each; null ids stay null.
    An empty table gives no rows; other columns are ignored. ``slack``: room that counts as
    nearly full, so that a bin leaves before the last round.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    if tokenizer is None:
        import public_tokenizers

        tokenizer, ranks, pattern = tokenizer_path(), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    paths = (tokenizer, ranks, pattern)
    pieces, pieces_path = common.staged(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            lambda it: _pieces(it, capacity, end_id, paths), PIECE
        ),
        "pieces",
    )
    full = pieces.where(F.col("length") == capacity).select(
        F.lit(True).alias("ready"), F.monotonically_increasing_id().bitwiseOR(F.lit(1 << 62)).alias("bin"),
        F.col("length").alias("used"), F.array(F.struct(*FIELDS)).alias("content"),
    )
    short = pieces.where(F.col("length") < capacity)
    tasks = short.rdd.getNumPartitions()
    results, level = [full], 0
    items = short
    while True:
        final = tasks == 1

        def pack(it, level=level, final=final):
            return _pack(it, capacity, slack, level, final)

        bins, _ = common.staged(items.mapInArrow(pack, BIN), f"bins{level}")
        results.append(bins.where("ready"))
        if final:
            break
        tasks = -(-tasks // fan_in)
        items = bins.where("not ready").coalesce(tasks)
        level += 1
    ready = results[0]
    for more in results[1:]:
        ready = ready.unionByName(more)
    placed = ready.select(
        F.col("bin").alias("sequence_id"),
        F.posexplode("content").alias("at", "p"),
        F.transform("content", lambda x: x["length"]).alias("lengths"),
    )
    offset = F.aggregate(F.slice("lengths", 1, F.col("at")), F.lit(0).cast("long"), lambda a, x: a + x)
    return placed.select(*[F.col(f"p.{c}").alias(c) for c in FIELDS], "sequence_id", offset.alias("offset"))
