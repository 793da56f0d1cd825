"""Exact similarity of shingle sets: blocks by rare prefixes, bit slices compared in them, hits verified exactly.

A set is a sorted array of distinct 64-bit shingle hashes, known by a hash of that array.
Two sets of Jaccard similarity s share at least s times the size of the larger one, so under
any order of all shingles they share one among the first |x| - ceil(s |x|) + 1 of each. The
order is by the number of sets a shingle occurs in: one that occurs in a single set counts for
the prefix but needs no key, and most sets have no key at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .simhash import LANES, block_links, print_radius, set_fingerprint, set_id

#: Shingles dealt out at once by one task (or compared, of several components), and those of one part.
BLOCK_SHINGLES, PART_SHINGLES = 1 << 18, 1 << 21
#: Keeps products that are whole numbers from being taken for the next one.
EPS = 1e-9


def prefix_lengths(sizes: np.ndarray, similarity: float) -> np.ndarray:
    return np.minimum(sizes, sizes - np.ceil(similarity * sizes - EPS).astype(np.int64) + 1)


def exact_check(sets: list[np.ndarray], similarity: float) -> Callable:
    """check(row, others): which of the other sets have at least ``similarity`` with the row's."""
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    starts, (values, flat) = ends - sizes, np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(values), bool)

    def check(row: int, others: np.ndarray) -> np.ndarray:
        own, lengths = sizes[row], sizes[others]
        alike = np.minimum(lengths, own) >= similarity * np.maximum(lengths, own) - EPS
        some, lengths = others[alike], lengths[alike]
        mark[flat[starts[row] : ends[row]]] = True
        if 2 * lengths.sum() > len(flat):  # most of the sets: in place
            sums = np.concatenate(([0], np.cumsum(mark[flat])))
            shared = sums[ends[some]] - sums[starts[some]]
        else:
            until = np.cumsum(lengths)
            places = np.arange(lengths.sum()) + np.repeat(starts[some] - until + lengths, lengths)
            sums = np.concatenate(([0], np.cumsum(mark[flat[places]])))
            shared = sums[until] - sums[until - lengths]
        mark[flat[starts[row] : ends[row]]] = False
        alike[alike] = shared >= similarity * (lengths + own - shared) - EPS
        return alike

    return check


def set_components(sets: list[np.ndarray], similarity: float, groups: np.ndarray | None = None) -> np.ndarray:
    """For each distinct set, a set of its component over all links of at least ``similarity``.

    ``groups``: sorted numbers, of which only sets of the same one are compared; all are one
    group without it. Bit slices of the sets' fingerprints are compared, and each pair within
    the similarity's radius that is not connected yet is checked exactly.
    """
    label, groups = np.arange(len(sets)), np.zeros(len(sets), np.int64) if groups is None else groups
    prints = np.array([set_fingerprint(s) for s in sets]).reshape(len(sets), LANES)
    linked, roots = block_links(groups, prints, print_radius(similarity), exact_check(sets, similarity))
    label[linked] = roots
    return label


def _verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """root, id, shingles, sorted by root: links (set, a set of its component) of at least ``similarity``."""
    root, held, groups, shingles = None, {}, [], 0

    def flush() -> pa.RecordBatch:
        ids = np.fromiter(held, np.int64, len(held))
        label = set_components(list(held.values()), similarity, np.array(groups, np.int64))
        linked = np.flatnonzero(label != np.arange(len(held)))
        return pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[label[linked]])], names=["a", "b"])

    for batch in batches:
        for r, i, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if r != root and shingles > BLOCK_SHINGLES:
                yield flush()
                held, groups, shingles = {}, [], 0
            root = r
            if i not in held:  # an id is in one root only
                held[i] = np.frombuffer(own.as_py(), np.uint64)
                groups.append(r)
                shingles += len(held[i])
    if held:
        yield flush()


def verified_links(sets: DataFrame, similarity: float) -> DataFrame:
    """sets(root, id, shingles): links (a, b) that connect, inside each root, all sets of at least ``similarity``."""
    dealt = sets.select("root", "id", "shingles").repartition("root").sortWithinPartitions("root")
    return dealt.mapInArrow(partial(_verified, similarity=similarity), "a long, b long")


def _dealt(batches: Iterator[pa.RecordBatch], words: int, parts: int, shingle_set) -> Iterator[pa.RecordBatch]:
    """text: for each part of the shingles, blocks of (shingle, place of its set in the block) and the block's sets."""
    def flush(sets: dict) -> pa.RecordBatch:
        ids, sizes = np.fromiter(sets, np.int64, len(sets)), np.array([len(s) for s in sets.values()], np.int64)
        flat, who = np.concatenate(list(sets.values())), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
        part = (flat & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)
        return _blocks("part", part.astype(np.int64), ids, sizes, who, {"shingles": flat})

    held, shingles = {}, 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            own = shingle_set(text, words)
            if len(own) and (i := set_id(own)) not in held:
                held[i] = own
                shingles += len(own)
            if shingles > BLOCK_SHINGLES:
                yield flush(held)
                held, shingles = {}, 0
    if held:
        yield flush(held)


def _blocks(name: str, key: np.ndarray, ids: np.ndarray, sizes: np.ndarray, who: np.ndarray, columns: dict) -> pa.RecordBatch:
    """A row for each value of ``key``: its sets, their sizes, and arrays of its entries as bytes."""
    order = np.argsort(key, kind="stable")
    key, who, columns = key[order], who[order], {c: v[order] for c, v in columns.items()}
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    rows = {name: [], "ids": [], "sizes": [], "who": [], **{c: [] for c in columns}}
    for a, b in zip(at.tolist(), np.append(at[1:], len(key)).tolist(), strict=False):  # without entries, no row
        sets, own = np.unique(who[a:b], return_inverse=True)
        rows[name].append(int(key[a]))
        rows["ids"].append(ids[sets].tobytes())
        rows["sizes"].append(sizes[sets].tobytes())
        rows["who"].append(own.astype(np.int32).tobytes())
        for c, v in columns.items():
            rows[c].append(v[a:b].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(rows[name], pa.int64()), *(pa.array(rows[c], pa.binary()) for c in rows if c != name)], names=list(rows))


def _gathered(batches: Iterator[pa.RecordBatch], kinds: list) -> Iterator[tuple]:
    """Rows of ``_blocks`` sorted by key: (key, ids, sizes, who, columns...) of each, its sets counted once."""
    key, held = None, []

    def flush() -> tuple:
        ids, sizes = (np.concatenate([np.frombuffer(r[c], np.int64) for r in held]) for c in (0, 1))
        first = np.cumsum([0, *(len(r[0]) // 8 for r in held)])
        who = np.concatenate([np.frombuffer(r[2], np.int32) + first[k] for k, r in enumerate(held)])
        ids, once, own = np.unique(ids, return_index=True, return_inverse=True)
        columns = (np.concatenate([np.frombuffer(r[c + 3], kind) for r in held]) for c, kind in enumerate(kinds))
        return key, ids, sizes[once], own[who], *columns

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != key and held:
                yield flush()
                held = []
            key = row[0]
            held.append(row[1:])
    if held:
        yield flush()


def _repeated(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The shingles of a part that occur in several sets, with the number of sets, by buckets of sets."""
    for _, ids, sizes, who, flat in _gathered(batches, [np.uint64]):
        ordered = np.sort(flat)
        several = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(several):
            continue
        place = np.minimum(np.searchsorted(several, flat), len(several) - 1)
        more = several[place] == flat
        code = np.unique(place[more] * len(ids) + who[more])  # copies of a set count once
        place, who = code // len(ids), code % len(ids)
        counts = np.bincount(place, minlength=len(several))[place]
        place, who, counts = place[counts > 1], who[counts > 1], counts[counts > 1]
        yield _blocks("bucket", (ids % buckets)[who], ids, sizes, who, {"shingles": several[place], "counts": counts})


def _prefixes(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """shingle, id, size: the shingles of each set's prefix that occur in other sets too."""
    for _, ids, sizes, who, flat, counts in _gathered(batches, [np.uint64, np.int64]):
        order = np.lexsort((flat, counts, who))
        who, flat = who[order], flat[order]
        repeated = np.bincount(who, minlength=len(ids))
        keep = prefix_lengths(sizes, similarity) - (sizes - repeated)
        inside = np.arange(len(who)) - (np.cumsum(repeated) - repeated)[who] < keep[who]
        who, flat = who[inside], flat[inside]
        for a in range(0, len(who), BLOCK_SHINGLES):
            own = who[a : a + BLOCK_SHINGLES]
            yield pa.RecordBatch.from_arrays([pa.array(flat[a : a + BLOCK_SHINGLES].view(np.int64)), pa.array(ids[own]), pa.array(sizes[own])], names=["shingle", "id", "size"])


def candidate_links(texts: DataFrame, shingles: int, words: int, similarity: float, shingle_set) -> DataFrame:
    """texts(text) with ``shingles`` shingles in all: links (a, b) of sets that connect all of at least ``similarity``.

    Sets that share a shingle of both prefixes are linked in the order of their sizes, each to
    the next one, wherever the sizes allow the similarity: then all pairs between are connected.
    """
    parts = 1 + shingles // PART_SHINGLES
    block = "ids binary, sizes binary, who binary, shingles binary"
    dealt = texts.select("text").mapInArrow(partial(_dealt, words=words, parts=parts, shingle_set=shingle_set), f"part long, {block}")
    repeated = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(partial(_repeated, buckets=parts), f"bucket long, {block}, counts binary")
    keys = repeated.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(partial(_prefixes, similarity=similarity), "shingle long, id long, size long")
    by_size = Window.partitionBy("shingle").orderBy("size", "id")
    pairs = keys.select(F.col("id").alias("a"), F.lag("id").over(by_size).alias("b"), "size", F.lag("size").over(by_size).alias("smaller"))
    return pairs.where(F.col("smaller") >= F.col("size") * similarity - EPS).select("a", "b").distinct()
