"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints become bit planes (bit b of many fingerprints side by side). A comparison
walks over the planes, adds the differing bits of thousands of fingerprint pairs at once
to carry-save counters, and leaves out the blocks in which every pair exceeds the radius.

Two fingerprints within 2 bits agree on at least two of four 16-bit blocks, so all links
are found among fingerprints that share such a pair of blocks (6 keys of 32 bits). Only
distinct fingerprints take part: copies never meet as pairs.

Texts of a given similarity (``similar_documents``) take the same comparison with wider
fingerprints, in blocks that an exact prefix filter makes, and an exact check of each hit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations
from math import acos, comb, pi

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

SEED = 42
#: 64-bit words of a shingle set's fingerprint, and the chance that a link may have of exceeding its radius.
LANES, LOSS = 4, 1e-15
#: Rows of a key beyond which its rows are divided again by the bits outside the key.
HOT_KEY_ROWS = 4096
#: Rows of a key beyond which pivots are compared with the whole key instead of all pairs in turn.
LARGE_GROUP = 256
#: Fingerprints compared at once by one task.
BLOCK_ROWS = 1 << 15
#: Lanes (bytes of eight pairs) in a block that is abandoned as a whole.
LANE_BLOCK = 64
#: Planes beyond which all are added up at once, as wide fingerprints with a large radius seldom let a block go early.
TREE_PLANES = 64


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included; empty without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate(([0], ends[: -words])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)


def shingle_set(text: str | None, words: int = 3) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(text, words))


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits, each set if it is set in over half of the shingle hashes; 0 without words."""
    return majority(shingle_hashes(text, words))


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 256):
        bits = np.unpackbits(hashes[at : at + 255 * 256].view(np.uint8), bitorder="little").reshape(-1, 64)
        for k in range(0, len(bits), 255):  # at most 255 ones fit a byte
            counts += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def set_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """Majority bits of a shingle set, LANES words: of the hashes themselves, then of what they are mixed to."""
    words = [majority(shingles)]
    for k in range(1, LANES):
        mixed = shingles + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        words.append(majority(mixed ^ (mixed >> np.uint64(31))))
    return np.array(words, np.uint64)


@cache
def bit_odds(similarity: float) -> float:
    """The largest chance that a majority bit differs in two sets of at least ``similarity``.

    It falls to arccos(2 s / (1 + s)) / pi as sets grow, so small ones (up to 24 shared) are tried.
    """
    def sums(n: int) -> np.ndarray:
        return np.array([comb(n, k) for k in range(n + 1)]) / 2.0**n

    found = acos(min(1.0, 2 * similarity / (1 + similarity))) / pi
    for shared in range(1, 25):
        for both in range(1, int(shared / similarity - shared + 1e-9) + 1):
            for a in range(both // 2 + 1):  # shingles of one set only, and of the other
                b, ones = both - a, np.arange(shared + 1)
                over_a, over_b = (
                    np.array([sums(own)[2 * (k + np.arange(own + 1)) > shared + own].sum() for k in ones]) for own in (a, b)
                )
                found = max(found, float((sums(shared) * (over_a * (1 - over_b) + over_b * (1 - over_a))).sum()))
    return found


@cache
def print_radius(similarity: float) -> int:
    """Differing bits of set fingerprints that two sets of at least ``similarity`` exceed with a chance of at most LOSS."""
    bits, odds, beyond = 64 * LANES, bit_odds(similarity), 0.0
    for radius in range(bits, 0, -1):  # beyond: the chance of more than radius - 1 differing bits
        beyond += comb(bits, radius) * odds**radius * (1 - odds) ** (bits - radius)
        if beyond > LOSS:
            return radius
    return 0


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def _exceeding(planes: np.ndarray, radius: int) -> np.ndarray:
    """Lanes of pairs that differ in more than ``radius`` of the planes: a tree of carry-save adders over all planes at once."""
    over, equal, sums = np.zeros(planes.shape[1], np.uint8), np.full(planes.shape[1], 255, np.uint8), []
    while len(planes):
        carries = []
        while len(planes) > 2:
            k = len(planes) // 3
            a, b, c = planes[:k], planes[k : 2 * k], planes[2 * k : 3 * k]
            half = a ^ b
            carries.append(a & b | half & c)
            planes = np.concatenate((half ^ c, planes[3 * k :]))
        if len(planes) == 2:
            carries.append(planes[:1] & planes[1:])
            planes = planes[:1] ^ planes[1:]
        sums.append(planes[0])
        planes = np.concatenate(carries) if carries else planes[:0]
    for k in range(max(len(sums), radius.bit_length()) - 1, -1, -1):
        digit = sums[k] if k < len(sums) else np.zeros_like(over)
        if radius >> k & 1:
            equal &= digit
        else:
            over |= equal & digit
            equal &= ~digit
    return over


class BitPlanes:
    """Bit planes of an array of fingerprints, with copies moved by 0 to 7 lanes."""

    def __init__(self, prints: np.ndarray):
        bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), bitorder="little").reshape(len(prints), 8 * prints.itemsize * (prints.shape[1] if prints.ndim == 2 else 1))
        varying = np.flatnonzero(bits.min(axis=0) != bits.max(axis=0))
        self.n, self.planes = len(prints), []
        columns = np.ascontiguousarray(bits[:, varying].T)
        for move in range(8):
            moved = np.zeros((len(varying), len(prints) + 72), np.uint8)
            moved[:, : max(0, self.n - move)] = columns[:, move:]
            self.planes.append(np.packbits(moved, axis=1, bitorder="little"))

    def within(self, shift: int, radius: int) -> np.ndarray:
        """The rows i for which row i + shift differs in at most ``radius`` bits."""
        if self.n <= shift:
            return np.empty(0, np.int64)
        return self._near(self.planes[0], self.planes[shift % 8][:, shift // 8 :], self.n - shift, radius)

    def near(self, row: int, radius: int) -> np.ndarray:
        """All rows that differ from ``row`` in at most ``radius`` bits, itself included."""
        own = self.planes[0][:, row // 8] >> (row % 8) & 1
        return self._near(self.planes[0], np.broadcast_to((own * np.uint8(255))[:, None], self.planes[0].shape), self.n, radius)

    @staticmethod
    def _near(left: np.ndarray, right: np.ndarray, n: int, radius: int) -> np.ndarray:
        lanes = (n + 7) // 8
        if len(left) > TREE_PLANES:
            rows = np.flatnonzero(np.unpackbits(~_exceeding(left[:, :lanes] ^ right[:, :lanes], radius), bitorder="little"))
            return rows[rows < n]
        width = (radius + 1).bit_length()
        bias = (1 << width) - (radius + 1)  # the counters overflow just beyond the radius
        live = None
        counters = [np.full(lanes, 255 if bias >> k & 1 else 0, np.uint8) for k in range(width)]
        over = np.zeros(lanes, np.uint8)
        for b in range(len(left)):
            if live is None:
                carry = left[b, :lanes] ^ right[b, :lanes]
            else:
                carry = left[b, live] ^ right[b, live]
            for k in range(width):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            if b % 8 == 7 and len(over) > LANE_BLOCK:
                edges = np.arange(0, len(over), LANE_BLOCK)
                alive = np.bitwise_and.reduceat(over, edges) != 255
                if not alive.any():
                    return np.empty(0, np.int64)
                if alive.mean() < 0.7:
                    keep = np.repeat(alive, LANE_BLOCK)[: len(over)]
                    live = np.flatnonzero(keep) if live is None else live[keep]
                    over, counters = over[keep], [c[keep] for c in counters]
        near = np.unpackbits(~over, bitorder="little").reshape(-1, 8)
        lane, bit = np.nonzero(near)
        rows = (lane if live is None else live[lane]) * 8 + bit
        return rows[rows < n]


def group_roots(prints: np.ndarray, radius: int, check: Callable | None = None) -> np.ndarray:
    """The first row of each row's component, over all links of one large group.

    ``check(row, others)``: which of the others, all within the radius, are links indeed.

    A pivot is compared with all rows at once. Rows of the largest component need no pivot:
    their links inside it change nothing, and all rows outside of it are pivots themselves.
    """
    planes, label, done = BitPlanes(prints), np.arange(len(prints)), np.zeros(len(prints), bool)
    while True:
        sizes = np.bincount(label, minlength=len(prints))
        largest = int(sizes.argmax())
        left = np.flatnonzero(~done & ((label != largest) | (sizes[largest] == 1)))
        if not len(left):
            return label
        pivot = int(left[0])
        done[pivot] = True
        near = planes.near(pivot, radius)
        near = near[label[near] != label[pivot]]
        if check is not None and len(near):
            near = near[check(pivot, near)]
        joined = np.unique(label[np.append(near, pivot)])
        if len(joined) > 1:
            member = np.zeros(len(prints), bool)
            member[joined] = True
            label[member[label]] = joined[0]


def block_links(keys: np.ndarray, prints: np.ndarray, radius: int, check: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, root of its local component) among rows of equal keys; rows sorted by key.

    ``prints``: one number, or a line of numbers, for each row. ``check(row, others)``: which of
    the others, all within the radius, are links indeed; without it, all are.
    """
    order, n = np.arange(len(keys)), len(keys)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if n else order
    sizes = np.diff(np.append(starts, n))
    left = np.repeat(starts + sizes, sizes) - order  # rows from here to the end of the group
    parent = np.arange(n)
    for start, size in zip(starts[sizes > LARGE_GROUP].tolist(), sizes[sizes > LARGE_GROUP].tolist(), strict=True):
        inside = None if check is None else lambda i, others, start=start: check(i + start, others + start)
        parent[start : start + size] = group_roots(prints[start : start + size], radius, inside) + start
    rows = order[np.repeat((sizes > 1) & (sizes <= LARGE_GROUP), sizes)]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    shift, planes, reach = 1, None, None
    while len(rows):
        if planes is None:
            planes, reach = BitPlanes(prints[rows]), left[rows]
        hits = planes.within(shift, radius)
        hits = hits[reach[hits] > shift]
        for i, j in zip(rows[hits].tolist(), rows[hits + shift].tolist(), strict=True):
            a, b = find(i), find(j)
            if a != b and (check is None or check(i, np.array([j]))[0]):
                parent[max(a, b)] = min(a, b)
        shift += 1
        going = np.repeat(sizes, sizes)[rows] > shift
        if not going.any():
            break
        if going.mean() < 0.8:
            rows, planes = rows[going], None
    roots = np.array([find(x) for x in range(n)], np.int64) if n else order
    linked = np.flatnonzero(roots != np.arange(n))
    return linked, roots[linked]


def _links(batches: Iterator[pd.DataFrame], radius: int, key: list[str], name: str, lanes: list[str]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by ``key``; whole keys are gathered into blocks of about BLOCK_ROWS rows."""
    held: list[pd.DataFrame] = []
    rows = 0

    def flush(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf[key].to_numpy()
        ids = np.cumsum(np.concatenate(([0], (keys[1:] != keys[:-1]).any(axis=1)))) if len(pdf) else np.empty(0)
        prints = np.ascontiguousarray(pdf[lanes].to_numpy()).view(np.uint64)
        a, b = block_links(ids, prints, radius)
        names = pdf[name].to_numpy()
        return pd.DataFrame({"a": names[a], "b": names[b]})

    for pdf in batches:
        held.append(pdf)
        rows += len(pdf)
        if rows < BLOCK_ROWS:
            continue
        block = pd.concat(held, ignore_index=True)
        last = (block[key] == block[key].iloc[-1]).all(axis=1)
        if not last.all():
            yield flush(block[~last])
            block = block[last]
        held, rows = [block], len(block)
    if held:
        yield flush(pd.concat(held, ignore_index=True))


def fingerprint_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """prints: distinct ``fp``. Links (a, b), enough to connect all within ``radius`` (at most 2)."""
    if not 0 <= radius <= 2:
        raise ValueError("four blocks find links of up to 2 differing bits")
    block = [F.shiftrightunsigned(F.col("fp"), 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    pairs = [
        F.shiftleft(F.lit(k).cast("long"), 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j])
        for k, (i, j) in enumerate(combinations(range(4), 2))
    ]
    keyed = prints.select("fp", F.explode(F.array(*pairs)).alias("k1"))
    counts = keyed.groupBy("k1").agg(F.count("*").alias("n")).where("n > 1")
    counted = keyed.join(counts, "k1")
    # In a hot key, 32 bits are left: two fingerprints agree on at least one of three parts of them.
    other = F.array(*[
        F.shiftleft(block[i], 16).bitwiseOR(block[j]) for i, j in [(2, 3), (1, 3), (1, 2), (0, 3), (0, 2), (0, 1)]
    ])[F.shiftright(F.col("k1"), 32).cast("int")]
    parts = F.array(
        other.bitwiseAND(0x7FF),
        F.shiftrightunsigned(other, 11).bitwiseAND(0x7FF).bitwiseOR(1 << 12),
        F.shiftrightunsigned(other, 22).bitwiseAND(0x3FF).bitwiseOR(2 << 12),
    )
    dealt = counted.select(
        "k1", F.explode(F.when(F.col("n") > HOT_KEY_ROWS, parts).otherwise(F.array(F.lit(-1).cast("long")))).alias("k2"), "fp"
    )
    sorted_rows = dealt.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "fp")
    return sorted_rows.mapInPandas(lambda it: _links(it, radius, ["k1", "k2"], "fp", ["fp"]), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of ``docs(doc_id, text)``.

    A null or wordless text has fingerprint zero and is linked like any other. Repeated
    rows each get their row. component_id is the smallest doc_id reachable over links
    (null ids don't count). An empty table gives no rows; other columns are ignored.
    """
    common.prepare(docs.sparkSession)
    prints, _ = common.staged(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long"), "prints"
    )
    classes, classes_path = common.staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    links, links_path = common.staged(fingerprint_links(classes.select("fp"), radius), "links")
    roots = connected_components(links)  # node, root
    linked = roots.join(classes.withColumnRenamed("fp", "node"), "node")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    in_component, _ = common.staged(
        roots.join(least, "root").select(F.col("node").alias("fp"), "component_id"), "members"
    )
    alone = classes.join(in_component, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    all_classes, _ = common.staged(in_component.unionByName(alone), "components")
    common.drop_path(docs.sparkSession, links_path)
    common.drop_path(docs.sparkSession, classes_path)
    return prints.join(all_classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def set_id(shingles: np.ndarray) -> int:
    """The number a set is known by, as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), 42)).view(np.int64))


def _set_ids(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
        ids, sizes = pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), ids, sizes], names=["doc_id", "id", "size"])


def _set_rows(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """root, id, text: the shingles of the rows whose text is the one the id stands for."""
    for batch in batches:
        sets = [shingle_set(t, words) for t in batch.column(2).to_pylist()]
        own = pa.array([set_id(s) == i for s, i in zip(sets, batch.column(1).to_pylist(), strict=True)], pa.bool_())
        shingles = pa.array([s.tobytes() for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), shingles], names=["root", "id", "shingles"]).filter(own)


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id of docs(doc_id, text): components of texts whose shingles are similar.

    Two texts are linked if their fingerprints (256 bits of the shingle sets) are within the
    similarity's radius and the exact Jaccard similarity of the sets is at least ``similarity``.
    No keys of such wide fingerprints find all links, so a prefix filter over shingles, which
    loses none whatever the table's size, says which are compared; bit slices compare them.
    Null and wordless texts are one class; repeated rows each get their row; an empty table
    gives no rows.
    """
    from .jaccard import candidate_links  # which compares by this module's planes

    common.prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints, _ = common.staged(texts.mapInArrow(lambda it: _set_ids(it, words), "doc_id long, id long, size long"), "sets")
    classes, classes_path = common.staged(prints.groupBy("id").agg(F.min("doc_id").alias("least")), "classes")
    shingles = prints.agg(F.sum("size")).first()[0] or 0
    near, near_path = common.staged(candidate_links(texts, shingles, words, similarity, shingle_set), "candidates")
    found, _ = common.staged(_components(texts, classes, near, words, similarity), "components")
    common.drop_path(docs.sparkSession, near_path)
    common.drop_path(docs.sparkSession, classes_path)
    return prints.join(found, "id").select("doc_id", "component_id")


def _components(texts: DataFrame, classes: DataFrame, near: DataFrame, words: int, similarity: float) -> DataFrame:
    """id, component_id of classes(id, least): components of the exact links inside the components of near(a, b)."""
    from .jaccard import verified_links

    spark = texts.sparkSession
    roots = connected_components(near)
    members, members_path = common.staged(roots.join(classes.withColumnRenamed("id", "node"), "node"), "members")
    some = common.small(members.select("root", F.col("node").alias("id"), "least"), members.count(), 60)
    sets = texts.join(some, F.col("doc_id").eqNullSafe(F.col("least"))).select("root", "id", "text")
    sets = sets.mapInArrow(lambda it: _set_rows(it, words), "root long, id long, shingles binary")
    links, links_path = common.staged(verified_links(sets, similarity), "links")
    common.drop_path(spark, members_path)
    both = links.unionByName(links.select(F.col("b").alias("a"), "b")).distinct().withColumnRenamed("a", "id")  # b: one set of each component
    least = both.join(classes, "id").groupBy("b").agg(F.min("least").alias("component_id"))
    joined, _ = common.staged(both.join(least, "b").select("id", "component_id"), "joined")
    common.drop_path(spark, links_path)
    return classes.join(joined, "id", "left").select("id", F.coalesce("component_id", "least").alias("component_id"))
