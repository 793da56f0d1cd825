"""Benchmark decontamination by greedy string tiling.

Documents and items are joined on shared five-word seeds: Karp-Rabin hashes of five words
that follow one another, on both sides. Each pair is tiled: the longest common run of words
that is not yet marked becomes a tile and is marked on both sides, over and over, until no
run of five words is left; runs are found by running Karp-Rabin hashes and then compared
word by word. The share of an item's words under tiles decides, so an item whose passages
come in another order is still caught.

The documents are read once. A filter of fixed size, made of the items' seeds, lets few
other seeds of a document pass; these (place and hash) are all that is kept of it. Words
are known by 64-bit hashes.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bits of the filter of seeds, a fixed size; each seed sets two.
FILTER_BITS = 24
#: Hashes of words that a task remembers.
REMEMBERED = 1 << 20
TILES = "array<struct<item_start: int, doc_start: int, length: int>>"
RESULT = f"doc_id long, item_id long, coverage double, n_tiles int, tiles {TILES}"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found

    def of(self, tokens: list[str]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def running_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash (modulo 2**64) of each run of ``length`` ids."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    values = ids.astype(np.uint64) + np.uint64(1)
    if length <= 8:
        out = np.zeros(n, np.uint64)
        for j in range(length):
            out = out * BASE + values[j : j + n]
        return out
    powers, inverse = np.full(len(ids), BASE, np.uint64), np.full(len(ids), INVERSE, np.uint64)
    powers[0] = inverse[0] = 1
    np.multiply.accumulate(powers, out=powers)
    np.multiply.accumulate(inverse, out=inverse)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers)))
    # Divided by the power of its start, the sum over a run depends on the run alone.
    return (sums[length:] - sums[:-length]) * inverse[:n]


def seeds(ids: np.ndarray, least: int) -> np.ndarray:
    """Hash of each seed; a text of fewer than ``least`` words is one seed of its own kind."""
    if 0 < len(ids) < least:
        return running_hashes(ids, len(ids)) ^ np.uint64(len(ids))
    return running_hashes(ids, least)


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (item start, doc start, length), longest first; of equal ones the first in the item, then in the document.

    Negative ids in ``doc`` match nothing. Pairs of equal runs are never listed: each start in
    the item takes the first place in the document that is still free.
    """
    free_doc, free_item = doc >= 0, np.ones(len(item), bool)

    def open_runs(ids: np.ndarray, free: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        if len(ids) < length:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        taken = np.concatenate(([0], np.cumsum(~free)))
        at = np.flatnonzero(taken[length:] == taken[:-length])
        return at, running_hashes(np.maximum(ids, 0), length)[at]

    def common_run(length: int) -> bool:
        return bool(np.isin(open_runs(item, free_item, length)[1], open_runs(doc, free_doc, length)[1]).any())

    tiles: list[tuple[int, int, int]] = []
    longest = min(len(item), len(doc))
    while longest >= least:
        low, high = least - 1, longest  # a run of ``low`` words exists or is too short to count
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common_run(middle) else (low, middle - 1)
        if low < least:
            break
        at_item, h_item = open_runs(item, free_item, low)
        at_doc, h_doc = open_runs(doc, free_doc, low)
        order = np.argsort(h_doc, kind="stable")
        places, hashes = at_doc[order].tolist(), h_doc[order].tolist()
        passed: dict[int, int] = {}  # for each hash: places before it are taken for good
        for i, h in zip(at_item.tolist(), h_item.tolist(), strict=True):
            if not free_item[i : i + low].all():
                continue
            k, end = passed.get(h, bisect_left(hashes, h)), bisect_right(hashes, h)
            while k < end and not free_doc[places[k] : places[k] + low].all():
                k += 1
            passed[h] = k
            later = (places[j] for j in range(k, end))
            same = (d for d in later if free_doc[d : d + low].all() and (item[i : i + low] == doc[d : d + low]).all())  # hashes may collide
            if (d := next(same, None)) is not None:
                free_item[i : i + low], free_doc[d : d + low] = False, False
                tiles.append((i, d, low))
        longest = low - 1  # whatever run of this length is left overlaps a tile
    return tiles


def tiles_of(at: np.ndarray, hashes: np.ndarray, item: np.ndarray, least: int, threshold: float) -> tuple[float, list[tuple[int, int, int]]] | None:
    """(coverage, tiles) of an item in a document, of which places and hashes of seeds are given; None below the threshold."""
    own = seeds(item, least)
    if len(item) < least:
        return (1.0, [(0, 0, len(item))]) if own[0] in hashes else None
    order = np.argsort(own, kind="stable")
    found = np.minimum(np.searchsorted(own[order], hashes), len(own) - 1)
    hit = own[order][found] == hashes
    spread = np.arange(least)
    matched = np.isin(own, hashes[hit])
    if len(np.unique((np.flatnonzero(matched)[:, None] + spread).ravel())) < threshold * len(item) - 1e-9:
        return None  # tiles can't cover more than the seeds do
    _, ids = np.unique(item, return_inverse=True)
    spots = (at[hit][:, None] + spread).ravel()
    there, first = np.unique(spots, return_index=True)
    known = ids[(order[found[hit]][:, None] + spread).ravel()][first]  # the words of the document, as the item has them
    gaps = np.flatnonzero(np.diff(there) > 1) + 1
    back = np.insert(there, gaps, -1)
    tiles = tile(np.insert(known, gaps, -1), ids, least)
    coverage = sum(t[2] for t in tiles) / len(item)
    return (coverage, [(i, int(back[d]), n) for i, d, n in tiles]) if coverage >= threshold - 1e-9 else None


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        lists = [known.of(words(t)).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["item_id", "words"])


def _item_seeds(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """item, words: a row for each seed of an item, with the number of its places."""
    for batch in batches:
        items, lengths, hashes, places = [], [], [], []
        for item, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own, counts = np.unique(seeds(np.array(ids, np.int64).view(np.uint64), least), return_counts=True)
            items.append(np.full(len(own), item))
            lengths.append(np.full(len(own), len(ids)))
            hashes.append(own.view(np.int64))
            places.append(counts)
        if items:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (items, lengths, hashes, places)], names=["item", "n", "hash", "places"])


def _positions(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a seed in the filter."""
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return hashes & mask, (hashes >> np.uint64(FILTER_BITS)) & mask


def _passed(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = np.arange(len(hashes))
    for position in _positions(hashes):
        at = at[(bits[position[at] >> np.uint64(6)] >> (position[at] & np.uint64(63)) & np.uint64(1)).astype(bool)]
    return at


def seed_filter(hashes: DataFrame) -> np.ndarray:
    """Bits that are set for each of hashes(hash); what reaches the driver has a fixed size."""
    mask = (1 << FILTER_BITS) - 1
    bit = F.explode(F.array(F.col("hash").bitwiseAND(mask), F.shiftrightunsigned("hash", FILTER_BITS).bitwiseAND(mask))).alias("bit")
    one = F.expr("shiftleft(1L, cast(bit & 63 AS int))")
    parts = hashes.select(bit).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(one).alias("part")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[parts["at"].to_numpy(np.int64)] = parts["part"].to_numpy(np.int64).view(np.uint64)
    return out


def _doc_rows(batches: Iterator[pa.RecordBatch], least: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """doc_id, text: places and hashes of the seeds that pass the filter, for documents that have any."""
    known = WordHashes()
    for batch in batches:
        rows, places, hashes = [], [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            own = seeds(known.of(words(text)), least)
            at = _passed(own, bits)
            if len(at):
                rows.append(row)
                places.append(at.astype(np.int32))
                hashes.append(own[at].view(np.int64))
        columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "at", "hashes"])


def _tiled(batches: Iterator[pa.RecordBatch], least: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """doc_id, at, hashes, item_id, words: the pairs that reach the threshold, with their tiles."""
    kind = pa.list_(pa.struct([pa.field(n, pa.int32()) for n in ("item_start", "doc_start", "length")]))
    for batch in batches:
        rows, coverage, tiles = [], [], []
        for row, (at, hashes, item) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 4)), strict=True)):
            found = tiles_of(np.array(at, np.int64), np.array(hashes, np.int64).view(np.uint64), np.array(item, np.int64).view(np.uint64), least, threshold)
            if found:
                rows.append(row)
                coverage.append(found[0])
                tiles.append([dict(zip(("item_start", "doc_start", "length"), t, strict=True)) for t in found[1]])
        index = pa.array(rows, pa.int64())
        columns = [batch.column(0).take(index), batch.column(3).take(index), pa.array(coverage, pa.float64()), pa.array([len(t) for t in tiles], pa.int32()), pa.array(tiles, kind)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "coverage", "n_tiles", "tiles"])


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs of documents and the benchmark items they contain: doc_id, item_id, coverage, n_tiles, tiles.

    docs(doc_id, text) against benchmark(item_id, text). Words are runs of letters, digits and
    underscores in lower case; tiles have ``least`` words or more; coverage is the share of the
    item's words under tiles. An item of fewer than ``least`` words is found only in a document
    that consists of just these words; one without words is never found. Items without id or
    text are left out, and repeated ones count once. A null text has no words. Repeated
    document rows each give their rows; without documents, or without items, there are none.
    Places count words from 0.

    An item is covered to the threshold only if enough of its seeds are shared; so its most
    frequent seeds, up to one fewer than that, need not find candidates, and a seed that many
    items share links nothing unless an item has hardly another. Joins go by size; hot keys are
    split from the others.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    given = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    numbered = given.mapInArrow(_item_rows, "item_id long, words array<long>").where(F.size("words") > 0).withColumn("item", F.monotonically_increasing_id())
    items, _ = common.staged(numbered, "items")
    n_items, n_words = items.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    if not n_items:
        return spark.createDataFrame([], RESULT)
    found, _ = common.staged(items.select("item", "words").mapInArrow(lambda it: _item_seeds(it, least), "item long, n long, hash long, places long"), "seeds")
    # An item's rarest seeds, until those left are too few to cover it.
    needed = F.greatest(F.lit(1), F.ceil((F.col("n") * threshold - 1e-9) / least))
    rarity = found.join(found.groupBy("hash").agg(F.count("*").alias("items")), "hash")
    before = Window.partitionBy("item").orderBy("items", "hash").rowsBetween(Window.unboundedPreceding, -1)
    rarest = rarity.withColumn("before", F.coalesce(F.sum("places").over(before), F.lit(0)))
    rarest = rarest.where((F.col("n") < least) | (F.col("before") <= F.col("n") - least + 1 - needed)).select("hash", "item")
    rarest, _ = common.staged(rarest, "rarest")

    bits = seed_filter(found)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _doc_rows(it, least, bits), "doc_id long, at array<int>, hashes array<long>")
    hits, _ = common.staged(rows.withColumn("row", F.monotonically_increasing_id()), "hits")
    each = hits.select("row", F.explode("hashes").alias("hash"))
    pairs = common.keyed_join(each, rarest, rarest.count(), 40, ["hash"]).select("row", "item").distinct()
    pairs, _ = common.staged(pairs, "pairs")
    n_rows, n_places = hits.agg(F.count("*"), F.coalesce(F.sum(F.size("at")), F.lit(0))).first()
    with_doc = pairs.join(common.small(hits, 4 * n_rows + n_places, 16), "row")
    with_item = common.keyed_join(with_doc, items, 6 * n_items + n_words, 10, ["item"])
    return with_item.select("doc_id", "at", "hashes", "item_id", "words").mapInArrow(lambda it: _tiled(it, least, threshold), RESULT)
