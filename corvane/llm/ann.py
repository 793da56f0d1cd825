"""Approximate nearest neighbours: a forest of random-projection trees.

Trees are fitted on a bounded sample; every row of the table is routed to its leaf in each
tree. Leaves that hold many rows of the whole table are split again, by further bounded
samples of their own rows, so leaves grow in number and not in size. A query walks all trees
at once through one priority queue, ordered by the sum of squared distances to the borders
that it would cross, until it has visited its number of leaves. The rows of the visited leaves
are reranked exactly, leaf by leaf, and the best of all leaves are kept.

Rows of equal vectors form one class that carries its smallest ids, as many as a result can
use, so copies neither crowd a leaf nor lose their place in a result.
"""

from __future__ import annotations

import heapq
import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LOG = logging.getLogger(__name__)
#: Classes of a leaf beyond which it is split again; what a few rounds leave larger is divided, with its queries sent to each part.
LEAF_PART, REFINEMENTS = 2048, 4


@dataclass
class Tree:
    """Inner nodes: normal and threshold; children that are negative are leaves (-1 - leaf)."""

    normals: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray  # (nodes, 2)
    leaves: int

    def graft(self, leaf: int, sub: Tree) -> None:
        """Puts a tree in the place of a leaf; its first leaf takes the leaf's number, the others new ones."""
        first, number = len(self.normals), lambda x: np.where(x == 0, leaf, x + self.leaves - 1)
        below = np.where(sub.children < 0, -1 - number(-1 - sub.children), sub.children + first)
        if first:
            self.children = np.where(self.children == -1 - leaf, first, self.children)
        self.normals = np.concatenate((self.normals.reshape(-1, sub.normals.shape[1]), sub.normals))
        self.thresholds = np.concatenate((self.thresholds, sub.thresholds))
        self.children = np.concatenate((self.children, below))
        self.leaves += sub.leaves - 1


def grow(points: np.ndarray, leaf_size: int, rng: np.random.Generator) -> Tree:
    """Splits by the direction between two random points, at the median."""
    normals, thresholds, children, leaves = [], [], [], 0
    stack = [(np.arange(len(points)), -1, 0)]
    while stack:
        own, parent, side = stack.pop()
        split = None
        if len(own) > leaf_size:
            for _ in range(5):
                a, b = rng.choice(own, 2, replace=False)
                normal = points[a] - points[b]
                norm = np.linalg.norm(normal)
                if norm < 1e-9:
                    continue
                values = points[own] @ (normal / norm)
                middle = float(np.median(values))
                if (values < middle).any() and (values >= middle).any():
                    split = (normal / norm, middle, values < middle)
                    break
        if split is None:
            number, leaves = -1 - leaves, leaves + 1
        else:
            number = len(normals)
            normals.append(split[0])
            thresholds.append(split[1])
            children.append([0, 0])
            stack += [(own[split[2]], number, 0), (own[~split[2]], number, 1)]
        if parent >= 0:
            children[parent][side] = number
    d = points.shape[1] if points.ndim == 2 else 0
    return Tree(np.array(normals).reshape(-1, d), np.array(thresholds), np.array(children, np.int64).reshape(-1, 2), leaves)


@dataclass
class Forest:
    trees: list[Tree]
    visits: int = 0  # leaves that a query visits

    @property
    def offsets(self) -> list[int]:
        """The number of each tree's first leaf."""
        return np.concatenate(([0], np.cumsum([t.leaves for t in self.trees]))).astype(int).tolist()

    def route(self, points: np.ndarray) -> np.ndarray:
        """Leaf of each point in each tree: (points, trees)."""
        out = np.empty((len(points), len(self.trees)), np.int64)
        for k, (tree, offset) in enumerate(zip(self.trees, self.offsets, strict=False)):
            node = np.full(len(points), 0 if len(tree.normals) else -1, np.int64)
            while (inner := np.flatnonzero(node >= 0)).size:
                at = node[inner]
                right = np.einsum("ij,ij->i", points[inner], tree.normals[at]) >= tree.thresholds[at]
                node[inner] = tree.children[at, right.astype(int)]
            out[:, k] = -1 - node + offset
        return out

    def search(self, points: np.ndarray, visits: int | None = None) -> list[list[int]]:
        """The leaves that each query visits, best first."""
        visits, found = visits or self.visits, []
        margins = [points @ t.normals.T - t.thresholds if len(t.normals) else np.empty((len(points), 0)) for t in self.trees]
        offsets = self.offsets
        for q in range(len(points)):
            queue = [(0.0, k, 0 if len(t.normals) else -1) for k, t in enumerate(self.trees)]
            heapq.heapify(queue)
            own: list[int] = []
            while queue and len(own) < visits:
                priority, k, node = heapq.heappop(queue)
                if node < 0:
                    own.append(-1 - node + offsets[k])
                    continue
                margin = float(margins[k][q, node])
                left, right = self.trees[k].children[node].tolist()
                near, far = (right, left) if margin >= 0 else (left, right)
                heapq.heappush(queue, (priority, k, near))
                heapq.heappush(queue, (priority + margin * margin, k, far))
            found.append(own)
        return found

    def calibrate(self, points: np.ndarray, nearest: int, target: float, queries: int, rng: np.random.Generator) -> tuple[float, float]:
        """Sets ``visits`` to the fewest (in steps) with which sample queries reach the target recall over the sample.

        Returns that recall and the share of the sample that such a query is compared with.
        """
        picked = rng.choice(len(points), min(queries, len(points)), replace=False)
        cosines = points[picked] @ points.T
        cosines[np.arange(len(picked)), picked] = -np.inf
        wanted = min(nearest, len(points) - 1)
        truth = np.argpartition(-cosines, max(0, wanted - 1), axis=1)[:, :wanted]
        leaves, total, recall = self.route(points), self.offsets[-1], 1.0
        for share in (0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.8, 1.0, 1.5, 2, 4, 8, len(self.trees)):  # of one tree's leaves
            self.visits = min(total, max(len(self.trees), int(np.ceil(total * share / len(self.trees)))))
            hit, seen = 0, 0
            for row, visited in zip(truth, self.search(points[picked]), strict=True):
                chosen = np.zeros(total, bool)
                chosen[visited] = True
                compared = chosen[leaves].any(axis=1)
                hit += compared[row].sum()
                seen += compared.mean() / len(picked)
            recall = hit / max(1, truth.size)
            if recall >= target:
                break
        return recall, seen

    def refine(self, points: np.ndarray, sizes: dict[int, int], limit: int, rng: np.random.Generator) -> None:
        """Splits leaves of more than ``limit`` rows (by ``sizes``) as far as the points that fall into them allow."""
        leaves, offsets = self.route(points), self.offsets
        for k, tree in enumerate(self.trees):
            for leaf in [x for x in range(tree.leaves) if sizes.get(x + offsets[k], 0) > limit]:
                own = points[leaves[:, k] == leaf + offsets[k]]
                sub = grow(own, max(2, int(len(own) * limit / sizes[leaf + offsets[k]])), rng) if len(own) > 3 else None
                if sub is not None and sub.leaves > 1:
                    tree.graft(leaf, sub)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """Distinct (vec_id, embedding) that take part: ids not null, vectors finite, not zero, and of the usual length.

    A repeated id takes its smallest vector. The usual length is the most frequent one. Single
    precision stays as it is; all else becomes double.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    v = F.col("embedding").cast(kind if kind == "array<float>" else "array<double>")
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    usual = valid.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    valid = valid.join(F.broadcast(usual), F.size("embedding") == F.col("n")).select("vec_id", "embedding")
    return valid.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _normalised(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # squares must not overflow
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _leaf_sizes(classes: DataFrame, forest: Forest) -> DataFrame:
    """leaf, count of classes(ids, embedding) over all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = forest.route(_normalised(_matrix(batch.column(1)))).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(leaves)], names=["leaf"])

    return classes.mapInArrow(run, "leaf long").groupBy("leaf").count()


def _routed(batches: Iterator[pa.RecordBatch], forest: Forest, parts: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """ids, embedding: a row for each tree."""
    for batch in batches:
        if not batch.num_rows:
            continue
        leaves = forest.route(_normalised(_matrix(batch.column(1))))
        at = np.repeat(np.arange(batch.num_rows), leaves.shape[1])
        flat = leaves.ravel()
        spread = (at * 2654435761 % (1 << 32)) % np.array([parts.get(x, 1) for x in flat.tolist()], np.int64)
        index = pa.array(at)
        yield pa.RecordBatch.from_arrays(
            [pa.array(flat), pa.array(spread), batch.column(0).take(index), batch.column(1).take(index)], names=["leaf", "part", "ids", "embedding"]
        )


def _visited(batches: Iterator[pa.RecordBatch], forest: Forest, parts: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """query_id, embedding: a row for each visited leaf and part of it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [(i, leaf, p) for i, own in enumerate(forest.search(_normalised(_matrix(batch.column(1))))) for leaf in own for p in range(parts.get(leaf, 1))]
        at, leaf, part = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([leaf, part, batch.column(0).take(at), batch.column(1).take(at)], names=["leaf", "part", "query_id", "embedding"])


def _reranked(rows: pd.DataFrame, queries: pd.DataFrame, nearest: int) -> pd.DataFrame:
    """The best classes of one leaf for each of its queries; one more than asked, as a query's own class may be among them."""
    if not len(rows) or not len(queries):
        return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "ids": pd.Series([], dtype=object), "score": pd.Series([], dtype="float64")})
    x, q = np.stack(rows["embedding"]).astype(np.float64), np.stack(queries["embedding"]).astype(np.float64)
    ux, uq, k, ids = _normalised(x), _normalised(q), min(nearest + 1, len(rows)), rows["ids"].to_numpy()
    least = np.array([i[0] for i in ids])
    out = []
    for at in range(0, len(q), 256):
        cosines = uq[at : at + 256] @ ux.T
        bound = -np.partition(-cosines, k - 1, axis=1)[:, k - 1]
        for j, row in enumerate(cosines):
            near = np.flatnonzero(row >= bound[j] - 1e-12)  # ties with the last one stay for the exact order
            score = (uq[at + j] * ux[near]).sum(axis=1)
            best = np.lexsort((least[near], -score))[:k]
            out.append((queries["query_id"].iat[at + j], ids[near[best]], score[best]))
    return pd.DataFrame(
        {"query_id": np.repeat([o[0] for o in out], [len(o[1]) for o in out]), "ids": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])}
    )


def nearest_neighbours(
    vectors: DataFrame, is_query, nearest: int = 5, trees: int = 16, sample_rows: int = 20_000, leaf_rows: int = 128,
    recall_target: float = 0.95, calibration_queries: int = 200, seed: int = 7,
) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows found of each row for which ``is_query`` holds.

    vectors(vec_id, embedding); score is the cosine in double precision. Queries and candidates
    are the rows that take part (see unit_vectors); a query is no candidate of its own. Ties go
    to the smaller vec_id. A table without rows that take part gives none. The forest is fitted
    on about ``sample_rows`` rows chosen by a hash of the id, and refined on as many again in
    each round; leaves visited are the fewest that reach ``recall_target`` on the sample. That
    recall and the share of rows compared are logged.
    """
    spark = vectors.sparkSession
    valid, _ = common.staged(unit_vectors(vectors), "vectors")
    total = valid.count()
    rng = np.random.default_rng(seed)
    draw = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    sample = valid.where(draw <= sample_rows / max(1, total)).orderBy("vec_id").toPandas()
    if not len(sample):  # a handful of rows
        sample = valid.orderBy("vec_id").limit(1000).toPandas()
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], schema)
    points = _normalised(np.stack(sample["embedding"]).astype(np.float64))
    distinct = np.unique(points, axis=0)
    forest = Forest([grow(distinct, leaf_rows, rng) for _ in range(trees)])
    by_vector = Window.partitionBy("embedding").orderBy("vec_id")
    few = valid.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= nearest + 1)
    classes, _ = common.staged(few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select("ids", "embedding"), "classes")
    n_classes, sizes = classes.count(), {}
    for k in range(REFINEMENTS + 1):
        sizes = {r["leaf"]: r["count"] for r in _leaf_sizes(classes, forest).where(F.col("count") > LEAF_PART).collect()}  # at most the forest's leaves
        if not sizes or k == REFINEMENTS:
            break
        draw = F.pmod(F.xxhash64(F.col("ids")[0], F.lit(seed + 1 + k)), F.lit(1_000_003)) / 1_000_003.0
        more = classes.where(draw <= sample_rows / n_classes).orderBy(F.col("ids")[0]).toPandas()
        if len(more):
            forest.refine(_normalised(np.stack(more["embedding"]).astype(np.float64)), sizes, LEAF_PART, rng)
    parts = {leaf: -(-n // LEAF_PART) for leaf, n in sizes.items()}
    recall, share = forest.calibrate(distinct, nearest, recall_target, calibration_queries, rng)
    LOG.info("forest: %s", {"leaves": forest.offsets[-1], "visits": forest.visits, "divided": len(parts), "recall": round(recall, 3), "compared": round(share, 3)})

    kind = classes.schema["embedding"].dataType.simpleString()
    routed = classes.mapInArrow(lambda it: _routed(it, forest, parts), f"leaf long, part long, ids array<long>, embedding {kind}")
    queries = valid.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding")
    visits = queries.mapInArrow(lambda it: _visited(it, forest, parts), f"leaf long, part long, query_id long, embedding {kind}")
    found = (
        routed.groupBy("leaf", "part").cogroup(visits.groupBy("leaf", "part"))
        .applyInPandas(lambda rows, own: _reranked(rows, own, nearest), "query_id long, ids array<long>, score double")
    )
    single = found.groupBy("query_id", F.col("ids")[0].alias("class")).agg(F.first("ids").alias("ids"), F.max("score").alias("score"))
    each = single.select("query_id", F.explode("ids").alias("vec_id"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "score")).alias("score")).where("vec_id <> query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
