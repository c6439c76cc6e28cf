"""Exact top-k inner products by M-trees: blocks of queries search paged metric nodes, nearest pages first.

The inner product is turned into a distance: with M the largest norm, a vector x
gets one more component sqrt(M^2 - |x|^2) and a query a zero, so that
d(q, x)^2 = |q|^2 + M^2 - 2 q.x is a Euclidean metric, smallest where the product
is largest.  Vectors are dealt into blocks by their distance to one pivot and
each block becomes an M-tree of two levels of routing objects over leaf pages.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Tables, prepare

#: Vectors of one tree, entries of a leaf page, pages below an inner node, queries of one block.
TREE_ROWS, PAGE_ROWS, FANOUT, QUERY_ROWS = 8192, 256, 8, 1024
#: Vectors whose trees one task searches for a block of queries, one tree after the other.
SHARE_ROWS = 4 * TREE_ROWS
#: Room for rounding in distances, relative to the largest one.
SLACK = 1e-7


def _usable(vector: str) -> Column:
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return v.isNotNull() & ~bad


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _halves(points: np.ndarray, rows: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows in pages of at most ``most``, each split at the median distance to a far point."""
    done, todo = [], [rows]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        own = points[rows]
        far = own[_distances(own[:1], own)[0].argmax()]
        order = np.argsort(_distances(far[None], own)[0], kind="stable")
        middle = -(-len(rows) // (2 * most)) * most
        todo += [rows[order[middle:]], rows[order[:middle]]]
    return done


class Tree:
    """Leaf pages and inner nodes with routing objects, covering radii and distances to their parents."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float):
        self.ids, self.vectors = ids, _narrow(vectors)
        self.pages, self.page_router, self.page_radius, self.entry_distance = [], [], [], []
        points = self._augmented(vectors, top)
        for rows in _halves(points, np.arange(len(ids)), PAGE_ROWS):
            rows = rows[np.argsort(ids[rows], kind="stable")]
            router = points[rows].mean(0)
            router = points[rows[((points[rows] - router) ** 2).sum(1).argmin()]]
            away = _distances(router[None], points[rows])[0]
            self.pages.append(rows)
            self.page_router.append(router)
            self.page_radius.append(away.max())
            self.entry_distance.append(away)
        self.page_router, self.page_radius = np.array(self.page_router), np.array(self.page_radius)
        self.nodes = _halves(self.page_router, np.arange(len(self.pages)), FANOUT)
        self.node_router = np.array([self.page_router[n[0]] for n in self.nodes])
        self.page_distance = [_distances(r[None], self.page_router[n])[0] for r, n in zip(self.node_router, self.nodes)]
        self.node_radius = np.array([(d + self.page_radius[n]).max() for d, n in zip(self.page_distance, self.nodes)])

    @staticmethod
    def _augmented(vectors: np.ndarray, top: float) -> np.ndarray:
        square = (vectors.astype(np.float64) ** 2).sum(1)
        return np.column_stack([vectors, np.sqrt(np.maximum(top - square, 0))]).astype(np.float64)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, top: float, best: "Best") -> None:
        """Put the ``k`` entries nearest to each query into ``best``, which may hold those of other trees.

        Each query takes the pages by their least possible distance until that is beyond its
        k-th distance so far; queries that take the same page in the same round are multiplied
        with its entries at once.
        """
        points = np.column_stack([queries.astype(np.float64), np.zeros(len(queries))])
        square = (points * points).sum(1) + top
        slack = SLACK * (np.sqrt(square) + 1)
        reach = best.reach(square) + slack
        to_node = _distances(points, self.node_router)
        least = np.full((len(queries), len(self.pages)), math.inf)
        away = np.zeros_like(least)
        for node, pages in enumerate(self.nodes):
            alive = np.flatnonzero(to_node[:, node] - self.node_radius[node] <= reach)
            # by the stored distance to the parent, without computing: |d(q, parent) - d(parent, page)| - radius
            near = np.abs(to_node[alive, node][:, None] - self.page_distance[node]) - self.page_radius[pages] <= reach[alive, None]
            pages, alive = pages[near.any(0)], alive[near.any(1)]
            if len(pages) and len(alive):
                at = np.ix_(alive, pages)
                away[at] = _distances(points[alive], self.page_router[pages])
                least[at] = np.maximum(away[at] - self.page_radius[pages], 0)
        order = np.argsort(least, axis=1, kind="stable")
        alive = np.arange(len(queries))
        for page in order.T:
            # a query is done when its nearest page left is out of reach
            alive = alive[least[alive, page[alive]] <= np.minimum(reach, 1e300)[alive]]
            if not len(alive):
                break
            alive = alive[np.argsort(page[alive], kind="stable")]
            for own in np.split(alive, np.flatnonzero(np.diff(page[alive])) + 1):
                of, d = int(page[own[0]]), away[own, page[own[0]]]
                distance = self.entry_distance[of]
                rows = self.pages[of][(distance >= (d - reach[own]).min()) & (distance <= (d + reach[own]).max())]
                best.offer(own, query_ids[own], self.ids[rows], self.product(rows, queries[own]))
            best.merge()
            reach = best.reach(square) + slack

    def product(self, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Exact integer products, a row for each query; in floating point only where that is exact."""
        own = self.vectors[rows]
        if not own.size or not queries.size:
            return np.zeros((len(queries), len(own)), np.int64)
        most = float(np.abs(own.astype(np.float64)).max()) * float(np.abs(queries.astype(np.float64)).max()) * queries.shape[1]
        for kind, exact in ((np.float32, 2.0 ** 24), (np.float64, 2.0 ** 53)):
            if most < exact:
                return np.rint(queries.astype(kind) @ own.astype(kind).T).astype(np.int64)
        return queries.astype(np.int64) @ own.astype(np.int64).T


class Best:
    """The ``k`` best entries of each query so far: larger scores first, then smaller ids."""

    NONE = -(2 ** 63 - 1)           # the score of a place that is not taken

    def __init__(self, queries: int, k: int):
        self.ids, self.scores, self.found = np.zeros((queries, k), np.int64), np.full((queries, k), self.NONE), []

    def reach(self, square: np.ndarray) -> np.ndarray:
        """Distance of each query's last entry; infinite while it has fewer than ``k``."""
        last = self.scores[:, -1]
        return np.where(last == self.NONE, math.inf, np.sqrt(np.maximum(square - 2 * last.astype(np.float64), 0)))

    def offer(self, own: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of entries for the queries ``own``; those that can't be among the best are left."""
        i, j = np.nonzero(scores >= self.scores[own, -1][:, None])
        other = ids[j] != query_ids[i]
        i, j = i[other], j[other]
        self.found.append((own[i], ids[j], scores[i, j]))

    def merge(self) -> None:
        own, ids, scores = (np.concatenate(x) for x in zip(*self.found))
        self.found = []
        asked = np.unique(own)
        k = self.ids.shape[1]
        own = np.concatenate([own, np.repeat(asked, k)])
        ids = np.concatenate([ids, self.ids[asked].ravel()])
        scores = np.concatenate([scores, self.scores[asked].ravel()])
        order = np.lexsort((ids, -scores, own))
        own, ids, scores = own[order], ids[order], scores[order]
        # each asked query has at least its k old places
        first = (np.searchsorted(own, asked)[:, None] + np.arange(k)).ravel()
        self.ids[asked], self.scores[asked] = ids[first].reshape(-1, k), scores[first].reshape(-1, k)


def _matrix(column, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones ending with zeros."""
    if isinstance(column, (pa.Array, pa.ChunkedArray)):
        long = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    else:
        long = np.fromiter(map(len, column), np.int64, len(column))
        flat = np.concatenate([np.asarray(x, np.int64) for x in column]) if len(column) else np.zeros(0, np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < long[:, None]] = flat
    return out


def _narrow(vectors: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them all."""
    for kind in (np.int8, np.int16, np.int32):
        if not vectors.size or (vectors.min() >= np.iinfo(kind).min and vectors.max() <= np.iinfo(kind).max):
            return vectors.astype(kind)
    return vectors


def _build(width: int, top: float, trees: int):
    """Trees of the rows of a partition, a block after the other."""

    def flush(part: int, turn: int, rows: list):
        ids = np.concatenate([r[0] for r in rows])
        vectors = np.concatenate([r[1] for r in rows])
        blob = pickle.dumps(Tree(ids, vectors.astype(np.int64), top), protocol=5)
        return pa.RecordBatch.from_pydict({"tree": pa.array([part + turn * (trees + 1)], pa.int64()),
                                           "blob": pa.array([blob], pa.binary())})

    def run(batches):
        from pyspark import TaskContext
        part, turn, rows, n = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            vectors = _matrix(batch.column("v"), width)
            ids = batch.column("vec_id").to_numpy()
            while len(ids):
                take = TREE_ROWS - n
                rows.append((ids[:take], vectors[:take]))
                n += len(rows[-1][0])
                ids, vectors = ids[take:], vectors[take:]
                if n == TREE_ROWS:
                    yield flush(part, turn, rows)
                    turn, rows, n = turn + 1, [], 0
        if n:
            yield flush(part, turn, rows)

    return run


def _search(width: int, top: float, k: int):
    """The best entries of a share of the trees for a block of queries; each tree starts at what the ones before left."""

    def run(trees: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        asked, vectors, best = queries["vec_id"].to_numpy(), _matrix(queries["v"], width), Best(len(queries), k)
        for blob in trees["blob"]:
            pickle.loads(blob).search(asked, vectors, k, top, best)
        query, place = np.nonzero(best.scores != best.NONE)
        return pd.DataFrame({"query_id": asked[query], "vec_id": best.ids[query, place], "score": best.scores[query, place]})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id",
          vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest integer inner products of each query.

    Components become floor(scale * x).  ``queries`` has the columns of
    ``vectors``; a query's own id is no candidate.  Ties go to smaller ids.  All
    vectors are candidates: each block of queries visits every tree, whose
    search, nearest pages first, skips what its bounds exclude.

    Vectors that are null, or hold a null or non-finite component, and null ids
    take no part; of rows that repeat an id the smallest vector does; shorter
    vectors end with zeros (an empty one scores zero).  Fewer candidates than
    ``k`` are all returned; no vectors or queries, no rows.  Other columns are not
    read, whatever their names.
    """
    spark = vectors.sparkSession
    prepare(spark)
    tables = Tables(spark, "mtree")

    def clean(df: DataFrame) -> DataFrame:
        whole = F.transform(F.col(f"`{vector_col}`"), lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))
        own = F.col(f"`{id_col}`").cast("long")
        return df.where(_usable(f"`{vector_col}`") & own.isNotNull()).select(own.alias("vec_id"), whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))

    base = tables.store(clean(vectors), "vectors")
    asked = tables.store(clean(queries), "queries")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, width, top = base.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    q, wide = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n or not q:
        return spark.createDataFrame([], schema)
    width, trees, blocks = max(width, wide), math.ceil(n / TREE_ROWS), math.ceil(q / QUERY_ROWS)
    pivot = base.orderBy("vec_id").limit(1).select("v").first()[0]
    away = F.aggregate(F.zip_with("v", F.array(*map(F.lit, pivot)) if pivot else F.array().cast("array<long>"),
                                  lambda x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))),
                       F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    index = tables.store(base.withColumn("away", away).repartitionByRange(trees, "away", "vec_id").select("vec_id", "v")
                         .mapInArrow(_build(width, top, trees), "tree long, blob binary"), "index")
    shares = math.ceil(n / SHARE_ROWS)
    every = index.select(F.pmod("tree", F.lit(shares)).cast("int").alias("share"), "blob",
                         F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    pairs = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "vec_id", "v",
                         F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    found = every.groupBy("share", "block").cogroup(pairs.groupBy("share", "block")).applyInPandas(
        _search(width, top, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
