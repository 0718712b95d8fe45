"""Nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

Largest inner products become least distances when every vector gets one more component that fills its length up to the
longest. The longer vectors are projected on `PROJECTED` random Gaussian directions; there a distance d becomes d times a
chi variable of as many degrees of freedom. Vectors are dealt by their id into blocks of about `BLOCK`, queries into
blocks of about `QUERIES`, and every two blocks meet in one task, which builds a kd-tree over the projections. A query
takes the tree's leaves in order of projected distance and verifies their members by true inner products, until the
next leaf is so far that, were a better neighbour behind it, its projected distance would exceed the chi-square quantile
`CERTAINTY`. Spark then keeps the best of all blocks.

Vectors that are null, empty or zero or hold null or non-finite components take no part; vectors only meet others of their
length. Equal vectors are verified once. Rows that repeat an id with the same vector count once; rows of the query's own
id are never its neighbours; ties go to the smaller id. With fewer candidates than asked for, all are returned.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROJECTED, LEAF, CERTAINTY, SEED = 8, 64, 0.97, 11
BLOCK, QUERIES = 8192, 4096
#: Leaves that a query verifies between two tests.
STEP = 4

FOUND = "query_id long, vec_id long, score double"


def chi_square_quantile(p: float, freedom: int) -> float:
    """Of an even number of degrees of freedom."""

    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, freedom // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(100):
        low, high = (mid, high) if below(mid := (low + high) / 2) < p else (low, mid)
    return high


class ProjectedTree:
    """A kd-tree over the projections of vectors that share a dimension."""

    def __init__(self, vectors: np.ndarray, longest: float) -> None:
        self.vectors, self.longest = vectors, longest
        self.turn = np.random.default_rng(SEED).normal(size=(vectors.shape[1] + 1, PROJECTED))
        fill = np.sqrt(np.maximum(longest - (vectors**2).sum(axis=1), 0))
        points = np.hstack([vectors, fill[:, None]]) @ self.turn
        self.leaves: list[np.ndarray] = []
        open_ = [np.arange(len(points))]
        while open_:
            part = open_.pop()
            if len(part) <= LEAF:
                self.leaves.append(part)
                continue
            axis = int(np.ptp(points[part], axis=0).argmax())
            order = part[np.argpartition(points[part, axis], len(part) // 2)]
            open_ += [order[: len(part) // 2], order[len(part) // 2 :]]
        self.low = np.array([points[leaf].min(axis=0) for leaf in self.leaves])
        self.high = np.array([points[leaf].max(axis=0) for leaf in self.leaves])

    def search(self, queries: np.ndarray, k: int) -> np.ndarray:
        """Places of the `k` vectors of largest inner product for each query, -1 where there are fewer."""
        size = np.sqrt((queries**2).sum(axis=1))
        scaled = queries * (math.sqrt(self.longest) / size)[:, None]
        points = scaled @ self.turn[:-1]
        far = np.zeros((len(queries), len(self.leaves)))
        for axis in range(PROJECTED):
            at = points[:, axis, None]
            far += np.maximum(0, np.maximum(self.low[:, axis] - at, at - self.high[:, axis])) ** 2
        order = np.argsort(far, axis=1, kind="stable")
        far = np.take_along_axis(far, order, axis=1)
        best = np.full((len(queries), k), -np.inf)
        place = np.full((len(queries), k), -1, dtype=np.int64)
        limit = chi_square_quantile(CERTAINTY, PROJECTED)
        active = np.arange(len(queries))
        for at in range(0, len(self.leaves), STEP):
            distance = np.maximum(0, 2 * self.longest - 2 * best[active, -1])
            active = active[~(far[active, at] > distance * limit)]
            if not len(active):
                break
            wanted = order[active, at : at + STEP]
            for leaf in np.unique(wanted):
                self._verify(active[(wanted == leaf).any(axis=1)], self.leaves[leaf], scaled, best, place)
        return place

    def _verify(self, asking: np.ndarray, leaf: np.ndarray, scaled: np.ndarray, best: np.ndarray, place: np.ndarray) -> None:
        scores = scaled[asking] @ self.vectors[leaf].T
        better = (scores >= best[asking, -1:]).any(axis=1)
        asking, scores = asking[better], scores[better]
        if not len(asking):
            return
        scores = np.hstack([best[asking], scores])
        places = np.hstack([place[asking], np.broadcast_to(leaf, (len(asking), len(leaf)))])
        k = best.shape[1]
        order = np.lexsort((places, -scores), axis=1)[:, :k]
        best[asking] = np.take_along_axis(scores, order, axis=1)
        place[asking] = np.take_along_axis(places, order, axis=1)


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def search_block(queries: pd.DataFrame, vectors: pd.DataFrame, k: int, longest: float) -> pd.DataFrame:
    """The `k` best of `vectors` for each of `queries`, both of (vec_id, embedding)."""
    if not len(queries) or not len(vectors):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    queries = queries.drop_duplicates("vec_id")
    ids, given = vectors["vec_id"].to_numpy(), _stacked(vectors["embedding"]) + 0.0
    by_id = np.argsort(ids, kind="stable")
    ids, given = ids[by_id], np.ascontiguousarray(given[by_id])
    _, first, same = np.unique(given.view(np.dtype((np.void, given.itemsize * given.shape[1]))).ravel(), return_index=True, return_inverse=True)
    owner = first[same]
    kept = np.sort(first)
    members = {int(u): [] for u in kept}
    for u, i in zip(owner.tolist(), ids.tolist(), strict=True):
        if len(held := members[u]) <= k and (not held or held[-1] != i):
            held.append(i)
    unique, asked, asking = given[kept], queries["vec_id"].tolist(), _stacked(queries["embedding"])
    places = ProjectedTree(unique, longest).search(asking, k + 1)
    rows: list[tuple[int, int, float]] = []
    for query, vector, found in zip(asked, asking, places, strict=True):
        found = found[found >= 0]
        scores = (unique[found] * vector).sum(axis=1).tolist()
        one = [(-s, i) for s, u in zip(scores, kept[found].tolist(), strict=True) for i in members[u] if i != query]
        rows += [(query, i, -s) for s, i in sorted(one)[:k]]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of `vectors` (vec_id, embedding) where `is_query` holds its `k` nearest."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable & F.col("vec_id").isNotNull())
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    about = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max(norm).alias("longest")).first()
    parts, sides, longest = max(1, -(-about["n"] // block)), max(1, -(-about["q"] // queries)), about["longest"] or 1.0
    rows = rows.withColumn("length", F.size("embedding"))
    part, side = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"), F.pmod(F.xxhash64(F.lit("query"), "vec_id"), F.lit(sides)).cast("int")
    left = rows.where(is_query).select("vec_id", "embedding", "length", side.alias("side"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = rows.select("vec_id", "embedding", "length", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("side"), part.alias("part"))
    keys = ["length", "part", "side"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda q, v: search_block(q, v, k, longest), FOUND)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
