"""Approximate nearest neighbours by collision-counting hashing.

Largest inner products become smallest distances: vectors get one more coordinate that brings them to the largest norm of
their index. A hash function is one random projection; an index holds, for each of PROJECTIONS functions, the sorted array
of the projected values of its vectors. For a query, the window around its own value in every sorted array is widened by
virtual rehashing: radius R, then GROWTH times R, and so on; each step counts only what newly enters at the two ends of
the windows. A vector inside the window of a function collides there, and vectors with at least `least` collisions are
verified by their exact inner product. A vector at distance R collides with known probability, and `least` lies
DEVIATIONS standard deviations below the mean of that binomial, so most vectors within R have been verified; a query is
done when its k-th nearest verified vector is within R. The k nearest of few vectors are further away, where counts tell
distances apart less well, so smaller indexes have more functions.

Vectors are dealt to blocks by their norm, and within a block every range of norms (largest to smallest at most NORM_RANGE)
is an index of its own, so a few long vectors leave the distances of the others as they are. Ranges are searched from
the longest vectors on, until the product of the norms is below the k-th score. Everything is scaled to length 1 before
it is projected. A block meets all queries, block by block; its indexes are built once for as long as the task has it, and
only queries are copied. A window function then keeps the k nearest of each query.

Null vectors, zero vectors, and vectors with null or non-finite components or another length than most take no part; a
null id likewise. Equal rows count once; rows of equal id but different vectors are candidates of their own. A query's own
id is no candidate. Ties go to the smaller id. Queries with fewer than k candidates get all. An empty table gives no rows.
Other columns, whatever their names, are not read, but `is_query` may name vec_id only.
"""

from __future__ import annotations

from functools import lru_cache
from math import inf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapweave.llm.common import materialise
from gapweave.llm.vector_blocks import dealt, matrix, packed, paired

HALF_WIDTH, GROWTH = 1.3, 1.07
#: P(|standard normal| <= HALF_WIDTH)
COLLIDES = 0.8064
#: Functions of an index: the most up to so many vectors, fewer by the square root of more vectors, the least at least.
MOST_FUNCTIONS, LEAST_FUNCTIONS, SMALL = 448, 128, 4_500
#: Standard deviations below the mean from which a vector is verified, with the most functions and with the least.
DEVIATIONS = 0.35, 0.9
#: Largest distance of vectors of length 1; radius of the first query of an index; queries begin at this share of the radius that those before them needed.
FAR, FIRST, START = 2.0, 0.5, 0.95
#: Windows of less than one part in so many of an index (or more than all but that) are listed.
LISTED = 8
#: Vectors and queries of a block, about (a block has twice as many at most, whose places are 16-bit numbers), and the bytes of either's vectors.
INDEX_ROWS, BLOCK_ROWS, VECTOR_BYTES = 30_000, 2_048, 16 << 20
#: Largest norm of an index by its smallest; vectors of an index at least.
NORM_RANGE, FEW = 1.25, 256
#: Ranges of norms that vectors are dealt by, at most; the driver holds their limits.
RANGES = 64


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and v (array<double>) of the distinct rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = v.isNotNull() & F.col(vec_id).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(fine.isNotNull() & fine)
    return rows.distinct()


class Index:
    """Sorted arrays of projected vectors of similar norms, all lifted to the largest of these and scaled to length 1."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray):
        n = len(ids)
        self.ids, self.vectors, self.norm = ids, vectors, float(norms.max())
        share = norms / self.norm
        full = np.column_stack((vectors / self.norm, np.sqrt(np.maximum(1 - share * share, 0))))
        functions = int(min(max(MOST_FUNCTIONS * sqrt(SMALL / n), LEAST_FUNCTIONS), MOST_FUNCTIONS))
        deviations = float(np.interp(functions, (LEAST_FUNCTIONS, MOST_FUNCTIONS), DEVIATIONS[::-1]))
        self.least = COLLIDES * functions - deviations * sqrt(functions * COLLIDES * (1 - COLLIDES))
        self.directions = directions(vectors.shape[1])[:, :functions]
        projected = np.ascontiguousarray((full @ self.directions).T.astype(np.float32))
        self.order = np.argsort(projected, axis=1, kind="stable").astype(np.uint16)
        self.sorted = np.take_along_axis(projected, self.order.astype(np.int64), axis=1)
        self.place = np.empty_like(self.order)  # of every vector in every sorted array
        np.put_along_axis(self.place, self.order.astype(np.int64), np.broadcast_to(np.arange(n, dtype=np.uint16), self.order.shape), axis=1)

    def windows(self, projected: np.ndarray, radius: float) -> list[tuple[int, int]]:
        """For every function the first place of the query's window and the one after the last."""
        half = np.float32(HALF_WIDTH * radius)
        return [(int(a.searchsorted(x - half)), int(a.searchsorted(x + half, "right"))) for a, x in zip(self.sorted, projected, strict=True)]

    def collisions(self, windows: list[tuple[int, int]]) -> np.ndarray:
        """In how many of the windows each vector lies: narrow ones are listed, of nearly full ones what lies outside."""
        n, all_of = len(self.ids), 0
        count, part, near, far, compared = np.zeros(n, np.uint16), np.zeros(n, np.uint8), [], [], 0
        for order, place, (lo, hi) in zip(self.order, self.place, windows, strict=True):
            if (hi - lo) * LISTED < n:
                near.append(order[lo:hi])
            elif (n - hi + lo) * LISTED < n:
                all_of += 1
                far += [order[:lo], order[hi:]]
            else:  # so wide that one comparison of all places is the shorter way
                part += (place - np.uint16(lo) < np.uint16(hi - lo)).view(np.uint8)
                compared += 1
                if compared % 255 == 0:
                    count += part
                    part[:] = 0
        return count + part + np.uint16(all_of) + tally(near, n) - tally(far, n)

    def entered(self, old: list[tuple[int, int]], new: list[tuple[int, int]]) -> np.ndarray:
        """How many of the windows each vector has newly entered."""
        ends = [x for order, (a, b), (c, d) in zip(self.order, old, new, strict=True) for x in (order[c:a], order[b:d])]
        return tally(ends, len(self.ids))

    def search(self, query_id: int, query: np.ndarray, best: Best, start: float) -> tuple[float, int]:
        """Adds verified vectors to `best`; returns the radius that was needed and how many were verified."""
        size = np.linalg.norm(query)
        projected = ((query / size) @ self.directions[:-1]).astype(np.float32)
        radius, todo, verified = min(start, FAR), self.ids != query_id, 0
        windows = self.windows(projected, radius)
        count = self.collisions(windows)
        while True:
            new = np.flatnonzero(todo & (count >= self.least)) if radius < FAR else np.flatnonzero(todo)
            todo[new] = False
            verified += len(new)
            best.add(self.ids[new], products(self.vectors[new], query))
            reach = sqrt(max(2 - 2 * best.last / (self.norm * size), 0)) if best.last > -inf else FAR
            if reach <= radius or radius >= FAR:
                return max(reach, radius / GROWTH), verified
            radius = min(radius * GROWTH, FAR)
            wider = self.windows(projected, radius)
            count += self.entered(windows, wider)
            windows = wider


class Best:
    """The k best of the vectors that were verified for a query; `last` is the score of the k-th."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores, self.last = k, np.zeros(0, np.int64), np.zeros(0), -inf

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        fit = scores >= self.last
        ids, scores = np.concatenate((self.ids, ids[fit])), np.concatenate((self.scores, scores[fit]))
        if len(ids) > 4 * self.k:
            least = np.partition(scores, -self.k)[-self.k]
            ids, scores = ids[scores >= least], scores[scores >= least]
        best = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[best], scores[best]
        if len(best) == self.k:
            self.last = float(self.scores[-1])


class Ranges:
    """The indexes of a block, one for each range of norms, largest norms first; ranges of few vectors are verified whole."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        largest = np.abs(vectors).max(axis=1, initial=0)
        norms = largest * np.linalg.norm(vectors / largest[:, None], axis=1)
        at = np.argsort(-norms, kind="stable")
        ids, vectors, norms = ids[at], vectors[at], norms[at]
        self.parts, a = [], 0
        while a < len(ids):
            b = int(np.searchsorted(-norms, -norms[a] / NORM_RANGE, "right"))
            self.parts.append((float(norms[a]), ids[a:b], vectors[a:b], Index(ids[a:b], vectors[a:b], norms[a:b]) if b - a >= FEW else None))
            a = b
        self.reach = [[] for _ in self.parts]

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """ids and scores of the k nearest verified vectors, and how many were verified."""
        best, verified, size = Best(k), 0, np.linalg.norm(query)
        for (norm, ids, vectors, index), reach in zip(self.parts, self.reach, strict=True):
            if norm * size * (1 + 1e-9) < best.last:  # no product is larger than that of the norms
                break
            if index is None:
                own = ids != query_id
                best.add(ids[own], products(vectors[own], query))
                verified += len(ids)
            else:
                needed, n = index.search(query_id, query, best, START * float(np.median(reach[-50:])) if reach else FIRST)
                reach.append(needed)
                verified += n
        return best.ids, best.scores, verified


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, which are the same for equal vectors wherever they stand."""
    return np.einsum("ij,j->i", vectors, query)


def tally(lists: list[np.ndarray], n: int) -> np.ndarray:
    return np.bincount(np.concatenate(lists), minlength=n).astype(np.uint16) if lists else np.zeros(n, np.uint16)


@lru_cache(maxsize=4)
def directions(dims: int) -> np.ndarray:
    return np.random.default_rng(20170801).normal(size=(dims + 1, MOST_FUNCTIONS))


def by_norm(rows: DataFrame, most: int) -> Column:
    """A block number: ranges of `norm`, RANGES at most, each dealt by a hash to as many blocks as its rows take."""
    n = min(RANGES, max(1, rows.count() // most))
    cuts = rows.agg(F.percentile_approx("norm", [k / n for k in range(1, n)], 10_000).alias("c")).first()["c"] if n > 1 else []
    range_ = F.size(F.filter(F.array(*map(F.lit, cuts or [])).cast("array<double>"), lambda c: c <= F.col("norm")))
    blocks = {r["r"]: max(1, round(r["count"] / most)) for r in rows.groupBy(range_.alias("r")).count().orderBy("r").collect()}
    before, out = 0, F.lit(0)
    for r, size in blocks.items():
        out = F.when(range_ == r, before + F.pmod(F.xxhash64("vec_id", "v"), F.lit(size))).otherwise(out)
        before += size
    return out.cast("int")


def search(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest vectors found for each row that is a query."""
    rows = materialise(usable(vectors, vec_id, vector), "vectors")
    shape = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    rows = rows if shape is None else rows.where(F.size("v") == shape["dims"])
    most = max(1, VECTOR_BYTES // (8 * shape["dims"])) if shape else INDEX_ROWS
    long = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    norm = long * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / long) * (x / long)))
    ranged = materialise(rows.withColumn("norm", norm), "ranged-vectors")
    stored = packed(ranged, "vector-blocks", min(INDEX_ROWS, most), by_norm(ranged, min(INDEX_ROWS, most)), F.desc("norm"), F.col("vec_id"))
    queries = materialise(rows.where(is_query), "queries")
    asked = packed(queries, "query-blocks", min(BLOCK_ROWS, most), dealt(queries, min(BLOCK_ROWS, most)), F.col("vec_id"))

    def run(asked: pa.Table, index: Ranges) -> pa.Table:
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        for query_id, query in zip(asked["vec_id"].to_pylist(), matrix(asked["v"], len(asked)), strict=True):
            ids, scores, _ = index.search(query_id, query, k)
            for part, values in zip(out, (np.full(len(ids), query_id), ids, scores), strict=True):
                part.append(values)
        return pa.table({"query_id": np.concatenate(out[0]), "vec_id": np.concatenate(out[1]), "score": np.concatenate(out[2])})

    near = paired(asked, stored, run, "query_id long, vec_id long, score double", lambda t: Ranges(t["vec_id"].to_numpy(), matrix(t["v"], len(t)))).distinct()
    nearest_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
