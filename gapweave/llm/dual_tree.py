"""Centroid clustering by dual-tree Lloyd rounds.

Vectors are kept in blocks, each with a cover tree: a node is a vector with all vectors of its set within its radius; its
children are the node's own vector and others more than half its radius apart, which cover the set within half the radius.
The trees are built once and written. Every round builds such a tree over the centroids and walks both from their roots: a
pair of nodes is dropped when the distance of their vectors less both radii exceeds what some centroid is sure to stay
under for the whole node of vectors. A node with one centroid left is assigned as a whole, by the sum of its vectors; leaves
with several are compared exactly. Bounds are floating-point with a slack above their rounding errors, so that they only
decide what certainly holds; exact comparison decides ties (smaller number first).

A task sends one row of sums for each centroid, and the driver holds the k centroids only.

Components become integers floor(scale * x). Distances and sums are exact at every size: double precision while it holds all
integers that occur, else Python's integers. A distance or inertia that doesn't fit in a long is null. Vectors that are null,
of another length, or hold null or non-finite components take no part; components of 2**400 or more count as non-finite.
Repeated rows are vectors of their own. With fewer than k vectors all are centroids. Equal centroids: the smaller number
gets the vectors, the other stays as it is. Null ids take part and come last in every order. An empty table gives no rows.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.llm.common import bounded_batches, materialise, release
from gapweave.llm.vector_blocks import matrix

#: Vectors of a block; sets of so many are not split further.
BLOCK, LEAF = 2_048, 8
#: Share of the coordinates' size that floating-point distances may be wrong by, with much room.
SLACK = 1e-11
#: Bits of the parts in which sums are added up over tasks: a part's total fits in a long for 2**31 tasks.
PART = 32


class Tree:
    """A cover tree over points; `order` lists points so that every node is a range."""

    def __init__(self, points: np.ndarray, leaf: int):
        n = len(points)
        self.order = np.arange(n)
        self.begin, self.end, self.centre, self.child, self.children = [0], [n], [0], [0], [0]
        self.radius: list[float] = [0.0]
        norms = (points * points).sum(axis=1)
        square = norms[:, None] + norms[None, :] - 2 * (points @ points.T)
        apart = np.sqrt(np.maximum(square, 0))
        sets = [np.arange(n)]
        node = 0
        while node < len(sets):
            own, at = sets[node], self.begin[node]
            far = apart[self.centre[node], own]
            # The node's vector is in its set; rounding must not make equal points look apart.
            self.radius[node] = float(far.max(initial=0.0))
            if len(own) <= leaf or self.radius[node] <= SLACK * float(np.sqrt(norms[own].max(initial=0.0))):
                self.order[at : at + len(own)] = own
            else:
                self.child[node], half, left, centre = len(sets), self.radius[node] / 2, own, self.centre[node]
                while len(left):
                    near = apart[centre, left] <= half
                    near |= left == centre
                    part, left = left[near], left[~near]
                    for values, value in ((self.begin, at), (self.end, at + len(part)), (self.centre, centre), (self.child, 0), (self.children, 0), (self.radius, 0.0), (sets, part)):
                        values.append(value)
                    self.children[node] += 1
                    at += len(part)
                    centre = left[0] if len(left) else 0
                if self.children[node] == 1:  # nothing was far enough after rounding
                    raise ArithmeticError("a radius reaches no point")
            node += 1
        self.begin, self.end, self.centre, self.child, self.children = (np.array(x, np.int64) for x in (self.begin, self.end, self.centre, self.child, self.children))
        self.radius = np.array(self.radius)


def exact(numbers: np.ndarray) -> np.ndarray:
    """Whole floating-point numbers as Python's integers."""
    return np.frompyfunc(int, 1, 1)(numbers)


def squares(x: np.ndarray, c: np.ndarray, c_whole: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x (whole floats) and of the centroids c (floats of the integers c_whole), as integers."""
    most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4 * x.shape[1] * most * most < float(1 << 52):
        return ((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)).astype(np.int64)
    whole = exact(x)
    out = np.empty((len(x), len(c)), object)
    for j, own in enumerate(c_whole):
        out[:, j] = ((whole - own) ** 2).sum(axis=1)
    return out


class Centroids:
    """The centroids of a round: numbers of the distinct ones, their coordinates and their tree."""

    def __init__(self, whole: list[list[int]]):
        first = {tuple(c): j for j, c in reversed(list(enumerate(whole)))}
        self.number = np.array(sorted(first.values()), np.int64)
        self.whole = np.array([whole[j] for j in self.number], object)
        self.at = self.whole.astype(np.float64)
        self.size = np.sqrt((self.at * self.at).sum(axis=1))
        self.tree = Tree(self.at, 1)


def assign(points: np.ndarray, tree: Tree, c: Centroids) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, np.ndarray]], int]:
    """Ranges with the place of their only possible centroid; ranges with the places of several; and how many pairs of nodes were looked at.

    Ranges are of `points`, which are in the tree's order.
    """
    t = c.tree
    size = np.sqrt((points * points).sum(axis=1))
    sure, open_, looked = [], [], 0
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)  # pairs of nodes, by a
    bound = np.full(1, np.inf)  # of every pair: what the nearest centroid of each vector of a is within
    while len(a):
        looked += len(a)
        x, y = tree_centre(tree)[a], t.centre[b]
        apart = np.concatenate([np.sqrt(((points[x[k : k + 8_192]] - c.at[y[k : k + 8_192]]) ** 2).sum(axis=1)) for k in range(0, len(a), 8_192)])
        slack = SLACK * (size[x] + c.size[y] + tree.radius[a] + t.radius[b])
        starts = np.flatnonzero(np.diff(a, prepend=-1))
        counts = np.diff(np.append(starts, len(a)))
        bound = np.minimum(bound, np.repeat(np.minimum.reduceat(apart + tree.radius[a] + slack, starts), counts))
        keep = apart - tree.radius[a] - t.radius[b] - slack <= bound
        a, b, bound = a[keep], b[keep], bound[keep]
        starts = np.flatnonzero(np.diff(a, prepend=-1))
        counts = np.diff(np.append(starts, len(a)))
        wide = np.maximum.reduceat(t.radius[b], starts) if len(a) else np.zeros(0)
        inner = np.maximum.reduceat(t.children[b], starts) > 0 if len(a) else np.zeros(0, bool)
        first, splits = a[starts], tree.children[a[starts]] > 0
        alone = (counts == 1) & ~inner
        sure += [(tree.begin[n], tree.end[n], t.order[t.begin[b[s]]]) for n, s in zip(first[alone], starts[alone], strict=True)]
        leaves = ~alone & ~splits & ~inner
        open_ += [(tree.begin[n], tree.end[n], t.order[t.begin[b[s : s + k]]]) for n, s, k in zip(first[leaves], starts[leaves], counts[leaves], strict=True)]
        by_a = ~alone & ~leaves & splits & (~inner | (tree.radius[first] >= wide))
        by_b = ~alone & ~leaves & ~by_a
        # The children of a node, with all its centroid nodes.
        k = np.repeat(by_a, counts)
        n = tree.children[first[by_a]]
        pick = np.repeat(np.flatnonzero(by_a), n)
        kids = np.repeat(tree.child[first[by_a]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        each = counts[pick]
        at = np.repeat(starts[pick] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        next_a, next_b, next_bound = [np.repeat(kids, each)], [b[at]], [bound[at]]
        # A node with the children of its centroid nodes, where these have some.
        k = np.repeat(by_b, counts)
        n = np.where(t.children[b[k]] > 0, t.children[b[k]], 1)
        into = np.where(t.children[b[k]] > 0, t.child[b[k]], b[k])
        next_a.append(np.repeat(a[k], n))
        next_b.append(np.repeat(into - (np.cumsum(n) - n), n) + np.arange(n.sum()))
        next_bound.append(np.repeat(bound[k], n))
        a, b, bound = (np.concatenate(v) for v in (next_a, next_b, next_bound))
    return sure, open_, looked


def tree_centre(tree: Tree) -> np.ndarray:
    return tree.centre


class Block:
    """A written block: vectors in the order of their tree."""

    def __init__(self, ids: pa.Array, points: np.ndarray, tree: Tree):
        self.ids, self.points, self.tree = ids, points, tree

    @staticmethod
    def build(ids: pa.Array, points: np.ndarray) -> Block:
        tree = Tree(points, LEAF)
        place = np.empty(len(points), np.int64)
        place[tree.order] = np.arange(len(points))
        tree.centre = place[tree.centre]
        return Block(ids.take(pa.array(tree.order)), points[tree.order], tree)

    COLUMNS = "ids array<long>, points binary, dims int, begin binary, end binary, centre binary, child binary, children binary, radius binary"

    def row(self) -> pa.RecordBatch:
        small = self.points.astype(np.int32) if np.abs(self.points).max(initial=0) < 1 << 31 else self.points
        parts = [self.tree.begin, self.tree.end, self.tree.centre, self.tree.child, self.tree.children]
        values = [pa.array([self.ids.to_pylist()], pa.list_(pa.int64())), pa.array([small.tobytes()], pa.binary()), pa.array([self.points.shape[1]], pa.int32())]
        values += [pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in parts] + [pa.array([self.tree.radius.tobytes()], pa.binary())]
        return pa.record_batch(values, names=["ids", "points", "dims", "begin", "end", "centre", "child", "children", "radius"])

    @staticmethod
    def read(row: dict) -> Block:
        tree = Tree.__new__(Tree)
        n, dims = len(row["ids"]), row["dims"]
        tree.begin, tree.end, tree.centre, tree.child, tree.children = (np.frombuffer(row[x], np.int32).astype(np.int64) for x in ("begin", "end", "centre", "child", "children"))
        tree.radius = np.frombuffer(row["radius"], np.float64)
        kind = np.int32 if len(row["points"]) == 4 * n * dims else np.float64
        return Block(row["ids"], np.frombuffer(row["points"], kind).astype(np.float64).reshape(n, dims), tree)

    def sums(self, c: Centroids) -> tuple[np.ndarray, np.ndarray]:
        """For every distinct centroid, how many vectors it gets and their sum."""
        counts, totals = np.zeros(len(c.number), np.int64), np.zeros(c.at.shape, object)
        sure, open_, _ = assign(self.points, self.tree, c)
        small = np.abs(self.points).max(initial=0) * len(self.points) < float(1 << 52)
        whole = self.points if small else exact(self.points)
        if sure:
            begin, end, to = (np.array(x, np.int64) for x in zip(*sure, strict=True))
            run = np.concatenate((np.zeros((1, whole.shape[1]), whole.dtype), np.cumsum(whole, axis=0)))
            np.add.at(counts, to, end - begin)
            self._add(totals, to, run[end] - run[begin])
        if open_:
            at, to, _ = self._nearest(open_, c)
            np.add.at(counts, to, 1)
            self._add(totals, to, whole[at])
        return counts, totals

    @staticmethod
    def _add(totals: np.ndarray, to: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(to, kind="stable")
        starts = np.flatnonzero(np.diff(to[order], prepend=-1))
        part = np.add.reduceat(values[order], starts, axis=0)
        totals[to[order[starts]]] += exact(part)

    def _nearest(self, open_: list[tuple[int, int, np.ndarray]], c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Points, the place of the nearest of their possible centroids, and its squared distance."""
        at, to, far = [], [], []
        # Ranges with the same possible centroids are compared together.
        same: dict[bytes, list[tuple[int, int]]] = {}
        for begin, end, own in open_:
            same.setdefault(np.sort(own).tobytes(), []).append((begin, end))
        for key, ranges in same.items():
            own = np.frombuffer(key, np.int64)
            points = np.concatenate([np.arange(x, y) for x, y in ranges])
            for k in range(0, len(points), 1_024):
                some = points[k : k + 1_024]
                square = squares(self.points[some], c.at[own], c.whole[own])
                first = square.argmin(axis=1)  # the first of equal ones has the smallest number
                at.append(some)
                to.append(own[first])
                far.append(square[np.arange(len(some)), first])
        return tuple(np.concatenate(x) for x in (at, to, far))

    def labels(self, c: Centroids) -> tuple[np.ndarray, list[int]]:
        """For every vector the number of its centroid and the squared distance."""
        sure, open_, _ = assign(self.points, self.tree, c)
        every = [*open_, *((a, b, np.array([to], np.int64)) for a, b, to in sure)]
        label, distance = np.zeros(len(self.points), np.int64), [0] * len(self.points)
        if every:
            at, to, far = self._nearest(every, c)
            label[at] = c.number[to]
            for i, d in zip(at.tolist(), far.tolist(), strict=True):
                distance[i] = d
        return label, distance


def kept(vectors: DataFrame, dims: int, scale: int, vec_id: str, vector: str) -> DataFrame:
    """vec_id and v (whole numbers as doubles) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**400))
    # Scaling by a power of two is exact; beyond 2**52 every double is whole already.
    whole = F.transform(v, lambda x: F.when(F.abs(x * scale) < 2.0**52, F.floor(x * scale).cast("double")).otherwise(x * scale))
    return vectors.where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"))


def planted(rows: DataFrame) -> DataFrame:
    """The trees of all vectors, built in tasks and written."""

    def build(batches):
        ids, parts, n = [], [], 0
        for batch in batches:
            for k in range(0, len(batch), BLOCK):
                some = batch.slice(k, BLOCK)
                ids.append(some.column(0))
                parts.append(matrix(pa.chunked_array([some.column(1)]), len(some)))
                n += len(some)
                if n >= BLOCK:
                    all_ids, points = pa.concat_arrays(ids), np.concatenate(parts)
                    yield Block.build(all_ids[:BLOCK], points[:BLOCK]).row()
                    ids, parts, n = [all_ids[BLOCK:]], [points[BLOCK:]], n - BLOCK
        if n:
            yield Block.build(pa.concat_arrays(ids), np.concatenate(parts)).row()
        release()

    return materialise(bounded_batches(rows).mapInArrow(build, Block.COLUMNS), "cover-trees")


def updated(trees: DataFrame, whole: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: floors of the means of their vectors."""
    dims = len(whole[0])

    def sums(batches):
        c = Centroids(whole)
        counts, totals = np.zeros(len(c.number), np.int64), np.zeros(c.at.shape, object)
        for batch in batches:
            for row in batch.to_pylist():
                n, t = Block.read(row).sums(c)
                counts += n
                totals += t
        used = np.flatnonzero(counts)
        parts = 1
        while any(not -(1 << (PART * parts - 1)) <= x < 1 << (PART * parts - 1) for x in totals[used].ravel()):
            parts += 1
        lists = [[int(counts[j])] for j in used]
        for own, j in zip(lists, used, strict=True):
            for x in totals[j].tolist():
                own += [x >> PART * p & (1 << PART) - 1 if p < parts - 1 else x >> PART * p for p in range(parts)]
        names = [int(c.number[j]) for j in used]
        yield pa.record_batch([pa.array(names, pa.int32()), pa.array([parts] * len(names), pa.int32()), pa.array(lists, pa.list_(pa.int64()))], names=["cluster", "parts", "sums"])
        release()

    each = bounded_batches(trees).mapInArrow(sums, "cluster int, parts int, sums array<long>").select("cluster", "parts", F.posexplode("sums").alias("place", "s"))
    added: dict[tuple, int] = {(r["cluster"], r["parts"], r["place"]): r["s"] for r in each.groupBy("cluster", "parts", "place").agg(F.sum("s").alias("s")).collect()}
    count, total = dict.fromkeys(range(len(whole)), 0), {j: [0] * dims for j in range(len(whole))}
    for (j, parts, place), s in added.items():
        if place == 0:
            count[j] += s
        else:
            total[j][(place - 1) // parts] += s << PART * ((place - 1) % parts)
    return [[x // count[j] for x in total[j]] if count[j] else own for j, own in enumerate(whole)]


def clustered(vectors: DataFrame, first: Column, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part.

    The k vectors that come first by `first` (over vec_id) are the first centroids; the driver holds k * dims integers.
    """
    rows = kept(vectors, dims, scale, vec_id, vector)
    begin = rows.select(first.alias("o"), "v").orderBy(F.asc_nulls_last("o"), "v").limit(k).collect()
    whole = [[int(x) for x in r["v"]] for r in begin]
    kinds = "vec_id long, cluster int, distance long"
    if not whole:
        return rows.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    trees = planted(rows)
    for _ in range(rounds):
        whole = updated(trees, whole)

    def label(batches):
        c = Centroids(whole)
        for batch in batches:
            for row in batch.to_pylist():
                labels, distance = Block.read(row).labels(c)
                fits = [d if d < 1 << 63 else None for d in distance]
                yield pa.record_batch([pa.array(row["ids"], pa.int64()), pa.array(labels, pa.int32()), pa.array(fits, pa.int64())], names=["vec_id", "cluster", "distance"])
        release()

    found = materialise(bounded_batches(trees).mapInArrow(label, kinds), "assigned")
    digests = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(whole)]
    names = rows.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    # A null distance makes the sums over it null.
    total = lambda: F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    by = found.groupBy("cluster").agg(total().alias("s"))
    whole_sum = found.agg(total().alias("all"))
    by = by.join(names, "cluster").crossJoin(whole_sum).select("cluster", F.expr("try_cast(s AS long)").alias("cluster_inertia"), F.expr("try_cast(all AS long)").alias("inertia"), "centroid_sha256")
    # At most k rows.
    return found.join(F.broadcast(by), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int, rounds: int, dims: int) -> str:
    """DuckDB SQL for the same over the table `embeddings`."""
    steps = [
        f"v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings WHERE len(embedding) = {dims} AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256(concat('2:', vec_id))) - 1 AS INT) AS c, v FROM v QUALIFY c < {k})",
    ]
    near = "SELECT vec_id, any_value(v) AS v, min(struct_pack(d, c)) AS m FROM (SELECT vec_id, v.v AS v, c, list_sum([(v.v[i] - o.v[i]) * (v.v[i] - o.v[i]) FOR i IN range(1, {0} + 1)])::BIGINT AS d FROM v, c{1} AS o) GROUP BY vec_id"
    for r in range(rounds):
        steps.append(f"a{r} AS ({near.format(dims, r)})")
        steps.append(f"m{r} AS (SELECT m.c AS c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {dims} + 1) AS t(i) GROUP BY m.c, i)")
        steps.append(f"c{r + 1} AS (SELECT o.c, coalesce(f.v, o.v) AS v FROM c{r} AS o LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM m{r} GROUP BY c) AS f USING (c))")
    steps.append(f"z AS ({near.format(dims, rounds)})")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, m.c AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
  (SELECT sha256(array_to_string(v, ',')) FROM c{rounds} AS o WHERE o.c = z.m.c) AS centroid_sha256
FROM z"""


SQL = sql(40, 5, 64)
