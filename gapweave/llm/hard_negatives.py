"""Hard negatives by bit-sliced integer products.

Every component x becomes the integer floor(SCALE * x); a row's score is its integer inner product with an anchor. An
anchor's positives are its best rows of the same label; for every positive, its hard negatives are the best rows of other
labels whose score lies between two shares of the positive's score.

Integers are kept as two's complement bit planes. Products are worked out plane by plane, the most significant first:
after each plane the unknown rest of a component lies between 0 and 2**p - 1, so the score lies in an interval that the
anchor's positive and negative components bound. A vector is dropped for an anchor once its interval lies below or above
all that can still qualify there: below the bands of the anchor's positives or the worst of the rows found so far, or
above all bands. Vectors and anchors without an open pair leave the remaining planes, and once few pairs are open these
are carried on one by one. What is left after the last plane has its exact score.

Anchors meet all rows block by block (see vector_blocks); blocks are in order of labels, and a window keeps the best of all
blocks. Products are exact: in single or double precision while all partial sums are exact there, else in 64-bit integers.

Rows with a null id, label or vector, with a null or non-finite component, with another length than most, or with a
component of 2**22 / sqrt(length) or more (whose scores may not fit in a long) take no part. Of rows with equal ids the one with the
smallest label and vector does. Ties go to the smaller id. An anchor with fewer rows of its label or in a band gets all there
are; anchors without positives, and positives without negatives, give no rows. An empty table gives no rows. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapweave.llm.common import materialise
from gapweave.llm.vector_blocks import dealt, matrix, packed, paired

SCALE = 256
#: Vectors of a block, and of those looked at together; anchors of a block.
BLOCK_ROWS, TILE, ANCHORS = 8_192, 1_024, 1_024
#: Below this share of open pairs of a tile, they are carried on one by one.
SPARSE = 1 / 64
#: No score is as large.
ANY = 1 << 62


def usable(rows: DataFrame, vec_id: str, label: str, vector: str) -> DataFrame:
    """vec_id, label and v (integers) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    most = float(1 << 22) / F.sqrt(F.size(v))
    fine = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < most))
    numbers = F.transform(v, lambda x: F.floor(x * SCALE).cast("int"))
    each = rows.where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.struct(F.col(label).cast("long").alias("label"), numbers.alias("v")).alias("row"))
    return each.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.v")


class Best:
    """The best k rows of each (anchor, band) so far."""

    def __init__(self, lows: np.ndarray, highs: np.ndarray, k: int):
        self.lows, self.highs, self.k = lows, highs, k
        none = np.zeros(0, np.int64)
        self.found = {b: (none, none, none) for b in range(lows.shape[1])}  # anchor, score, id; by anchor, best first
        self.floors = lows.copy()  # a row needs such a score at least

    def add(self, anchors: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        for b in self.found:
            fits = (scores >= self.floors[anchors, b]) & (scores <= self.highs[anchors, b])
            if fits.any():
                a, s, i = (np.concatenate((x, y[fits])) for x, y in zip(self.found[b], (anchors, scores, ids), strict=True))
                order = np.lexsort((i, -s, a))
                a, s, i = a[order], s[order], i[order]
                place = np.arange(len(a)) - np.searchsorted(a, a)
                self.found[b] = a[place < self.k], s[place < self.k], i[place < self.k]
                last = place == self.k - 1
                self.floors[a[last], b] = s[last]  # equal scores stay in, for smaller ids


def sliced(v: np.ndarray, q: np.ndarray) -> tuple[int, int, type]:
    """The number of planes of all components of v, a bound of all partial sums of its products with q, and a type in which those are exact."""
    bits = int(max(int(v.max(initial=0)), ~int(v.min(initial=0)), 0)).bit_length() + 1
    most = (int(np.abs(q.astype(np.int64)).sum(axis=1).max(initial=0)) << (bits - 1)) + 1
    return bits, most, np.float32 if most < 1 << 22 else np.float64 if most < 1 << 51 else np.int64


def search(v: np.ndarray, ids: np.ndarray, q: np.ndarray, best: Best, allowed) -> int:
    """Adds to `best` what qualifies among the rows of v; allowed(rows, anchors) sorts out pairs. Returns the number of exact scores."""
    exact = 0
    bits, most, kind = sliced(v, q)
    # A component is -2**(bits-1) * sign + the sum of 2**p * plane p.
    q = q.astype(kind)
    above, below = np.maximum(q, 0).sum(axis=1), np.minimum(q, 0).sum(axis=1)
    upto = np.clip(best.highs.max(axis=1, initial=-ANY), -most, most).astype(kind)
    for t in range(0, len(v), TILE):
        tile = v[t : t + TILE]
        least = np.where(best.lows <= best.highs, best.floors, ANY).min(axis=1, initial=ANY)
        least = np.clip(least, -most, most).astype(kind)
        rows, cols = np.arange(len(tile)), np.arange(len(q))
        score = np.zeros((len(rows), len(cols)), kind)
        open_: np.ndarray | None = None
        for p in range(bits - 1, -1, -1):
            weight = -(1 << p) if p == bits - 1 else 1 << p
            plane = ((tile[rows] >> p) & 1).astype(kind)
            score += plane @ (q[cols] * kind(weight)).T
            rest = kind((1 << p) - 1)
            open_ = (score >= least[cols] - rest * above[cols]) & (score <= upto[cols] - rest * below[cols])
            if p == 0:
                break
            here = np.count_nonzero(open_)
            if here <= SPARSE * len(tile) * len(q):
                break
            keep_r, keep_c = open_.any(axis=1), open_.any(axis=0)
            if keep_r.mean() * keep_c.mean() < 0.5:
                rows, cols, score = rows[keep_r], cols[keep_c], score[np.ix_(keep_r, keep_c)]
        r, c = np.nonzero(open_)
        at, of, s = rows[r], cols[c], score[r, c]
        for p in range(p - 1, -1, -1):  # the few open pairs, one by one
            if not len(at):
                break
            s = s + (1 << p) * np.einsum("ij,ij->i", ((tile[at] >> p) & 1).astype(kind), q[of])
            rest = kind((1 << p) - 1)
            stay = (s >= least[of] - rest * above[of]) & (s <= upto[of] - rest * below[of])
            at, of, s = at[stay], of[stay], s[stay]
        exact += len(at)
        fine = allowed(t + at, of)
        best.add(of[fine], s[fine].astype(np.int64), ids[t + at[fine]])
    return exact


def result(best: Best, anchor_ids: np.ndarray) -> pa.Table:
    parts = [(anchor_ids[a], np.full(len(a), b), i, s) for b, (a, s, i) in best.found.items()]
    return pa.table(dict(zip(("anchor_id", "band", "vec_id", "score"), (np.concatenate(x) for x in zip(*parts, strict=True)), strict=True)))


FOUND = "anchor_id long, band long, vec_id long, score long"


def positives_of(asked: pa.Table, stored: pa.Table, k: int) -> pa.Table:
    """The best k other rows of the same label, within a block."""
    q, v = matrix(asked["v"], len(asked)), matrix(stored["v"], len(stored))
    ids, anchor_ids = stored["vec_id"].to_numpy(), asked["vec_id"].to_numpy()
    labels, wanted = stored["label"].to_numpy(), asked["label"].to_numpy()  # both in ascending order
    out = []
    for label in np.intersect1d(labels, wanted):
        a, b = np.searchsorted(labels, [label, label + 1])
        c, d = np.searchsorted(wanted, [label, label + 1])
        best = Best(np.full((d - c, 1), -ANY), np.full((d - c, 1), ANY), k)
        search(v[a:b], ids[a:b], q[c:d], best, lambda r, o, a=a, c=c: ids[a + r] != anchor_ids[c + o])
        out.append(result(best, anchor_ids[c:d]))
    return pa.concat_tables(out) if out else result(Best(np.zeros((0, 1), np.int64), np.zeros((0, 1), np.int64), k), anchor_ids)


def negatives_of(asked: pa.Table, stored: pa.Table, k: int, least: int, most: int) -> pa.Table:
    """The best k rows of other labels in the band of each positive, within a block."""
    q, v = matrix(asked["v"], len(asked)), matrix(stored["v"], len(stored))
    scores = asked["scores"].to_pylist()
    wide = max(map(len, scores), default=0)
    lows, highs = np.ones((len(q), wide), np.int64), np.zeros((len(q), wide), np.int64)  # an empty band
    for i, own in enumerate(scores):
        for b, s in enumerate(own):
            lows[i, b], highs[i, b] = -((-least * s) // 100), most * s // 100
    best = Best(lows, highs, k)
    labels, own = stored["label"].to_numpy(), asked["label"].to_numpy()
    search(v, stored["vec_id"].to_numpy(), q, best, lambda r, o: labels[r] != own[o])
    return result(best, asked["vec_id"].to_numpy())


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores; bands go from `least` to `most` hundredths of a positive's score.

    `is_anchor` may name vec_id and label only.
    """
    all_rows = materialise(usable(rows, vec_id, label, vector), "labelled-vectors")
    shape = all_rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    all_rows = all_rows if shape is None else all_rows.where(F.size("v") == shape["dims"])
    order = F.col("label"), F.col("vec_id")
    stored = packed(all_rows, "vector-blocks", BLOCK_ROWS, dealt(all_rows, BLOCK_ROWS), *order)
    anchors = materialise(all_rows.where(is_anchor), "anchors")

    def best(found: DataFrame, k: int) -> DataFrame:
        ranked = Window.partitionBy("anchor_id", "band").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)

    near = paired(packed(anchors, "anchor-blocks", ANCHORS, dealt(anchors, ANCHORS), *order), stored, lambda a, s: positives_of(a, s, positives), FOUND)
    near = materialise(best(near, positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).cast("long").alias("band")), "positives")
    bands = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("band", "positive_score")))["positive_score"].alias("scores"))
    asked = materialise(anchors.join(bands, anchors["vec_id"] == bands["anchor_id"]).drop("anchor_id"), "anchors-with-bands")
    hard = best(paired(packed(asked, "banded-anchor-blocks", ANCHORS, dealt(asked, ANCHORS), *order), stored, lambda a, s: negatives_of(a, s, negatives, least, most), FOUND), negatives)
    return hard.join(near, ["anchor_id", "band"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, list_sum([a.v[i] * e.v[i] FOR i IN range(1, len(e.v) + 1)])::BIGINT AS score
  FROM e AS a JOIN e ON e.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 3
"""
