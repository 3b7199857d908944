"""Exact deduplication, hard negatives and centroid rounds beside plain loops."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.llm import dual_tree, exact_dedup, hard_negatives

EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def texts(rng):
    long = "".join(rng.choice("abcdefghij \n") for _ in range(300_000))
    return [None, "", "", "a", "a", "b", long, long, long[:-1], long[:150_000] + "X" + long[150_000:], "é日" * 9_000, "é日" * 9_000, *["hot"] * 40]


def plain(rows):
    groups = {}
    for k, t in rows:
        groups.setdefault(t or "", []).append(k)
    out, seen = [], set()
    for k, t in rows:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        first = (k, t or "") not in seen
        seen.add((k, t or ""))
        out.append((k, keep, len(own), k == keep and first, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_dedup(spark, monkeypatch):
    rng = random.Random(5)
    rows = list(enumerate(texts(rng)))
    rows += [(3, "a"), (3, "a"), (None, "a"), (None, "only"), (70, "only too"), (70, "only too"), (80, "q"), (80, "r")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("z").alias(c) for c in ("recipe", "print", "gw_gone", "gw_gone_", "gw_stays", "kept", "n")]).repartition(5)
    want = plain(rows)
    assert sorted((tuple(r) for r in exact_dedup.assigned(docs).collect()), key=repr) == want
    kept = exact_dedup.keep_last(docs)
    assert kept.columns == docs.columns
    assert sorted([(r.doc_id, r.text or "") for r in kept.collect()], key=repr) == sorted({(k, t or "") for k, t in rows if (k is None and t == "only") or any(w[0] == k and w[3] and w[4] == hashlib.sha256((t or "").encode()).hexdigest() for w in want)}, key=repr)
    # Identifiers that clash under the first seed: verification notices, the second seed decides.
    seeds = []

    def weak(chunk, seed):
        seeds.append(seed)
        return bytes(16) if seed == 0 else exact_dedup.identifier(chunk, seed)

    assert sorted((tuple(r) for r in exact_dedup.assigned(docs, name=weak).collect()), key=repr) == want
    # Prints that all agree, and no room to broadcast them.
    monkeypatch.setattr(exact_dedup, "text_print", lambda text: F.lit(1).cast("long"))
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", 0)
    assert sorted((tuple(r) for r in exact_dedup.assigned(docs, name=weak).collect()), key=repr) == want
    with pytest.raises(ValueError, match="share identifiers"):
        exact_dedup.assigned(docs, name=lambda chunk, seed: bytes(16)).collect()
    assert exact_dedup.assigned(docs.limit(0)).count() == 0 and exact_dedup.keep_last(docs.limit(0)).count() == 0


def test_chunks_depend_on_their_own_text_only():
    import pyarrow as pa

    rng = random.Random(6)
    own = [rng.randbytes(rng.choice((0, 1, 900, 5_000, 60_000, 3_000_000))) for _ in range(12)]
    together = [[bytes(c) for c in x] for x in exact_dedup.chunks(pa.array(own, pa.binary()))]
    for text, parts in zip(own, together, strict=True):
        assert b"".join(parts) == text and all(len(p) <= exact_dedup.MOST for p in parts) and all(len(p) >= exact_dedup.LEAST for p in parts[:-1])
        assert parts == [bytes(c) for c in next(iter(exact_dedup.chunks(pa.array([text], pa.binary()))))]
    # An insertion leaves the chunks far behind it alone.
    changed = [bytes(c) for c in next(iter(exact_dedup.chunks(pa.array([own[-1][:500] + b"!" + own[-1][500:]], pa.binary()))))]
    assert len(own[-1]) < 50_000 or changed[-3:] == together[-1][-3:]


def plain_negatives(rows, positives=5, negatives=3):
    rows = {k: (lab, [math.floor(256 * x) for x in v]) for k, v, lab in rows if v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a, (lab, v) in rows.items():
        if a % 50:
            continue
        score = sorted(((-sum(x * y for x, y in zip(v, w, strict=True)), k, own == lab) for k, (own, w) in rows.items() if k != a))
        for s, p, _ in [x for x in score if x[2]][:positives]:
            fit = [x for x in score if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(a, p, r + 1, k, -s, -t) for r, (t, k, _) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize(("kind", "dims"), [("unit", 16), ("clustered", 8), ("ties", 3), ("large", 12), ("huge", 4)])
def test_hard_negatives(spark, monkeypatch, kind, dims):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 150)
    monkeypatch.setattr(hard_negatives, "TILE", 40)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 5)
    rng = np.random.default_rng(dims)
    n = 700
    v = rng.normal(size=(n, dims))
    if kind == "clustered":
        v = rng.normal(size=(20, dims))[rng.integers(0, 20, n)] + 0.05 * v
    if kind == "ties":
        v = rng.integers(-1, 2, size=(n, dims)) / 64
    v *= {"large": 900, "huge": 400_000}.get(kind, 1)
    v = v.astype(np.float32)
    rows = [(k, x, int(lab)) for k, (x, lab) in enumerate(zip(v.tolist(), rng.integers(0, 4, n), strict=True))]
    rows[50] = (50, None, 1)
    rows[51] = (51, v[51].tolist(), None)
    rows[52] = (52, [float("nan"), *v[52, 1:].tolist()], 1)
    rows[100] = (100, [None, *v[100, 1:].tolist()], 1)
    df = spark.createDataFrame(rows, EMBEDDINGS).select("*", *[F.lit("z").alias(c) for c in ("v", "row", "anchor_id", "band", "score", "block")])
    got = hard_negatives.mine(df.unionByName(df.where("vec_id < 9")), F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows)
    assert sorted(tuple(r) for r in got.collect()) == want and want
    if kind == "unit":
        assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
        odd = [(0, [3e38] * dims, 1), (50, [1.0] * dims, 1), (1, [1.0] * dims, 1), (2, [0.7] * dims, 2), (3, [0.7], 2)]
        assert [tuple(r)[:4] for r in hard_negatives.mine(spark.createDataFrame(odd, EMBEDDINGS), F.col("vec_id") % 50 == 0).collect()] == [(50, 1, 1, 2)]


def test_bit_planes_drop_vectors():
    rng = np.random.default_rng(4)
    v = np.floor(256 * (rng.normal(size=(40, 64))[rng.integers(0, 40, 8_000)] + 0.2 * rng.normal(size=(8_000, 64)))).astype(np.int32)
    q = v[:50]
    best = hard_negatives.Best(np.full((50, 1), -hard_negatives.ANY), np.full((50, 1), hard_negatives.ANY), 5)
    exact = hard_negatives.search(v, np.arange(8_000), q, best, lambda r, c: np.ones(len(r), bool))
    scores = q.astype(np.int64) @ v.T.astype(np.int64)
    assert best.found[0][1].reshape(50, 5).tolist() == (-np.sort(-scores, axis=1)[:, :5]).tolist()
    assert exact < 0.2 * 50 * 8_000


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if j in own else c for j, c in enumerate(centroids)]
    out = [(i, *near(v)) for i, v in kept]
    total, by = sum(d for _, d, _ in out), {}
    for _, d, j in out:
        by[j] = by.get(j, 0) + d
    fits = lambda x: x if x < 1 << 63 else None
    return sorted((i, j, fits(d), fits(by[j]), fits(total), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in out)


@pytest.mark.parametrize("kind", ["unit", "clustered", "ties", "equal", "outlier", "few"])
def test_centroids(spark, monkeypatch, kind):
    monkeypatch.setattr(dual_tree, "BLOCK", 90)
    rng = np.random.default_rng(8)
    dims, n = 6, 5 if kind == "few" else 500
    v = rng.normal(size=(n, dims))
    if kind == "clustered":
        v = 40 * rng.normal(size=(9, dims))[rng.integers(0, 9, n)] + 0.1 * v
    if kind == "ties":
        v = rng.integers(-1, 2, size=(n, dims)) / 128
    if kind == "equal":
        v = np.ones((n, dims)) * (np.arange(n) % 3 == 0)[:, None]
    v = v.astype(np.float32)
    if kind == "outlier":
        v[7] = 2e38
        v[8] = -1e30
    rows = [(k, x, 0) for k, x in enumerate(v.tolist())]
    rows += [(n, None, 0), (n + 1, [1.0], 0), (n + 2, [float("inf")] * dims, 0), (n + 3, [None] * dims, 0), (3, v[3].tolist(), 0)]
    df = spark.createDataFrame(rows, EMBEDDINGS).select("*", *[F.lit("z").alias(c) for c in ("v", "cluster", "distance", "o", "inertia")]).repartition(3)
    first = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    got = dual_tree.clustered(df, first, k=12, rounds=3, dims=dims)
    if kind == "outlier":  # some vectors' cluster holds distances beyond a long, which are null
        want = plain_clusters(rows, 12, 3, dims)
        assert sorted((r.vec_id, r.cluster, r.centroid_sha256) for r in got.collect()) == [(w[0], w[1], w[5]) for w in want]
        assert sorted((r.vec_id, r.distance) for r in got.collect() if r.distance is not None) == [(w[0], w[2]) for w in want if w[2] is not None]
        return
    assert sorted(tuple(r) for r in got.collect()) == plain_clusters(rows, 12, 3, dims)
    assert dual_tree.clustered(df.limit(0), first, dims=dims).count() == 0


def test_cover_tree_and_pruning():
    rng = np.random.default_rng(9)
    points = 50 * rng.normal(size=(30, 16))[rng.integers(0, 30, 2_000)] + rng.normal(size=(2_000, 16))
    tree = dual_tree.Tree(points, dual_tree.LEAF)
    assert sorted(tree.order) == list(range(2_000))
    for node in range(len(tree.begin)):
        own = points[tree.order[tree.begin[node] : tree.end[node]]]
        centre = points[tree.centre[node]]
        assert np.linalg.norm(own - centre, axis=1).max() <= tree.radius[node] * (1 + 1e-9) + 1e-9
        kids = range(tree.child[node], tree.child[node] + tree.children[node])
        if kids:
            centres = points[tree.centre[list(kids)]]
            apart = np.linalg.norm(centres[:, None] - centres[None], axis=2) + 1e9 * np.eye(len(centres))
            assert tree.centre[kids[0]] == tree.centre[node] and apart.min() > tree.radius[node] / 2 * (1 - 1e-9)
            assert sum(tree.end[k] - tree.begin[k] for k in kids) == len(own)
    import pyarrow as pa

    whole = np.floor(256 * points)
    block = dual_tree.Block.build(pa.array(range(2_000)), whole)
    c = dual_tree.Centroids([[int(x) for x in whole[k]] for k in rng.integers(0, 2_000, 200)])
    sure, open_, looked = dual_tree.assign(block.points, block.tree, c)
    assert sum(b - a for a, b, *_ in sure) + sum(b - a for a, b, _ in open_) == 2_000
    compared = sum((b - a) * len(own) for a, b, own in open_)
    assert looked + compared < 0.3 * 2_000 * len(c.number)  # of all pairs
