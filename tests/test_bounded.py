"""Work whose memory must not follow the input: bounded batches, a task's best hits, bounds on digests."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gapweave.operators import documents, learning, retrieval


def test_skill_questions_bound_digests(spark, monkeypatch):
    """Skills that nearly all courses teach have few others below the bound and are worked out with all."""
    monkeypatch.setattr(learning, "COURSES_OF_TASK", 100)
    monkeypatch.setattr(learning, "SPARE", 2)
    courses = spark.range(400).select(F.col("id").alias("course_id"), F.array(F.concat(F.lit("o"), "id")).alias("objectives"))
    teaches = spark.range(400).where("id % 40 > 0").select(F.lit("common").alias("skill_id"), F.col("id").alias("course_id")).unionAll(spark.range(5).select(F.lit("rare"), "id"))
    pairs = {(r.skill_id, r.course_id) for r in teaches.collect()}
    want = set()
    for s in ("common", "rare"):
        left = sorted((hashlib.md5(f"{s}|{c}".encode()).hexdigest(), c) for c in range(400) if (s, c) not in pairs)
        want |= {(s, c, n) for n, (_, c) in enumerate(left[:15], 1)}
    found = learning.smallest_others(courses, teaches.distinct(), 15)
    assert {(r.skill_id, r.course_id, r.n) for r in found.collect()} == want
    # Only the rows that a bound leaves are sorted.
    rare = learning.smallest_others(courses, teaches.where("skill_id = 'rare'").distinct(), 15)
    assert {(r.course_id, r.n) for r in rare.collect()} == {(c, n) for s, c, n in want if s == "rare"}


def test_matched_resources_make_no_rows_of_what_goes(spark):
    resources = spark.createDataFrame([(k, [f"s{k % 3}", f"s{k % 5}"]) for k in range(60)] + [(None, ["s1"]), (7, ["s1"])], "resource_id long, skills array<string>")
    gaps = spark.createDataFrame([(e, f"s{j}") for e in (1, 2, None) for j in range((e or 0) + 2)] + [(1, "s1")], "employee_id long, skill_id string")
    got = learning.matched_resources(gaps, resources, 4)
    assert "windowspecdefinition(employee_id" not in got._jdf.queryExecution().toString()
    rows = [(r.resource_id, s) for r in resources.collect() for s in r.skills]
    want = set()
    for e in (1, 2, None):
        own = {r for g in gaps.collect() if g.employee_id == e for r, s in rows if s == g.skill_id}
        want |= {(e, r, n) for n, r in enumerate(sorted(own, key=lambda x: -1 if x is None else x)[:4], 1)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_chunks_come_in_bounded_batches(spark, monkeypatch):
    """Rows go on after BATCH_CHARS characters, and long before a whole partition is read."""
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.createDataFrame([(k, "# T\n\n" + "x" * 300 + "\n\n" + "y" * 700 if k % 7 else None) for k in range(5000)], "doc_id long, text string").coalesce(1)
    got = documents.chunks(docs)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
    assert {(r.doc_id, r.chunk_index, len(r.content)) for r in got.collect()} == {(str(k), j, n) for k in range(5000) if k % 7 for j, n in enumerate((300, 700))}


def test_encoder_equals_the_sql_form(spark):
    """Vectors of words seen once or often, longer and shorter than grams, of other planes, with a memory of few grams."""
    texts = ["", "a", "a a a", "ab ab c", "Straße 𝒳𝒴𝒵 中文字符 中文", "aaaa bbbbb aaaa", " x\ty\n", "ab" * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    want = np.zeros((len(texts), retrieval.DIMS))
    for r in retrieval.lexical_vectors(rows, "k", "t").collect():
        want[r.k, r.dim] = r.value
    assert np.allclose(retrieval.lexical_encoder()(texts), want)
    for name, most in (("MOST_GRAMS", 4), ("MOST_WORDS", 2), ("STEP_FEATURES", 3)):
        old, encode = getattr(retrieval, name), retrieval.lexical_encoder()
        try:
            setattr(retrieval, name, most)
            assert all(np.allclose(encode([t])[0], want[k]) for k, t in enumerate(texts)) and np.allclose(encode(texts), want)
        finally:
            setattr(retrieval, name, old)


def test_tasks_hand_on_only_their_best_hits(spark):
    """Before, every batch handed on k rows for each query."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(k, [float(x) for x in rng.integers(-2, 3, 3)]) for k in range(600)], "id long, v array<double>").coalesce(1)
    hits = retrieval.block_hits(vectors.where("id % 60 = 0"), vectors, "id", 4)
    assert hits.count() == 10 * 4
    ids, x = zip(*sorted((r.id, r.v) for r in vectors.collect()))
    x = np.array(x)
    unit = np.divide(x, np.linalg.norm(x, axis=1)[:, None], out=np.zeros_like(x), where=np.linalg.norm(x, axis=1)[:, None] > 0)
    score = np.rint(unit @ unit.T * 1e6)
    want = {(q, v, score[q, v] / 1e6) for q in range(0, 600, 60) for v in sorted((v for v in ids if v != q), key=lambda v: (-score[q, v], v))[:4]}
    assert {(r.query_id, r.id, r.score) for r in hits.collect()} == want
    texts = spark.createDataFrame([(k, f"w{k % 40} common") for k in range(400)], "id long, t string").coalesce(1)
    found = retrieval.lexical_block(texts.where("id < 3").selectExpr("id AS q", "t"), "q", texts, "id", 2)
    assert sorted((r.q, r.id) for r in found.collect()) == [(0, 0), (0, 40), (1, 1), (1, 41), (2, 2), (2, 42)]


def test_held_keeps_the_best_over_all_batches():
    held, rng, all_ = retrieval.Held(3, 5), np.random.default_rng(1), []
    held.most = 40
    for _ in range(30):
        row, key, score = rng.integers(0, 3, 20), rng.permutation(10_000)[:20], rng.integers(0, 6, 20).astype(float)
        held.add(row, pa.array(key), np.arange(20), score)
        all_ += list(zip(row.tolist(), (-score).tolist(), key.tolist()))
        assert held.size <= 60
    row, keys, score = held.best()
    got = list(zip(row.tolist(), (-score).tolist(), keys.to_pylist()))
    assert got == [x for r in range(3) for x in sorted(y for y in all_ if y[0] == r)[:5]]


def test_ingested_texts_are_packed_closely(spark, tmp_path):
    from gapweave.operators import ingestion

    kept = ingestion.tables_at(spark, f"file://{tmp_path}/t")
    ingestion.refresh(kept, spark.createDataFrame([(1, "# A\n\none"), (2, None)], "doc_id long, text string"))
    files = [f.name for f in (tmp_path / "t" / "chunks").rglob("part-*.parquet")]
    assert files and all(".zstd." in f for f in files)
    assert [(r.doc_id, r.content) for r in kept["chunks"].read().collect()] == [("1", "one")]
