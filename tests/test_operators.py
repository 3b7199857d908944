"""Ordered and stateful operators against plain Python, and functions against known values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.functions import text as T
from gapweave.functions.vector import cosine
from gapweave.operators import graph, replay, retrieval
from gapweave.plans import skills
from gapweave.sources.views import Domain
from gapweave.streaming import replay as stream

SF = "/root/testdata/sf0.001"


def test_weeks(spark):
    rows = [(1, 1, 10, 100), (1, 2, 11, 200), (1, 3, 12, 0), (1, 4, 13, 500), (1, 5, 14, 20)]
    plan = graph.packed(spark.createDataFrame(rows, "employee_id long, position int, course_id long, duration_minutes int"), 4)
    got = sorted((r.week, r.position, r.minutes, r.continued) for r in plan.collect())
    assert got == [(1, 1, 100.0, False), (2, 2, 200.0, False), (2, 3, 0.0, False), (3, 4, 240.0, False), (4, 4, 240.0, True), (5, 4, 20.0, True), (5, 5, 20.0, False)]


def test_order_and_cycles(spark):
    kept = spark.createDataFrame([(1, c) for c in (1, 2, 3, 4)], "employee_id long, course_id long")
    edges = spark.createDataFrame([(1, 2), (3, 2)], "course_id long, prerequisite_id long")
    priority = spark.createDataFrame([(1, 3, 5), (1, 4, 1)], "employee_id long, course_id long, priority long")
    got = [r.course_id for r in graph.topological(kept, edges, priority).orderBy("position").collect()]
    assert got == [4, 2, 3, 1]
    loop = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "course_id long, prerequisite_id long")
    assert {r.course_id for r in graph.on_cycles(loop).collect()} == {1, 2}
    more = loop.unionAll(spark.createDataFrame([(4, 4), (5, 6), (6, 7), (7, 5), (7, 8), (9, 5)], loop.schema))
    assert {r.course_id for r in graph.on_cycles(more).collect()} == {1, 2, 4, 5, 6, 7}
    assert {r.course_id: r.path for r in graph.cycle_paths(more).collect()} == {1: [1, 2, 1], 4: [4, 4], 5: [5, 6, 7, 5]}
    with pytest.raises(Exception, match="wait for each other"):
        graph.topological(kept, loop, priority).collect()


def test_stream_replays_like_the_batch(spark, tmp_path):
    d = Domain(spark, SF)
    records = d["training_record"].select("record_id", "employee_id", "course_id", "exam_score")
    records.repartition(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(records.schema).parquet(str(tmp_path / "in"))
    q = stream.levels(source, d["course"], d["teaches"], d["has_skill"]).writeStream.format("memory").queryName("levels").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table("levels").groupBy("employee_id", "skill_id").agg(F.max_by(F.struct("level", "flagged"), "record_id").alias("s")).select("employee_id", "skill_id", "s.*")
    batch = replay.steps(d["training_record"], d["course"], d["teaches"], d["has_skill"])
    batch = batch.groupBy("employee_id", "skill_id").agg(F.max_by(F.struct("to_level", "flagged"), "record_id").alias("s")).select("employee_id", "skill_id", "s.*")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, batch.collect()))


def test_functions(spark):
    row = spark.range(1).select(
        T.label(F.lit("  A  b;")).alias("label"),
        T.normalized(F.lit("C++ / Machine-Learning!")).alias("normalized"),
        T.rerank_tokens(F.lit("AI 学习,路径")).alias("tokens"),
        T.html_text(F.lit("<p>a &amp;lt; b</p>")).alias("html"),
        T.minutes(F.lit("01:02:03")).alias("minutes"),
        T.hours_per_week(F.lit("每周 5 小时")).alias("hours"),
        T.slug(F.lit("Hello, World!")).alias("slug"),
        cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))).alias("zero"),
    ).first()
    assert (row.label, row.normalized, row.slug, row.minutes, row.hours, row.zero) == ("a b", "cplusplus machine learning", "hello-world", 63, 5.0, 0.0)
    assert row.tokens == ["ai", "学习", "习路", "路径"] and row.html == "a &lt; b"


def test_every_vector_gets_neighbours(spark):
    rows = Domain(spark, SF)["embeddings"].select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    ids = np.array([r.vec_id for r in rows])
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    s = np.rint(x @ x.T * 1e6)
    want = {}
    for k, own in enumerate(ids):
        best = [j for j in np.lexsort((ids, -s[k])) if ids[j] != own][:4]
        want[own] = [(ids[j], s[k, j] / 1e6) for j in best]
    got = {}
    for r in skills.QUERIES["vector_neighbours"](spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want
    few = spark.createDataFrame([(k, [float(k % 3), 1.0]) for k in range(7)] + [(7, [0.0, 0.0]), (8, [1.0]), (None, [1.0, 1.0])], "id long, v array<double>")
    one, blocks = (sorted(map(tuple, retrieval.vector_top(few, few, "id", "v", 3, block_rows=n).collect())) for n in (100, 2))
    assert one == blocks and len(one) == 27


def test_course_queries_reach_the_whole_catalogue(spark):
    sf = "/root/testdata/sf0.01"
    d = Domain(spark, sf)
    all_courses = {r[0] for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect()}
    assert len(all_courses) == 2_000
    for name in ("course", "teaches"):
        assert {r[0] for r in d[name].select("course_id").distinct().collect()} == all_courses, name
    recorded = {r[0] for r in d["training_record"].select("course_id").distinct().collect()}
    assert len(recorded & all_courses) > 0.95 * len(all_courses) and recorded - all_courses
    assert max(r[0] for r in skills.QUERIES["prereq_chain"](spark, sf).select("course_id").collect()) >= 1_995
    recalled = {r[0] for r in skills.QUERIES["candidate_recall"](spark, sf).select("course_id").distinct().collect()}
    lacking = {r[0] for r in skills.QUERIES["gap_list"](spark, sf).select("skill_id").distinct().collect()}
    assert recalled == {r.course_id for r in d["teaches"].collect() if r.skill_id in lacking} and len(recalled) > 0.5 * len(all_courses)
    assert skills.QUERIES["topo_order"](spark, SF).count() == skills.QUERIES["prune_expand"](spark, SF).where("kept").count()


def test_chains_carry_pairs(spark):
    edges = spark.createDataFrame([(k + 1, k // 3 * 3 + j) for k in range(2, 60, 3) for j in range(-2, 1) if k // 3 * 3 + j > 0] + [(2, 1), (3, 2), (3, 1)], "course_id long, prerequisite_id long").where("course_id > prerequisite_id").distinct()
    near = {}
    for r in edges.collect():
        near.setdefault(r.course_id, set()).add(r.prerequisite_id)
    longest = {}

    def walk(course):
        out = {}
        for p in near.get(course, ()):
            out[p] = max(out.get(p, 0), 1)
            for x, n in walk(p).items():
                out[x] = max(out.get(x, 0), n + 1)
        return out

    for c in near:
        longest |= {(c, a): n for a, n in walk(c).items()}
    assert {(r.course_id, r.ancestor_id): r.depth for r in graph.chains(edges).collect()} == longest
