"""Golden values of texts, plans and stores, and odd rows beside the domain operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gapweave import api
from gapweave.functions import text as T
from gapweave.operators import checks, documents, gap, graph, learning, normalise, recall, replay, retrieval, store
from gapweave.plans import skills
from gapweave.sources import readers
from gapweave.sources.scratch import materialise, purge
from gapweave.sources.views import Domain

SF = "/root/testdata/sf0.001"

NAMES = {
    "  Machine   Learning ": "machine learning", "PYTHON": "python", "Machine-Learning": "machine learning", "RAG/检索增强生成": "rag检索增强生成", "AI, Machine Learning": "ai machine learning",
    "generative-a.i.": "generative ai", "ＧｅｎＡＩ": "genai", "ＳＱＬ查询": "sql查询", "C++": "cplusplus", "c#": "csharp", "F# ": "fsharp", ".NET": "dotnet", "Node.js": "nodejs", "vue.js": "vuejs", "Python Skills": "python",
    "Docker 技术": "docker", "技能: Python": "python", "生成式 AI": "生成式ai", "机器 学习": "机器学习", "Python 编程": "python编程", "": "", "   ": "", "技能": "", "c++x": "cplusplus x", "skillset": "skillset",
}


def test_names(spark):
    df = spark.createDataFrame(list(NAMES.items()), "raw string, want string")
    once = df.withColumn("got", T.normalized(F.col("raw"))).withColumn("again", T.normalized(F.col("got")))
    for r in once.collect():
        assert r.got == r.want == r.again, r
    assert spark.createDataFrame([(None,)], "raw string").select(T.normalized(F.col("raw"))).first()[0] is None


def test_sections():
    text = "# Title #\nintro\n## One\n\n```python\n# no heading\n~~~\n```\n### Two\nbody\n## Three\n####### no\n"
    title, found = documents.outline(text)
    assert title == "Title" and [(h, n) for h, n, _ in found] == [(None, 0), ("One", 2), ("Two", 3), ("Three", 2)]
    assert list(documents.paths(found)) == [[], ["One"], ["One", "Two"], ["Three"]] and "# no heading" in found[1][2]
    assert documents.outline("## only\ntext") == ("only", [(None, 0, "text")]) and documents.outline("") == (None, [(None, 0, "")])


def test_pieces():
    sentences = "".join(f"这是第{k}句话,内容足够长一些。" for k in range(30))
    got = list(documents.pieces(sentences, 100))
    assert len(got) >= 3 and "".join(got) == sentences and all(len(x) <= 100 and x.endswith("。") for x in got)
    assert list(documents.pieces("x" * 250, 100)) == ["x" * 100, "x" * 100, "x" * 50]
    assert list(documents.pieces("aa\n\nbb  b\nc\n\n" + "d" * 20, 10)) == ["aa\nbb b c", "d" * 10, "d" * 10]
    assert list(documents.pieces("a" * 5 + "\n\n" + "b" * 5, 10)) == ["a" * 5, "b" * 5] and list(documents.pieces(" \n ", 10)) == []


def test_documents_with_odd_rows(spark):
    docs = spark.createDataFrame([(1, "# T\nab"), (1, "# T\nab"), (2, None), (None, "x"), (3, "")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.title, r.content) for r in documents.chunks(docs).collect()) == [("1", "T", "ab"), ("1", "T", "ab"), ("None", None, "x")]
    assert documents.sections(docs).count() == 5 and documents.sections(docs.limit(0)).count() == 0
    assert {r.doc_id for r in documents.without_chunks(docs, documents.chunks(docs)).collect()} >= {"2", "3"}
    with pytest.raises(ValueError, match="max_chars"):
        documents.chunks(docs, max_chars=0)


def weeks(spark, minutes, hours):
    rows = [(1, k + 1, k, m) for k, m in enumerate(minutes)]
    plan = graph.packed(spark.createDataFrame(rows, "employee_id long, position int, course_id long, duration_minutes int"), hours)
    return [(r.week, r.course_id, r.minutes) for r in plan.orderBy("week", "position").collect()]


def test_weeks_by_the_book(spark):
    assert weeks(spark, [70, 50, 90], 2.0) == [(1, 0, 70.0), (1, 1, 50.0), (2, 2, 90.0)]
    assert weeks(spark, [120, 30], 2.0) == [(1, 0, 120.0), (2, 1, 30.0)]
    assert weeks(spark, [60, 90, 60], 2.0) == [(1, 0, 60.0), (2, 1, 90.0), (3, 2, 60.0)]
    assert weeks(spark, [60, 300], 2.0) == [(1, 0, 60.0), (2, 1, 120.0), (3, 1, 120.0), (4, 1, 60.0)]
    assert weeks(spark, [200], 1.5) == [(1, 0, 90.0), (2, 0, 90.0), (3, 0, 20.0)]
    assert weeks(spark, [0, 60], 1.0) == [(1, 0, 0.0), (1, 1, 60.0)]
    with pytest.raises(ValueError, match="hours_per_week"):
        weeks(spark, [60], 0)


def test_gaps_of_odd_rows(spark):
    employee = spark.createDataFrame([(1, 5), (2, None), (3, 6), (None, 5)], "employee_id long, target_position_id long")
    requires = spark.createDataFrame([(5, "a", 3, 2), (5, "b", 5, 3), (5, "c", 5, 0), (5, "d", 4, 1)], "position_id long, skill_id string, importance int, required_level int")
    has = spark.createDataFrame([(1, "a", 4), (1, "c", 1), (1, "x", 2), (2, "a", 1), (None, "b", 3)], "employee_id long, skill_id string, level int")
    req = gap.requirements(employee, requires, has)
    assert sorted((r.employee_id, r.skill_id, r.gap, r.weighted_gap) for r in gap.gaps(req).where("employee_id = 1").collect()) == [(1, "b", 3, 15), (1, "d", 1, 4)]
    assert {r.employee_id: r.readiness for r in gap.readiness(employee, req).where("employee_id IS NOT NULL").collect()} == {1: 0.24, 2: 1.0, 3: 1.0}
    assert sorted((r.employee_id, r.skill_id) for r in gap.extra(employee, requires, has).collect()) == [(1, "x"), (2, "a")]
    assert [r.skill_id for r in gap.met(req).where("employee_id = 1").collect()] == ["a"]
    assert [r.skill_id for r in learning.ordered(gap.gaps(req)).where("employee_id = 1").orderBy("place").collect()] == ["b", "d"]


def test_replay_ties_and_unknown_courses(spark):
    course = spark.createDataFrame([(1, "beginner"), (2, "beginner")], "course_id long, difficulty string")
    teaches = spark.createDataFrame([(1, "a"), (2, "a")], "course_id long, skill_id string")
    none = spark.createDataFrame([], "employee_id long, skill_id string, level int")
    records = spark.createDataFrame([(1, 7, 1, 70), (2, 7, 1, 60), (3, 7, 2, 90), (4, 7, 9, 90), (5, 8, 2, 10)], "record_id long, employee_id long, course_id long, exam_score int")
    steps = replay.steps(records, course, teaches, none)
    assert [(r.record_id, r.from_level, r.to_level, r.flagged) for r in steps.orderBy("record_id").collect()] == [(1, 0, 1, True), (2, 1, 1, True), (3, 1, 1, False), (5, 0, 0, False)]
    assert [(r.record_id, r.kind) for r in replay.changes(steps).orderBy("record_id").collect()] == [(1, "raised"), (3, "cleared"), (5, "failed")]
    assert [r.record_id for r in replay.unknown_courses(records, course).collect()] == [4]
    assert replay.steps(records.limit(0), course, teaches, none).count() == 0


def test_normalisation_cascade(spark):
    labels = spark.createDataFrame([("S1", "Machine Learning"), ("S1", "ML"), ("S2", "Python"), ("S3", "ml skills"), ("S4", None)], "skill_id string, label string")
    names = spark.createDataFrame([("machine-learning",), ("Python 3",), ("cooking",), (None,), ("ml",), ("learning machine",)], "raw string")
    got = {r.raw: (r.skill_id, r.method) for r in normalise.cascade(names, labels).collect()}
    assert got == {"machine-learning": ("S1", "alias"), "Python 3": ("S2", "embedding"), "cooking": (None, None), None: (None, None), "ml": ("S3", "alias"), "learning machine": ("S1", "embedding")}
    assert [(r.alias, r.skills) for r in normalise.alias_conflicts(labels).collect()] == [("ml", ["S1", "S3"])]
    refused = normalise.cascade(names, labels, verdict=lambda raw, near: F.when(raw == "Python 3", F.lit(""))).where("raw = 'Python 3'").first()
    assert (refused.skill_id, refused.method) == (None, None)
    assert sorted(tuple(r) for r in normalise.summary(normalise.cascade(names.limit(0), labels)).collect()) == [("matched", None, 0, 0.0), ("total", None, 0, 0.0)]
    counted = {(r.kind, r.name): (r.n, r.share) for r in normalise.summary(normalise.cascade(names, labels)).collect()}
    assert counted[("total", None)] == (6, 1.0) and counted[("matched", None)] == (4, 0.6667) and counted[("skill", "S1")] == (2, 0.3333) and counted[("unmatched", "cooking")] == (1, 0.1667)


def test_names_resolve_like_a_plain_search(spark):
    items = [("i1", "Introduction to AI concepts", ["ai basics"]), ("i2", "AI", None), ("i3", "Data tools", ["tools for data work"]), ("i4", "Advanced data tools", [])]
    keys = ["i3", "AI Concepts", "ai", "AI basics", "data work tools", "zzz", "", None, "  Data  Tools. ", "a"]
    got = {r.key: (r.item_id, r.tier) for r in retrieval.resolved(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame(items, "item_id string, name string, aliases array<string>")).collect()}
    assert got == {"i3": ("i3", 1), "AI Concepts": ("i2", 4), "ai": ("i2", 2), "AI basics": ("i1", 3), "data work tools": ("i3", 5), "zzz": (None, None), "": (None, None), None: (None, None), "  Data  Tools. ": ("i3", 2), "a": ("i2", 4)}


def test_stores(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "n")], "k long, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w"), (None, "m"), (3, "v")], "k long, v string")
    want = [("1", "x"), ("2", "z"), ("3", "w"), ("None", "m")]
    path = store.save(a, str(tmp_path / "t"))
    for _ in range(2):
        path = store.merge_into(spark, path, b, ["k"])
        assert sorted((str(r.k), r.v) for r in spark.read.parquet(path).collect()) == want
    path = store.replace_documents(spark, path, spark.createDataFrame([(1, "p"), (1, "q")], a.schema), "k")
    assert sorted(r.v for r in spark.read.parquet(path).where("k = 1").collect()) == ["p", "q"]
    path = store.delete_documents(spark, path, spark.createDataFrame([(1,), (9,)], "k long"), "k")
    assert sorted(str(r.k) for r in spark.read.parquet(path).collect()) == ["2", "3", "None"]
    new = str(tmp_path / "new")
    for rows in ([(1, 5), (1, 4)], [(1, 3), (2, 9)]):
        store.insert_new(spark, new, spark.createDataFrame(rows, "k long, at long"), ["k"], "at")
    assert sorted(map(tuple, spark.read.parquet(new).collect())) == [(1, 4), (2, 9)]
    assert {r["error"]: r.n for r in checks.broken({"t": (a, {"two": F.col("k") == 2, "none": F.col("v") == "?"})}).collect()} == {"two": 1}


def test_tiers_and_folders(spark, tmp_path):
    raw, fixture = str(tmp_path / "raw"), str(tmp_path / "fixture.json")
    (tmp_path / "fixture.json").write_text('{"a": 1}\n')
    live = lambda: spark.createDataFrame([(2,)], "a long")

    def down():
        raise OSError("no network")

    at = lambda f, **o: (lambda r: (r[0].first().a, r[1]))(readers.load(spark, "s", f, fixture, raw, "a long", **o))
    assert at(down) == (1, "fixture") and at(None, offline=True) == (1, "fixture")
    assert at(live) == (2, "api") and at(down) == (2, "cache") and at(live, refresh=True) == (2, "api") and at(live, offline=True) == (2, "cache")
    for part in (tmp_path / "raw" / "s").glob("part-*"):
        part.write_text("{broken")
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert at(None) == (1, "fixture")
    folder = tmp_path / "docs"
    (folder / "sub").mkdir(parents=True)
    for name, text in (("a.md", "# A\nx"), ("sub/b.txt", "plain\ntext"), ("c.bin", "no")):
        (folder / name).write_text(text)
    got = {r.doc_id: r.text for r in readers.folder(spark, str(folder), prefix="kb/").collect()}
    assert got == {"kb/a": "# A\nx", "kb/sub/b": "plain\ntext"}


def test_readers_of_odd_values(spark):
    row = spark.range(1).select(readers.hardest(F.array(F.lit("beginner"), F.lit("expert"), F.lit("intermediate"))).alias("h"), readers.hardest(F.lit(None).cast("array<string>")).alias("none"), T.minutes(F.lit("7:01")).alias("m"), T.minutes(F.lit("")).alias("e"), T.minutes(F.lit("1:00:00")).alias("s"), T.meta_lines(F.lit("难度:a\nx\nk: v:w\nk:last\n:no")).alias("meta"), T.source_url(F.lit("a\n来源: http://x y")).alias("url"), T.json_object(F.lit("x {a {b} c} d")).alias("json")).first()
    assert (row.h, row.none, row.m, row.e, row.s, row.url, row.json) == ("intermediate", "beginner", 8, 0, 60, "http://x", "{a {b} c}") and row.meta == {"难度": "a", "k": "last"}
    assert [readers.LEVELS[0][1], readers.LEVELS[-1][1]] == [4, 2]
    levels = spark.createDataFrame([(4.25,), (3.5,), (2.5,), (1.5,), (0.1,)], "x double").select(readers.level_of(F.col("x"))).collect()
    assert [r[0] for r in levels] == [4, 3, 2, 1, 1]


def test_quiz_and_grading(spark):
    goals = spark.createDataFrame([(k, [f"goal {k}", f"aim {k}"]) for k in range(6)], "course_id long, objectives array<string>")
    quiz = learning.quiz(goals).collect()
    for r in quiz:
        assert r.options[r.answer] == ("goal" if r.question == 1 else "aim") + f" {r.course_id}" and len(r.options) == len(set(r.options)) == 4
    right = [r.answer for r in sorted(quiz, key=lambda r: r.question) if r.course_id == 1]
    tries = spark.createDataFrame([(1, 1, right), (2, 1, [right[0], 9]), (3, 1, [0]), (4, 1, [-1, None])], "attempt_id long, course_id long, answers array<int>")
    got = {r.attempt_id: (r.score, r.verdict, r.error is None) for r in learning.graded(tries, learning.quiz(goals), "course_id").collect()}
    assert got == {1: (100, "excellent", True), 2: (50, "failed", True), 3: (None, None, False), 4: (0, "failed", True)}


def test_ranking_checks_its_arguments(spark):
    none = spark.createDataFrame([], "employee_id long")
    for bad in ({"top_k": 0}, {"top_k": 1, "weights": (1, 1, 0, 0, 0)}):
        with pytest.raises(ValueError):
            recall.ranked(none, none, none, none, none, none, **bad)


def test_report_totals_of_nothing(spark):
    none = spark.createDataFrame([], "exam_score int")
    row = learning.training_totals(none).first()
    assert (row.completions, row.pass_rate, row.average_score) == (0, None, None)
    now = spark.range(1).select(store.now_iso().alias("t")).first().t
    assert abs(dt.datetime.fromisoformat(now) - dt.datetime.now(dt.timezone.utc)) < dt.timedelta(minutes=5)
    sign = spark.range(1).select(learning.points(F.lit(0.296), F.lit(0.359)).alias("up"), learning.points(F.lit(0.5), F.lit(0.25)).alias("down")).first()
    assert (sign.up, sign.down) == ("+6.3 pp", "-25.0 pp")


def test_jobs_in_one_call(spark):
    d = Domain(spark, SF)
    best = api.recommend(d, 5, replay.passed_courses(d["training_record"]))
    assert sorted(map(str, best.collect())) == sorted(map(str, skills.QUERIES["course_ranking_topk"](spark, SF).collect()))
    path = api.learning_path(d, completed=replay.passed_courses(d["training_record"]))
    for name, query in (("order", "topo_order"), ("plan", "week_plan"), ("totals", "path_totals")):
        columns = path[name].columns
        assert sorted(map(str, path[name].collect())) == sorted(map(str, skills.QUERIES[query](spark, SF).select(columns).collect()))
    after = api.recalculated(d)
    assert after["readiness"].count() == d["employee"].count() and after["recommendations"].count() and after["totals"].count()
    assert sum(r.n for r in api.team_home(d)["buckets"].collect()) == d["employee"].count()
    found = api.ask(spark.createDataFrame([(1, "alpha beta"), (2, " ")], "q long, t string"), api.ingest(spark.createDataFrame([(7, "# T\nalpha beta gamma"), (8, "delta")], "doc_id long, text string"))["chunks"], "q", "t", k=1)
    assert [(r.q, r.chunk_id) for r in found["hits"].collect()] == [(1, "7:0000")]
    assert "[1] 《T》" in found["context"].first().context and found["context"].count() == 1


def test_scratch_can_be_purged(spark):
    t = materialise(spark.range(3), "purged")
    assert t.count() == 3
    purge(spark)
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND|FILE_NOT_EXIST"):
        spark.read.schema("id long").parquet(t.inputFiles()[0]).count()
