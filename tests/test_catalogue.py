"""Recommendations, closures and orders by blocks beside joins and plain loops; chains by doubling; schemas."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gapweave import api
from gapweave.operators import catalogue, graph, recall, replay, schemas


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    skills = [f"s{k}" for k in range(12)]
    employee = [(e, e % 3) for e in range(40)]
    requires = [(p, s, rng.randint(1, 5), rng.randint(0, 4)) for p in range(3) for s in skills if rng.random() < 0.8]
    has = [(e, s, rng.randint(0, 4)) for e in range(40) for s in skills if rng.random() < 0.6]
    course = [(c, rng.choice(["beginner", "intermediate", "advanced", "odd", None] if c % 20 == 0 else ["beginner", "intermediate", "advanced"]), rng.choice([0, 30, 60, 61, 300])) for c in range(120)]
    teaches = sorted({(c, rng.choice(skills)) for c in range(118) for _ in range(1 + c % 2)}) + [(500, "s1"), (7, "unknown")]
    before = sorted({(c, rng.randrange(c)) for c in range(1, 120) for _ in range(c % 4)}) + [(90, 700)]
    record = [(k, rng.randrange(40), rng.randrange(122), rng.randint(40, 100)) for k in range(300)]
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    return {
        "employee": make(employee, "employee_id long, target_position_id int"), "requires": make(requires, "position_id int, skill_id string, importance int, required_level int"),
        "has_skill": make(has, "employee_id long, skill_id string, level int"), "course": make(course, "course_id long, difficulty string, duration_minutes int"),
        "teaches": make(teaches, "course_id long, skill_id string"), "prerequisite": make(before, "course_id long, prerequisite_id long"), "training_record": make(record, "record_id long, employee_id long, course_id long, exam_score int"),
    }


def rows(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def test_blocks_equal_joins(tables, monkeypatch):
    passed = replay.passed_courses(tables["training_record"])
    levels = tables["has_skill"]
    profile = replay.profile(replay.steps(tables["training_record"], tables["course"], tables["teaches"], levels), levels)
    calls = {
        "ranked": lambda: api.recommend(tables, 5, passed), "all": lambda: api.recommend(tables, 1000),
        "reached": lambda: api.reachable(tables, levels, passed), "ordered": lambda: api.ordered(tables, levels, passed),
        "changes": lambda: api.plan_changes(tables, levels, profile, passed), "without": lambda: api.plan_changes(tables, levels, profile, passed, with_place=False),
    }
    monkeypatch.setattr(catalogue, "BLOCK_NUMBERS", 1000)  # several blocks
    blocks = {k: f() for k, f in calls.items()}
    got = {k: (sorted(df.columns), rows(df.select(sorted(df.columns)))) for k, df in blocks.items()}
    monkeypatch.setattr(catalogue, "MOST_BYTES", 0)  # too large to broadcast
    assert catalogue.Catalogue.of(tables["course"], tables["teaches"], tables["prerequisite"]) is None
    for k, f in calls.items():
        df = f()
        assert (sorted(df.columns), rows(df.select(sorted(df.columns)))) == got[k], k
    assert all(x for _, x in got.values())


def test_threshold_search_leaves_lists_unread(spark):
    rng = random.Random(6)
    course = [(c, rng.choice([0, 1, 2]), rng.choice([2, 3, 4]), rng.randint(5, 500)) for c in range(20_000)]
    teaches = [(c, f"s{rng.randrange(25)}") for c in range(20_000) for _ in range(2)]
    edges = [(c, rng.randrange(c)) for c in range(1, 20_000)]
    whole = catalogue.Catalogue(course, teaches, edges)
    gaps = [[{"skill_id": f"s{k}", "weighted_gap": float(rng.randint(1, 9)), "importance": float(rng.randint(1, 5))} for k in range(25) if rng.random() < 0.5] for _ in range(20)]
    levels = [[{"skill_id": f"s{k}", "level": float(rng.randint(0, 4))} for k in range(25)] for _ in range(20)]
    block = catalogue.Block(whole, list(range(20)), gaps, levels, [[5, 99_999]] * 20)
    looked = 0
    for e in range(20):
        at, factors, n = block.best(e, 5, recall.WEIGHTS)
        looked += n
        import numpy as np

        every = np.flatnonzero(block.lacks[e, whole.set_of])
        every = every[every != 5]
        total = sum(w * v for w, v in zip(recall.WEIGHTS, block.factors(e, every), strict=True))
        best = every[np.lexsort((every, -np.round(total, 6)))][:5]
        mine = sum(w * v for w, v in zip(recall.WEIGHTS, factors, strict=True))
        assert at[np.lexsort((at, -np.round(mine, 6)))][:5].tolist() == best.tolist()
    assert looked < 0.05 * 20 * 20_000


def test_empty_and_bad(spark, tables):
    none = {k: t.limit(0) for k, t in tables.items()}
    assert api.recommend(none).count() == 0 and api.ordered(none, none["has_skill"], none["has_skill"].select("employee_id", F.lit(1).alias("course_id"))).count() == 0
    some = {**tables, "course": tables["course"].limit(0), "teaches": tables["teaches"].limit(0), "prerequisite": tables["prerequisite"].limit(0)}
    assert api.recommend(some).count() == 0 and api.learning_path(some)["order"].count() == 0
    loop = {**tables, "prerequisite": spark.createDataFrame([(1, 2), (2, 1)], "course_id long, prerequisite_id long")}
    with pytest.raises(Exception, match="wait for each other"):
        api.ordered(loop, tables["has_skill"], replay.passed_courses(tables["training_record"]).limit(0)).collect()
    assert api.reachable(loop, tables["has_skill"], replay.passed_courses(tables["training_record"])).count() > 0
    with pytest.raises(ValueError, match="top_k"):
        api.recommend(tables, 0)
    with pytest.raises(ValueError, match="add up"):
        api.recommend(tables, 3, weights=(1, 1, 0, 0, 0))


def test_chains_by_doubling(spark):
    n = 700
    line = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(0, 5), (None, 3), (4, None)], "course_id long, prerequisite_id long")
    got = graph.chains(line)
    assert got.count() == n * (n + 1) // 2 and got.where("ancestor_id - course_id <> depth").isEmpty()
    assert graph.closure(spark.createDataFrame([(650,), (690,), (None,)], "course_id long"), line).count() == n - 650 + 2
    ring = spark.createDataFrame([(k, (k + 1) % 37) for k in range(37)] + [(100, 0), (5, 101)], "course_id long, prerequisite_id long")
    with pytest.raises(ValueError, match="cycle"):
        graph.chains(ring)
    assert sorted(r.course_id for r in graph.on_cycles(ring).collect()) == list(range(37))
    assert graph.chains(line.limit(0)).count() == 0 and graph.on_cycles(line).count() == 0


def faults(spark, schema, *values):
    texts = [(k, v if v is None or isinstance(v, str) and v.startswith("~") else json.dumps(v)) for k, v in enumerate(values)]
    return sorted((r.id, r.path, r.rule, r.detail) for r in schemas.faults(spark.createDataFrame(texts, "id int, doc string"), "doc", schema).collect())


def test_schemas(spark):
    good = {"skill_id": "SKILL_001", "name": "n", "category": "data", "description": "d", "aliases": [], "sources": ["esco"]}
    one = lambda **change: {k: v for k, v in (good | change).items() if v != "gone"}
    docs = [good, one(skill_id="SKILL_1"), one(name=""), one(name=5), one(category="x"), one(aliases=["a", ""]), one(sources=[]), one(sources=["esco", "esco"]), one(sources=["me"]), one(description="gone", extra=1), [good], None, "~no json", one(aliases=None), one(name=None)]
    assert faults(spark, schemas.SCHEMAS["skills"], *docs) == sorted([
        (1, "skill_id", "pattern", None), (2, "name", "minLength", None), (3, "name", "type", None), (4, "category", "enum", None), (5, "aliases/1", "minLength", None), (6, "sources", "minItems", None),
        (7, "sources", "uniqueItems", None), (8, "sources/0", "enum", None), (9, "<root>", "required", "description"), (9, "<root>", "additionalProperties", "extra"), (10, "<root>", "type", None), (12, "<root>", "json", None),
        (13, "aliases", "type", None), (14, "name", "type", None),
    ], key=lambda r: (r[0], r[1], r[2], r[3] or ""))
    numbers = {"type": "integer", "minimum": 0, "maximum": 4}
    assert [(i, r) for i, _, r, _ in faults(spark, numbers, 0, 4, 5, -1, 2.5, 3.0, True, "3", None, 10**30)] == [(2, "maximum"), (3, "minimum"), (4, "type"), (6, "type"), (7, "type"), (9, "maximum")]
    whole = {"generated_at": "t", "seed": 1, "employees": [{"employee_id": "EMP_001", "name": "n", "department": "d", "current_position_id": "POS_001", "target_position_id": "POS_001", "years_of_experience": 3, "skills": [{"skill_id": "SKILL_001", "level": 2, "evidence": {"assessment_score": 101, "project_experience": "", "training_records": [1]}}] * 5}]}
    got = faults(spark, schemas.document("employees"), whole, {**whole, "employees": []})
    assert got == sorted([(0, f"employees/0/skills/{k}/evidence{p}", r, d) for k in range(5) for p, r, d in (("/assessment_score", "maximum", None), ("", "required", "self_assessment"), ("/training_records/0", "type", None))] + [(1, "employees", "minItems", None)], key=lambda r: (r[0], r[1], r[2], r[3] or ""))
    with pytest.raises(ValueError, match="unknown keywords"):
        schemas.compiled({"oneOf": []}, F.lit(1))




def test_orders_by_groups_equal_the_queue():
    import numpy as np

    rng = random.Random(8)
    for n in (1, 5, 300):
        for edges in ([], sorted({(c, rng.randrange(max(0, c - 9), c)) for c in range(1, n) for _ in range(rng.randrange(4))})):
            whole = catalogue.Catalogue([(c, 0, 4, 30) for c in range(n)], [(c, f"s{rng.randrange(6)}") for c in range(n) if c % 7], edges)
            gaps = [[{"skill_id": f"s{k}", "weighted_gap": float(rng.randint(0, 3)), "importance": 1.0} for k in range(6)] for _ in range(70)]
            block = catalogue.Block(whole, list(range(70)), gaps, [[]] * 70, [[]] * 70)
            for e in range(70):
                kept = np.array([rng.random() < 0.8 for _ in range(n)])
                assert catalogue.in_order(block, e, kept).tolist() == catalogue.by_queue(block, e, kept).tolist()


def test_plans_of_a_large_catalogue_take_little_time():
    import time

    import numpy as np

    n = 60_000
    whole = catalogue.Catalogue([(c, 0, 4, 30 + c % 300) for c in range(n)], [(c, f"s{c * 7 % 25}") for c in range(n)], [(c, c // 2) for c in range(2, n)])
    gaps = [[{"skill_id": f"s{k}", "weighted_gap": float(k * 7 % 11), "importance": 1.0} for k in range(25)]] * 64
    block = catalogue.Block(whole, list(range(64)), gaps, [[]] * 64, [[]] * 64)
    began = time.process_time()
    plans = list(catalogue.dealt_to_weeks(block, 4))
    fast = (time.process_time() - began) / 64
    began = time.process_time()
    queue = catalogue.by_queue(block, 0, np.ones(n, bool))
    assert plans[0][0].tolist() == queue.tolist() and fast < (time.process_time() - began) / 2


@pytest.mark.parametrize("odd", [0, 0.5])
def test_weeks_of_any_durations(odd):
    import numpy as np

    rng = random.Random(3)
    for _ in range(50):
        minutes = np.array([rng.choice([1, 30, 60, 239, 240, 241, 480, 700]) + odd for _ in range(40)])
        first, parts = catalogue.weeks(minutes, 240.0)
        want, week, used = [], 1, 0.0
        for m in minutes.tolist():
            if used > 1e-9 and used + m > 240 + 1e-9:
                week, used = week + 1, 0.0
            want.append(week)
            while m > 240 + 1e-9:
                week, used, m = week + 1, 0.0, m - 240
            used += m
        assert first.tolist() == want and (parts >= 1).all()


def test_few_employees_of_a_large_catalogue_are_dealt_to_tasks(spark, tables, monkeypatch):
    monkeypatch.setattr(catalogue, "TASK_PAIRS", 400)
    passed = replay.passed_courses(tables["training_record"])
    assert api.reachable(tables, tables["has_skill"], passed).rdd.getNumPartitions() > 8
    done = tables["training_record"].select("employee_id", "course_id")
    calls = [lambda: api.prioritised(tables, tables["has_skill"], passed), lambda: api.scheduled(tables, tables["has_skill"], passed), lambda: api.path_totals(tables, tables["has_skill"], passed), lambda: api.next_course(tables, tables["has_skill"], passed, done), lambda: api.prerequisite_context(tables, tables["has_skill"], passed), lambda: api.context_counts(tables, tables["has_skill"], passed)]
    got = [rows(f().select(sorted(f().columns))) for f in calls]
    monkeypatch.setattr(catalogue, "MOST_BYTES", 0)
    assert got == [rows(f().select(sorted(f().columns))) for f in calls] and all(got)


def test_ranking_of_a_catalogue_in_pieces(tables, monkeypatch):
    passed = replay.passed_courses(tables["training_record"])
    levels = tables["has_skill"]
    gaps = api.gap.gaps(api.gap.requirements(tables["employee"], tables["requires"], levels))
    found = recall.candidates(gaps, tables["teaches"], passed)
    want = {k: rows(recall.ranked(gaps, found, tables["course"], tables["teaches"], tables["prerequisite"], levels, k)) for k in (5, 1000)}
    monkeypatch.setattr(catalogue, "MOST_BYTES", 0)
    monkeypatch.setattr(catalogue, "PIECE_BYTES", 15_000)
    assert len(list(catalogue.Catalogue.pieces(tables["course"], tables["teaches"], tables["prerequisite"]))) > 1
    monkeypatch.setattr(recall, "candidates", None)  # pairs of employees and courses are not made
    for k, w in want.items():
        df = api.recommend(tables, k, passed)
        assert rows(df.select("employee_id", "course_id", "gap_coverage", "importance", "difficulty_match", "prerequisite", "time_cost", "total", "rank")) == w


def test_only_people_whose_levels_or_records_changed_are_compared(spark, tables, monkeypatch):
    records = tables["training_record"].where("employee_id < 5")
    some, levels, passed = {**tables, "training_record": records}, tables["has_skill"], replay.passed_courses(records)
    profile = replay.profile(replay.steps(records, tables["course"], tables["teaches"], levels), levels)
    worked, dealt = [], catalogue.dealt
    monkeypatch.setattr(catalogue, "dealt", lambda employees, c: (worked.append(employees.count()), dealt(employees, c))[1])
    changed = api.plan_changes(some, levels, profile, passed)
    assert worked and max(worked) <= 5 and {r.employee_id for r in changed.select("employee_id").distinct().collect()} <= set(range(5)) and not changed.isEmpty()


def test_first_course_left_is_that_of_the_order():
    import numpy as np

    rng = random.Random(9)
    for n in (1, 6, 200):
        for edges in ([], sorted({(c, rng.randrange(max(0, c - 9), c)) for c in range(1, n) for _ in range(rng.randrange(4))})):
            whole = catalogue.Catalogue([(c, 0, 4, 30) for c in range(n)], [(c, f"s{rng.randrange(6)}") for c in range(n) if c % 7], edges)
            gaps = [[{"skill_id": f"s{k}", "weighted_gap": float(rng.randint(0, 3)), "importance": 1.0} for k in range(6)] for _ in range(70)]
            block = catalogue.Block(whole, list(range(70)), gaps, [[]] * 70, [[]] * 70)
            for e in range(70):
                kept, done = np.array([rng.random() < 0.8 for _ in range(n)]), {c for c in range(n + 3) if rng.random() < e / 69}
                order = [k for k in catalogue.by_queue(block, e, kept).tolist() if int(whole.ids[k]) not in done]
                assert catalogue.first_left(block, e, kept, done) == (order[0] if order else None)


def test_next_course_puts_no_plan_in_order(spark, tables, monkeypatch):
    done = tables["training_record"].select("employee_id", "course_id")
    passed = replay.passed_courses(tables["training_record"])
    people = api.people(tables, tables["has_skill"], passed).join(done.groupBy("employee_id").agg(F.collect_set("course_id").alias("done")), "employee_id", "left").collect()
    block = catalogue.Block(api.catalogue_of(tables), *[[r[x] for r in people] for x in ("employee_id", "gaps", "levels", "passed")])
    block.more = [[r.done for r in people]]
    want = [next((int(block.c.ids[k]) for k in at.tolist() if block.c.ids[k] not in (block.more[0][e] or [])), None) for e, at in enumerate(catalogue.orders(block))]
    monkeypatch.setattr(catalogue, "in_order", None)
    kept = catalogue.unpacked(block.reached()[1], len(block.ids))
    got = [catalogue.first_left(block, e, kept[e], set(block.more[0][e] or [])) for e in range(len(people))]
    assert [None if k is None else int(block.c.ids[k]) for k in got] == want and any(want)
