"""Queries on look-ups, quizzes, progress, team reports and the loop that a finished course sets off."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave import api
from gapweave.operators import gap, graph, learning, recall, replay, team
from gapweave.plans.skills import ORDERED, PROFILE, gaps, profile, query, ranked_courses, replayed, requirements, RANKED
from gapweave.sources.scratch import materialise, scratch, spread
from gapweave.sources.views import Domain
from gapweave.streaming import loop


@query("SELECT employee_id, skill_id, gap, importance, row_number() OVER (PARTITION BY employee_id ORDER BY gap DESC, importance DESC, skill_id) AS place FROM gaps")
def gap_order(d: Domain) -> DataFrame:
    return learning.ordered(gaps(d)).select("employee_id", "skill_id", "gap", "importance", "place")


@query("SELECT j.position_id, j.name, row_number() OVER (PARTITION BY j.position_id ORDER BY importance DESC, skill_id) AS place, skill_id, importance, required_level FROM job j LEFT JOIN requires USING (position_id)")
def position_skills(d: Domain) -> DataFrame:
    return learning.position_skills(d["requires"], d["job"])


@query("SELECT course_id, list_sort(list(skill_id)) AS skills, coalesce((SELECT list_sort(list(prerequisite_id)) FROM prerequisite p WHERE p.course_id = t.course_id), []) AS prerequisites FROM teaches t GROUP BY course_id")
def course_skills(d: Domain) -> DataFrame:
    return graph.with_lists(d["course"].select("course_id"), d["teaches"], d["prerequisite"])


@query("SELECT skill_id, count(*) AS n, list_sort(list(name)) AS courses FROM teaches JOIN course USING (course_id) GROUP BY skill_id")
def skill_courses(d: Domain) -> DataFrame:
    return learning.skill_courses(d["teaches"], d["course"])


LISTS = "coalesce((SELECT list_sort(list(skill_id)) FROM teaches t WHERE t.course_id = c.course_id), []) AS skills, coalesce((SELECT list_sort(list(prerequisite_id)) FROM prerequisite p WHERE p.course_id = c.course_id), []) AS prerequisites"


@query(f"SELECT course_id, employees, {LISTS} FROM (SELECT course_id, count(*) AS employees FROM found GROUP BY course_id) c")
def candidate_courses(d: Domain) -> DataFrame:
    """Candidates with what they teach and need, and for how many employees they are candidates."""
    counts = recall.candidate_counts(gaps(d), d["teaches"], replay.passed_courses(d["training_record"]))
    return graph.with_lists(counts, d["teaches"], d["prerequisite"])


@query(f"SELECT course_id, employees, {LISTS} FROM (SELECT course_id, count(*) AS employees FROM (SELECT DISTINCT f.employee_id, p.prerequisite_id AS course_id FROM found f JOIN prerequisite p USING (course_id) WHERE (f.employee_id, p.prerequisite_id) NOT IN (SELECT employee_id, course_id FROM found)) GROUP BY course_id) c")
def context_courses(d: Domain) -> DataFrame:
    """Courses that are needed by candidates only, with what they teach; none is left out for teaching nothing."""
    counts = api.context_counts(d, d.written("has_skill"), replay.passed_courses(d["training_record"]))
    return graph.with_lists(counts, d["teaches"], d["prerequisite"])


@query("SELECT record_id, employee_id, course_id, exam_score, strftime(completed_at, '%Y-%m-%dT%H:%M:%S') AS at, CASE WHEN exam_score >= 85 THEN 'excellent' WHEN exam_score >= 70 THEN 'passed' ELSE 'failed' END AS verdict, CASE WHEN exam_score >= 85 THEN '优秀' WHEN exam_score >= 70 THEN '通过' ELSE '未通过' END AS label FROM training_record")
def record_assessments(d: Domain) -> DataFrame:
    """Records joined with their assessments by record_id, with ISO dates."""
    records = d["training_record"].select("record_id", "employee_id", "course_id", F.date_format("completed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))
    assessments = d["training_record"].select("record_id", "exam_score", learning.verdict(F.col("exam_score")).alias("verdict"))
    return records.join(assessments, "record_id").withColumn("label", learning.labelled(F.col("verdict"), learning.VERDICT_LABELS))


@query("""SELECT e.employee_id, c.skill_id, coalesce(h.level, 0) AS current_level, course_count, l.score AS last_score, CASE WHEN l.score >= 85 THEN 'solid' WHEN l.score >= 70 THEN 'consolidate' WHEN l.score IS NOT NULL THEN 'fail' END AS last_verdict, row_number() OVER (PARTITION BY e.employee_id ORDER BY coalesce(h.level, 0) = 0, course_count DESC, c.skill_id) AS place FROM employee e CROSS JOIN (SELECT skill_id, count(*) AS course_count FROM teaches GROUP BY skill_id) c LEFT JOIN has_skill h ON h.employee_id = e.employee_id AND h.skill_id = c.skill_id LEFT JOIN (SELECT employee_id, skill_id, arg_max(exam_score, {'t': completed_at, 'r': record_id}) AS score FROM training_record JOIN teaches USING (course_id) GROUP BY ALL) l ON l.employee_id = e.employee_id AND l.skill_id = c.skill_id""")
def assessable_skills(d: Domain) -> DataFrame:
    return learning.assessable(d["employee"], d["teaches"], d["has_skill"], team.latest_assessment(d["training_record"], d["teaches"]))


GOALS = "goals AS (SELECT course_id, [concat('Explain ', name), concat('Apply ', name), concat('Name parts of ', name)][1:1 + course_id % 3] AS objectives FROM course)"


def goals(d: Domain) -> DataFrame:
    all_ = F.array(F.concat(F.lit("Explain "), "name"), F.concat(F.lit("Apply "), "name"), F.concat(F.lit("Name parts of "), "name"))
    return d["course"].select("course_id", F.slice(all_, F.lit(1), (1 + F.col("course_id") % 3).cast("int")).alias("objectives"))


SHUFFLE = "[x.x FOR x IN list_sort([{'d': md5(concat(seed, '|', o)), 'x': o} FOR o IN list_distinct(options)])]"
QUIZ = f""", {GOALS}, n AS (SELECT *, row_number() OVER (ORDER BY course_id) - 1 AS place, count(*) OVER () AS n FROM goals),
asked AS (SELECT course_id, place, n, unnest(objectives) AS goal, unnest(range(len(objectives))) AS k FROM n),
wrong AS (SELECT a.course_id, a.k, o.objectives[1 + (a.k + j.j) % len(o.objectives)] AS wrong, a.goal FROM asked a CROSS JOIN (SELECT unnest([0, 1, 2]) AS j) j JOIN n o ON o.place = (a.place + 1 + (a.k * 3 + j.j) % greatest(a.n - 1, 1)) % a.n WHERE o.course_id <> a.course_id),
opts AS (SELECT a.course_id, a.k, a.goal, concat(a.course_id, ':', a.k) AS seed, list_append(coalesce(list(w.wrong) FILTER (w.wrong <> a.goal), []), a.goal) AS options FROM asked a LEFT JOIN wrong w ON w.course_id = a.course_id AND w.k = a.k GROUP BY a.course_id, a.k, a.goal),
quiz AS (SELECT course_id, (k + 1)::INT AS question, options, (list_position(options, goal) - 1)::INT AS answer FROM (SELECT course_id, k, goal, {SHUFFLE} AS options FROM opts))"""


@query(QUIZ + " SELECT * FROM quiz")
def course_quiz(d: Domain) -> DataFrame:
    return learning.quiz(goals(d))


@query(
    f""", {GOALS}, first AS (SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY course_id) - 1 AS k FROM teaches JOIN goals USING (course_id)), asked AS (SELECT skill_id, k, course_id, objectives[1 + k % len(objectives)] AS goal FROM first WHERE k < 5),
others AS (SELECT s.skill_id, g.course_id, objectives[1] AS wrong, row_number() OVER (PARTITION BY s.skill_id ORDER BY md5(concat(s.skill_id, '|', g.course_id)), g.course_id) AS n FROM goals g CROSS JOIN (SELECT DISTINCT skill_id FROM teaches) s WHERE (s.skill_id, g.course_id) NOT IN (SELECT skill_id, course_id FROM teaches)),
opts AS (SELECT a.skill_id, a.k, a.course_id, a.goal, concat(a.skill_id, ':', a.k) AS seed, list_append(coalesce(list(o.wrong) FILTER (o.wrong <> a.goal), []), a.goal) AS options FROM asked a LEFT JOIN others o ON o.skill_id = a.skill_id AND o.n BETWEEN a.k * 3 + 1 AND a.k * 3 + 3 GROUP BY a.skill_id, a.k, a.course_id, a.goal)
SELECT skill_id, (k + 1)::INT AS question, course_id, options, (list_position(options, goal) - 1)::INT AS answer FROM (SELECT skill_id, k, course_id, goal, {SHUFFLE} AS options FROM opts)"""
)
def skill_questions(d: Domain) -> DataFrame:
    return learning.skill_questions(goals(d), d["teaches"])


@query(
    QUIZ
    + """, tries AS (SELECT t.record_id, q.total, [(t.record_id + i) % 5 FOR i IN range(q.total + CASE WHEN t.record_id % 17 = 0 THEN 1 ELSE 0 END)] AS answers, q.qs FROM training_record t JOIN (SELECT course_id, count(*) AS total, list({'a': answer, 'n': len(options)} ORDER BY question) AS qs FROM quiz GROUP BY course_id) q USING (course_id)),
marks AS (SELECT record_id, total, len(answers) = total AS fits, len([i FOR i IN range(total) IF answers[i + 1] = qs[i + 1].a AND answers[i + 1] < qs[i + 1].n]) AS ok FROM tries)
SELECT record_id AS attempt_id, CASE WHEN fits THEN ok::INT END AS correct, total::INT AS total, CASE WHEN fits THEN round_even(100 * ok / total, 0)::INT END AS score, CASE WHEN fits THEN CASE WHEN round_even(100 * ok / total, 0) >= 85 THEN 'excellent' WHEN round_even(100 * ok / total, 0) >= 70 THEN 'passed' ELSE 'failed' END END AS verdict, CASE WHEN NOT fits THEN 'answers and questions differ in number' END AS error FROM marks"""
)
def graded_quizzes(d: Domain) -> DataFrame:
    """A try at its course's quiz for each record, with answers made from its id."""
    quiz = materialise(learning.quiz(goals(d)), "quiz")
    sizes = quiz.groupBy("course_id").agg(F.count("*").cast("int").alias("total"))
    last = F.col("total") - 1 + F.when(F.col("record_id") % 17 == 0, 1).otherwise(0)
    answers = F.transform(F.sequence(F.lit(0), last), lambda i: ((F.col("record_id") + i) % 5).cast("int"))
    tries = d["training_record"].join(sizes, "course_id").select(F.col("record_id").alias("attempt_id"), "course_id", answers.alias("answers"))
    return learning.graded(tries, quiz, "course_id")


@query("SELECT t.employee_id, t.course_id, count(DISTINCT record_id % 3) FILTER (record_id % 3 < total) AS completed, coalesce(max(total), 0) AS total, coalesce(count(DISTINCT record_id % 3) FILTER (record_id % 3 < total) = max(total), false) AS quiz_unlocked FROM training_record t LEFT JOIN (SELECT course_id, 1 + (course_id + 1) % 2 AS total FROM course) u USING (course_id) GROUP BY ALL")
def learning_progress(d: Domain) -> DataFrame:
    units = d["course"].select("course_id", F.explode(F.sequence(F.lit(0), ((F.col("course_id") + 1) % 2).cast("int"))).alias("unit"))
    done = d["training_record"].select("employee_id", "course_id", (F.col("record_id") % 3).cast("int").alias("unit"))
    return learning.progress(units, done)


@query(ORDERED + "SELECT employee_id, arg_min(course_id, position) AS course_id FROM sorted WHERE (employee_id, course_id) NOT IN (SELECT employee_id, course_id FROM training_record) GROUP BY employee_id", small=True)
def next_course(d: Domain) -> DataFrame:
    """The first course of everyone's plan that they have not tried yet."""
    return api.next_course(d, d.written("has_skill"), replay.passed_courses(d["training_record"]), d["training_record"].select("employee_id", "course_id"))


@query("SELECT record_id, employee_id, course_id, exam_score FROM (SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY completed_at DESC, record_id DESC) AS n FROM training_record) WHERE n <= 3 ORDER BY completed_at DESC, record_id DESC LIMIT 6")
def newest_records(d: Domain) -> DataFrame:
    last = team.recent(d["training_record"], each=3).join(d["training_record"].select("record_id", "completed_at"), "record_id")
    return learning.newest(last).select("record_id", "employee_id", "course_id", "exam_score")


@query("SELECT count(*) FILTER (exam_score >= 70) AS completions, round_even(100 * avg((exam_score >= 70)::INT), 0)::BIGINT AS pass_rate, round_even(avg(exam_score) FILTER (exam_score >= 70), 1) AS average_score FROM training_record")
def training_totals(d: Domain) -> DataFrame:
    return learning.training_totals(d["training_record"])


@query("SELECT b.bucket, b.label, count(employee_id) AS n, (SELECT round_even(100 * avg(readiness), 0)::BIGINT FROM ready) AS average FROM (VALUES ('ready', '已达标'), ('close', '接近达标'), ('far', '差距较大')) b(bucket, label) LEFT JOIN (SELECT employee_id, CASE WHEN readiness >= 0.8 THEN 'ready' WHEN readiness >= 0.5 THEN 'close' ELSE 'far' END AS bucket FROM ready) r USING (bucket) GROUP BY b.bucket, b.label")
def team_histogram(d: Domain) -> DataFrame:
    return learning.histogram(materialise(gap.readiness(d["employee"], requirements(d)), "readiness"))


@query(", s AS (SELECT skill_id, exam_score AS score FROM training_record JOIN teaches USING (course_id)) (SELECT skill_id, count(*) AS attempts, round_even(avg(score), 0)::BIGINT AS average, round_even(100 * avg((score >= 70)::INT), 0)::BIGINT AS pass_rate FROM s GROUP BY skill_id ORDER BY attempts DESC, skill_id LIMIT 8) UNION ALL SELECT NULL, count(*), round_even(avg(score), 0)::BIGINT, round_even(100 * avg((score >= 70)::INT), 0)::BIGINT FROM s")
def assessment_report(d: Domain) -> DataFrame:
    return learning.assessment_report(d["training_record"].join(d["teaches"], "course_id").select("skill_id", F.col("exam_score").alias("score")))


@query("SELECT course_id, CASE WHEN duration_minutes <= 60 THEN '较低' WHEN duration_minutes <= 120 THEN '适中' ELSE '较高' END AS time_cost, CASE WHEN duration_minutes >= 60 THEN printf('约 %.1f 小时', duration_minutes / 60) ELSE concat(duration_minutes, ' 分钟') END AS duration FROM course WHERE duration_minutes % 6 <> 3")
def course_labels(d: Domain) -> DataFrame:
    """Time cost and duration in words, of courses whose hours have no half of a tenth, which libraries round differently."""
    m = F.col("duration_minutes")
    return d["course"].where(m % 6 != 3).select("course_id", learning.time_cost(m).alias("time_cost"), learning.duration(m).alias("duration"))


WHY = (
    RANKED.replace("SELECT * FROM (SELECT *, row_number()", ", best AS (SELECT employee_id, course_id FROM (SELECT *, row_number()", 1)
    + """),
fact AS (SELECT b.employee_id, b.course_id, list(printf('%s(当前 %d → 要求 %d,重要度 %.1f)', t.skill_id, g.current_level, g.required_level, g.importance::DOUBLE) ORDER BY g.gap DESC, g.importance DESC, t.skill_id) FILTER (g.gap IS NOT NULL) AS covers, avg(coalesce(h.level, 0)) AS a FROM best b JOIN teaches t USING (course_id) LEFT JOIN gaps g ON g.employee_id = b.employee_id AND g.skill_id = t.skill_id LEFT JOIN has_skill h ON h.employee_id = b.employee_id AND h.skill_id = t.skill_id GROUP BY ALL),
need AS (SELECT b.employee_id, b.course_id, list(c.name ORDER BY c.course_id) FILTER (coalesce(l.a, 0) >= 2) AS has, list(c.name ORDER BY c.course_id) FILTER (coalesce(l.a, 0) < 2) AS lacks FROM best b JOIN prerequisite p USING (course_id) JOIN course c ON c.course_id = p.prerequisite_id LEFT JOIN lev l ON l.employee_id = b.employee_id AND l.course_id = p.prerequisite_id GROUP BY ALL),
said AS (SELECT b.employee_id, b.course_id, c.difficulty, c.duration_minutes AS m, covers, a, has, lacks, CASE difficulty WHEN 'beginner' THEN 0 WHEN 'intermediate' THEN 1 ELSE 2 END - CASE WHEN a <= 1 THEN 0 WHEN a <= 2 THEN 1 ELSE 2 END AS off FROM best b JOIN course c USING (course_id) JOIN fact USING (employee_id, course_id) LEFT JOIN need USING (employee_id, course_id))
SELECT employee_id, course_id, [x FOR x IN [CASE WHEN len(covers) > 0 THEN concat('覆盖 ', len(covers), ' 项能力缺口:', array_to_string(covers, '、')) END,
 CASE WHEN off = 0 THEN printf('课程难度 %s 与当前基础匹配(课程所授技能平均等级 %.1f)', difficulty, a) WHEN off > 0 THEN printf('课程难度 %s 高于当前基础(课程所授技能平均等级 %.1f),学习挑战较大', difficulty, a) ELSE printf('课程难度 %s 低于当前基础(课程所授技能平均等级 %.1f),内容可能偏简单', difficulty, a) END,
 CASE WHEN has IS NULL AND lacks IS NULL THEN '无前置课程,可立即开始' WHEN lacks IS NULL THEN concat('前置课程已满足:', array_to_string(has, '、'), ',可直接学习') WHEN has IS NULL THEN concat('前置课程未满足:', array_to_string(lacks, '、'), '(建议先补齐基础,或确认已具备对应技能)') ELSE concat('前置课程部分满足:', array_to_string(has, '、'), ' 已具备,', array_to_string(lacks, '、'), ' 未满足') END,
 concat('学习时长约 ', m, ' 分钟,时间成本', CASE WHEN m <= 60 THEN '较低' WHEN m <= 120 THEN '适中' ELSE '较高' END)] IF x IS NOT NULL] AS reasons FROM said"""
)


@query(WHY)
def course_reasons(d: Domain) -> DataFrame:
    best = materialise(ranked_courses(d), "ranked")
    return learning.reasons(best, gaps(d), d["course"], d["teaches"], d["prerequisite"], d["has_skill"])


RESOURCES = "res AS (SELECT p_partkey AS resource_id, p_type AS type, p_brand AS skill_id FROM part)"


def resource_table(d: Domain) -> DataFrame:
    return d["part"].select(F.col("p_partkey").alias("resource_id"), F.col("p_type").alias("type"), F.array("p_brand").alias("skills"))


@query(f", {RESOURCES} SELECT * FROM (SELECT employee_id, resource_id, row_number() OVER (PARTITION BY employee_id ORDER BY resource_id) AS place FROM gaps JOIN res USING (skill_id)) WHERE place <= 12")
def resource_matches(d: Domain) -> DataFrame:
    return learning.matched_resources(gaps(d), resource_table(d))


@query(f", {RESOURCES} SELECT type, count(*) AS n, list_sort(list(resource_id))[1:30] AS first FROM res GROUP BY type")
def resource_counts(d: Domain) -> DataFrame:
    return learning.capped(resource_table(d))


@query("SELECT r.employee_id, r.skill_id, CASE WHEN h.level IS NULL THEN concat(r.skill_id, ': not on record, counts as level 0 of ', required_level) ELSE concat(r.skill_id, ': level ', h.level, ' of ', required_level) END AS text FROM req r LEFT JOIN has_skill h USING (employee_id, skill_id)")
def skill_evidence(d: Domain) -> DataFrame:
    return learning.evidence(requirements(d), d["has_skill"])


@query("SELECT course_id, CASE WHEN c.name IS NULL THEN concat('unknown course ', course_id) END AS error FROM (SELECT DISTINCT course_id FROM training_record) LEFT JOIN course c USING (course_id)")
def course_lookup(d: Domain) -> DataFrame:
    return learning.or_error(d["training_record"], d["course"], "course_id", "course")


@query("SELECT employee_id, CASE WHEN employee_id NOT IN (SELECT employee_id FROM employee) THEN concat('unknown employee ', employee_id) END AS error FROM (SELECT DISTINCT user_id + 5 AS employee_id FROM events)")
def employee_lookup(d: Domain) -> DataFrame:
    return learning.or_error(d["events"].select((F.col("user_id") + 5).alias("employee_id")), d["employee"], "employee_id", "employee")


@query("SELECT record_id, employee_id, exam_score, row_number() OVER (PARTITION BY employee_id ORDER BY record_id) AS place FROM training_record WHERE employee_id IN (SELECT employee_id FROM employee WHERE department = 'BUILDING')")
def department_records(d: Domain) -> DataFrame:
    return learning.records_of(d["training_record"], d["employee"].where("department = 'BUILDING'")).select("record_id", "employee_id", "exam_score", "place")


@query("SELECT record_id, employee_id, course_id FROM training_record ANTI JOIN course USING (course_id)")
def unknown_courses(d: Domain) -> DataFrame:
    return replay.unknown_courses(d["training_record"], d["course"])


@query("SELECT label, count(*) AS n, min(len(embedding)) AS dims FROM embeddings GROUP BY label")
def vector_dims(d: Domain) -> DataFrame:
    return d["embeddings"].groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("embedding")).cast("long").alias("dims"))


@query("SELECT page_id, url FROM pages WHERE page_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def pages_to_fetch(d: Domain) -> DataFrame:
    """Pages of which no document is there yet."""
    there = d["documents"].where("lang = 'en'").select(F.col("doc_id").alias("page_id"))
    return d["pages"].join(there, "page_id", "left_anti").select("page_id", "url")


AFTER = PROFILE + ", ready2 AS (SELECT e.employee_id, coalesce(round(sum(least(coalesce(p.level, 0), r.required_level) * r.importance)::DOUBLE / sum(r.required_level * r.importance), 6), 1) AS readiness FROM employee e LEFT JOIN requires r ON r.position_id = e.target_position_id AND r.required_level > 0 LEFT JOIN profile p ON p.employee_id = e.employee_id AND p.skill_id = r.skill_id GROUP BY e.employee_id)"


@query(AFTER + " SELECT employee_id, a.readiness AS before, b.readiness AS after, round_even(100 * b.readiness, 0)::BIGINT AS percent FROM ready a JOIN ready2 b USING (employee_id)")
def feedback_state(d: Domain) -> DataFrame:
    """Everyone's readiness before and after their records."""
    before = gap.readiness(d["employee"], requirements(d)).select("employee_id", F.col("readiness").alias("before"))
    after = gap.readiness(d["employee"], gap.requirements(d["employee"], d["requires"], profile(d))).select("employee_id", F.col("readiness").alias("after"))
    return before.join(after, "employee_id").withColumn("percent", learning.percent(F.col("after")))


LAST = "last AS (SELECT employee_id, max(record_id) AS record_id FROM training_record JOIN course USING (course_id) GROUP BY employee_id)"
SUGGESTED = "todo AS (SELECT t.record_id, p.prerequisite_id FROM training_record t JOIN prerequisite p USING (course_id) WHERE (t.employee_id, p.prerequisite_id) NOT IN (SELECT employee_id, course_id FROM passed))"


@query(
    AFTER
    + f""", {LAST}, {SUGGESTED}, tried AS (SELECT l.employee_id, l.record_id, t.course_id, t.exam_score, exists(SELECT 1 FROM training_record o WHERE o.employee_id = l.employee_id AND o.course_id = t.course_id AND o.exam_score >= 70 AND o.record_id < l.record_id) AS passed_before FROM last l JOIN training_record t USING (record_id))
SELECT t.employee_id, t.record_id, t.course_id, CASE WHEN exam_score >= 85 THEN 'solid' WHEN exam_score >= 70 THEN 'consolidate' ELSE 'fail' END AS outcome, (SELECT count(*) FROM steps s WHERE s.record_id = t.record_id AND s.raises) AS raised, CASE WHEN exam_score < 70 AND NOT passed_before THEN greatest(1, (SELECT count(*) FROM todo d WHERE d.record_id = t.record_id)) ELSE 0 END AS suggestions, a.readiness AS readiness_before, b.readiness AS readiness_after,
(SELECT count(*) FROM profile p JOIN requires r ON r.skill_id = p.skill_id JOIN employee e ON e.employee_id = p.employee_id AND e.target_position_id = r.position_id WHERE p.employee_id = t.employee_id AND r.required_level > 0 AND p.level >= r.required_level) AS met FROM tried t JOIN ready a USING (employee_id) JOIN ready2 b USING (employee_id)"""
)
def completion_loop(d: Domain) -> DataFrame:
    """What everyone's newest record sets off: its outcome, raised skills, suggestions, and readiness before and after all records."""
    d.written("has_skill")
    known = materialise(d["training_record"].join(d["course"].select("course_id"), "course_id", "left_semi").select("record_id", "employee_id", "course_id", "exam_score"), "known-records")
    last = materialise(known.groupBy("employee_id").agg(F.max("record_id").alias("record_id")).join(known.select("record_id", "course_id", "exam_score"), "record_id"), "last-records")
    with spread(d.spark, d["has_skill"].count() + known.count()):
        every = materialise(replay.steps(known, d["course"], d["teaches"], d["has_skill"]).select("employee_id", "skill_id", "record_id", "passed_before", "raises", "to_level", "flagged"), "steps")
        state = materialise(replay.profile(every, d["has_skill"]), "profile")
    steps = every.join(last.select("record_id"), "record_id", "left_semi")
    raised = steps.groupBy("record_id").agg(F.count_if("raises").alias("raised"), F.max("passed_before").alias("passed_before"))
    todo = replay.remediation(known, d["prerequisite"]).groupBy("record_id").agg(F.count("*").alias("todo"))
    needs = gap.requirements(d["employee"], d["requires"], state)
    before = gap.readiness(d["employee"], requirements(d)).select("employee_id", F.col("readiness").alias("readiness_before"))
    after = gap.readiness(d["employee"], needs).select("employee_id", F.col("readiness").alias("readiness_after"))
    met = gap.met(needs).groupBy("employee_id").agg(F.count("*").alias("met"))
    rows = last.join(raised, "record_id", "left").join(todo, "record_id", "left").join(before, "employee_id").join(after, "employee_id").join(met, "employee_id", "left")
    zero = F.lit(0)
    suggestions = F.when(F.coalesce("passed_before", F.lit(False)), 0).otherwise(F.coalesce("todo", zero))
    return rows.select("employee_id", "record_id", "course_id", replay.outcome(F.col("exam_score")).alias("outcome"), F.coalesce("raised", zero).alias("raised"), suggestions.cast("long").alias("suggestions"), "readiness_before", "readiness_after", F.coalesce("met", zero).alias("met"))


STREAMED = (
    PROFILE
    + """, gaps2 AS (SELECT e.employee_id, r.skill_id, r.importance, (r.required_level - coalesce(h.level, 0)) * r.importance AS weighted_gap FROM employee e JOIN requires r ON r.position_id = e.target_position_id LEFT JOIN profile h ON h.employee_id = e.employee_id AND h.skill_id = r.skill_id WHERE r.required_level > coalesce(h.level, 0) AND e.employee_id IN (SELECT employee_id FROM training_record)),
found2 AS (SELECT DISTINCT g.employee_id, t.course_id FROM gaps2 g JOIN teaches t USING (skill_id) WHERE (g.employee_id, t.course_id) NOT IN (SELECT employee_id, course_id FROM passed))"""
    + re.sub(r"\b(gaps|found)\b", r"\g<1>2", RANKED).replace("has_skill", "profile").replace("SELECT * FROM (SELECT *,", "SELECT employee_id, course_id, total, rank::INT AS rank FROM (SELECT *,")
)


@query(STREAMED)
def completion_stream(d: Domain) -> DataFrame:
    """Recommendations that the completion loop keeps after a stream of all records in three batches, some of them late."""
    d.written("has_skill")
    records = d["training_record"].select("record_id", "employee_id", "course_id", "exam_score")
    source = scratch(d.spark, "record-stream")
    for k, part in enumerate(("record_id % 5 = 1", "record_id % 5 > 1", "record_id % 5 = 0")):
        records.where(part).coalesce(1).write.parquet(f"{source}/{k}")
    stream = d.spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    path = scratch(d.spark, "completion-loop")
    loop.start(stream, path, scratch(d.spark, "completion-checkpoint"), d).awaitTermination()
    return loop.tables_at(d.spark, path)["recommendations"].read()
