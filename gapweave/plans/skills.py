"""The queries over the domain tables by name, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave import api
from gapweave.functions import text as T
from gapweave.operators import gap, graph, recall, replay, retrieval, team
from gapweave.sources.scratch import materialise
from gapweave.sources.views import Domain, duckdb_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: SQL that takes too long on large tables: tests compare it on the smallest ones.
SMALL_SQL: dict[str, str] = {}

#: Common table expressions behind the views, for several queries.
PARTS = """
req AS (SELECT e.employee_id, r.skill_id, coalesce(h.level, 0) AS current_level, r.required_level, r.importance FROM employee e JOIN requires r ON r.position_id = e.target_position_id LEFT JOIN has_skill h ON h.employee_id = e.employee_id AND h.skill_id = r.skill_id WHERE r.required_level > 0),
gaps AS (SELECT *, required_level - current_level AS gap, (required_level - current_level) * importance AS weighted_gap FROM req WHERE required_level > current_level),
passed AS (SELECT DISTINCT employee_id, course_id FROM training_record WHERE exam_score >= 70),
found AS (SELECT DISTINCT g.employee_id, t.course_id FROM gaps g JOIN teaches t USING (skill_id) WHERE (g.employee_id, t.course_id) NOT IN (SELECT employee_id, course_id FROM passed)),
ready AS (SELECT e.employee_id, count(*) FILTER (current_level < required_level) AS missing_count, coalesce(sum(greatest(0, required_level - current_level)), 0) AS total_gap, coalesce(sum(greatest(0, required_level - current_level) * importance), 0) AS weighted_total_gap, coalesce(round(sum(least(current_level, required_level) * importance)::DOUBLE / sum(required_level * importance), 6), 1) AS readiness FROM employee e LEFT JOIN req USING (employee_id) GROUP BY e.employee_id),
chain(course_id, ancestor_id, depth) AS (SELECT course_id, prerequisite_id, 1 FROM prerequisite UNION ALL SELECT c.course_id, p.prerequisite_id, c.depth + 1 FROM chain c JOIN prerequisite p ON p.course_id = c.ancestor_id),
marked AS (SELECT *, coalesce(max((exam_score >= 70)::INT) OVER (PARTITION BY employee_id, course_id ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS passed_before FROM training_record),
tiers AS (SELECT m.*, t.skill_id, exam_score >= 70 AND row_number() OVER (PARTITION BY m.employee_id, t.skill_id, c.difficulty, exam_score >= 70 ORDER BY record_id) = 1 AS raises FROM marked m JOIN course c USING (course_id) JOIN teaches t USING (course_id)),
events2 AS (SELECT t.*, CASE WHEN raises AND exam_score < 85 THEN 1 WHEN NOT raises AND exam_score >= 85 THEN 0 END AS ev, coalesce(h.level, 0) AS base FROM tiers t LEFT JOIN has_skill h USING (employee_id, skill_id)),
steps AS (SELECT *, least(4, base + coalesce(sum(raises::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS from_level, least(4, base + sum(raises::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS to_level, coalesce(last_value(ev IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS flagged_before, coalesce(last_value(ev IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS flagged FROM events2 WINDOW w AS (PARTITION BY employee_id, skill_id ORDER BY record_id))
"""


def query(sql: str | None = None, small: bool = False):
    """Registers a query; its SQL may use the views and PARTS. `small`: SQL for tests on small tables only."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if sql:
            (SMALL_SQL if small else ORACLE_SQL)[f.__name__] = f"WITH RECURSIVE {duckdb_views()},{PARTS}{sql}"
        return f

    return register


def requirements(d: Domain) -> DataFrame:
    return gap.requirements(d["employee"], d["requires"], d["has_skill"])


def gaps(d: Domain) -> DataFrame:
    return gap.gaps(requirements(d))


def found(d: Domain) -> DataFrame:
    return recall.candidates(gaps(d), d["teaches"], replay.passed_courses(d["training_record"]))


@query("SELECT employee_id, skill_id, current_level, required_level, importance, gap, round(gap / required_level, 6) AS gap_ratio, weighted_gap FROM gaps")
def gap_list(d: Domain) -> DataFrame:
    return gaps(d).withColumn("gap_ratio", F.round("gap_ratio", 6))


@query("SELECT employee_id, missing_count, total_gap, weighted_total_gap, readiness FROM ready")
def gap_readiness(d: Domain) -> DataFrame:
    return gap.readiness(d["employee"], requirements(d))


@query("SELECT employee_id, skill_id, current_level, required_level, importance FROM req WHERE current_level >= required_level")
def gap_met(d: Domain) -> DataFrame:
    return gap.met(requirements(d))


@query("SELECT h.employee_id, h.skill_id, h.level FROM has_skill h JOIN employee e USING (employee_id) WHERE NOT EXISTS (FROM requires r WHERE r.position_id = e.target_position_id AND r.skill_id = h.skill_id)")
def gap_extra(d: Domain) -> DataFrame:
    return gap.extra(d["employee"], d["requires"], d["has_skill"])


@query("SELECT employee_id, skill_id, CASE WHEN current_level >= required_level THEN 'met' WHEN current_level = 0 THEN 'missing' ELSE 'learning' END AS status, CASE WHEN importance >= 5 THEN 'core' ELSE 'side' END || '-' || CASE WHEN required_level - current_level >= 3 THEN 'deep' ELSE 'shallow' END AS label FROM req")
def skill_status(d: Domain) -> DataFrame:
    return requirements(d).select("employee_id", "skill_id", gap.status(F.col("current_level"), F.col("required_level")).alias("status"), gap.summary_label(F.col("importance"), F.col("required_level"), F.col("current_level")).alias("label"))


@query("SELECT employee_id, course_id FROM found")
def candidate_recall(d: Domain) -> DataFrame:
    return found(d)


@query("SELECT g.employee_id, g.skill_id FROM gaps g WHERE NOT EXISTS (FROM found f JOIN teaches t USING (course_id) WHERE f.employee_id = g.employee_id AND t.skill_id = g.skill_id)")
def candidate_uncovered(d: Domain) -> DataFrame:
    return recall.never_recalled(gaps(d), d["teaches"], replay.passed_courses(d["training_record"]))


@query("SELECT DISTINCT f.employee_id, p.prerequisite_id AS course_id FROM found f JOIN prerequisite p USING (course_id) WHERE (f.employee_id, p.prerequisite_id) NOT IN (SELECT employee_id, course_id FROM found)")
def prereq_context(d: Domain) -> DataFrame:
    return api.prerequisite_context(d, d.written("has_skill"), replay.passed_courses(d["training_record"]))


RANKED = """, totals AS (SELECT employee_id, sum(weighted_gap) AS s FROM gaps GROUP BY employee_id),
cov AS (SELECT f.employee_id, f.course_id, sum(weighted_gap) AS covered, max(importance) AS top FROM found f JOIN teaches t USING (course_id) JOIN gaps g ON g.employee_id = f.employee_id AND g.skill_id = t.skill_id GROUP BY ALL),
lev AS (SELECT x.employee_id, x.course_id, avg(coalesce(h.level, 0)) AS a FROM (SELECT employee_id, course_id FROM found UNION SELECT employee_id, prerequisite_id FROM found JOIN prerequisite USING (course_id)) x JOIN teaches t USING (course_id) LEFT JOIN has_skill h ON h.employee_id = x.employee_id AND h.skill_id = t.skill_id GROUP BY ALL),
pre AS (SELECT f.employee_id, f.course_id, avg(CASE WHEN l.a >= 2 THEN 1.0 ELSE 0.0 END) AS p FROM found f JOIN prerequisite p USING (course_id) LEFT JOIN lev l ON l.employee_id = f.employee_id AND l.course_id = p.prerequisite_id GROUP BY ALL),
fac AS (SELECT f.employee_id, f.course_id, coalesce(covered / s, 0) AS g, coalesce(top / 5, 0) AS i, 1 - abs(CASE difficulty WHEN 'beginner' THEN 0 WHEN 'intermediate' THEN 1 ELSE 2 END - CASE WHEN a <= 1 THEN 0 WHEN a <= 2 THEN 1 ELSE 2 END) / 2 AS m, coalesce(p, 1) AS q, 1 / (1 + duration_minutes / 60) AS t
  FROM found f JOIN course c USING (course_id) JOIN totals USING (employee_id) LEFT JOIN cov USING (employee_id, course_id) LEFT JOIN lev USING (employee_id, course_id) LEFT JOIN pre USING (employee_id, course_id)),
scored AS (SELECT employee_id, course_id, round(g, 6) AS gap_coverage, round(i, 6) AS importance, round(m, 6) AS difficulty_match, round(q, 6) AS prerequisite, round(t, 6) AS time_cost, round(0.3::DOUBLE * g + 0.25::DOUBLE * i + 0.2::DOUBLE * m + 0.15::DOUBLE * q + 0.1::DOUBLE * t, 6) AS total FROM fac)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY total DESC, course_id) AS rank FROM scored) WHERE rank <= 5"""


def ranked_courses(d: Domain) -> DataFrame:
    return api.recommend(d, 5, replay.passed_courses(d["training_record"]))


@query(RANKED)
def course_ranking_topk(d: Domain) -> DataFrame:
    return ranked_courses(d)


@query("SELECT course_id, ancestor_id, max(depth) AS depth FROM chain GROUP BY ALL")
def prereq_chain(d: Domain) -> DataFrame:
    return graph.chains(materialise(d["prerequisite"], "prerequisites"))


PRUNED = """, lev AS (SELECT e.employee_id, t.course_id, avg(coalesce(h.level, 0)) AS a FROM employee e CROSS JOIN teaches t LEFT JOIN has_skill h ON h.employee_id = e.employee_id AND h.skill_id = t.skill_id GROUP BY ALL),
blocked AS (SELECT employee_id, course_id FROM passed UNION SELECT l.employee_id, l.course_id FROM lev l JOIN course c USING (course_id) WHERE a + 1e-9 >= CASE difficulty WHEN 'beginner' THEN 2 WHEN 'intermediate' THEN 3 ELSE 4 END),
walk(employee_id, course_id, kept) AS (SELECT f.employee_id, f.course_id, (f.employee_id, f.course_id) NOT IN (SELECT employee_id, course_id FROM blocked) FROM found f
  UNION SELECT w.employee_id, p.prerequisite_id, (w.employee_id, p.prerequisite_id) NOT IN (SELECT employee_id, course_id FROM blocked) FROM walk w JOIN prerequisite p USING (course_id) WHERE w.kept)
SELECT DISTINCT employee_id, course_id, kept FROM walk"""


def expanded(d: Domain) -> DataFrame:
    return api.reachable(d, d.written("has_skill"), replay.passed_courses(d["training_record"]))


@query(PRUNED)
def prune_expand(d: Domain) -> DataFrame:
    return expanded(d)


def ordered(d: Domain) -> DataFrame:
    return api.ordered(d, d.written("has_skill"), replay.passed_courses(d["training_record"]))


ORDERED = PRUNED[: PRUNED.index("SELECT DISTINCT employee_id, course_id, kept FROM walk")] + """, kept AS (SELECT DISTINCT employee_id, course_id FROM walk WHERE kept),
weights AS (SELECT k.employee_id, k.course_id, coalesce(sum(g.weighted_gap), 0) AS priority FROM kept k LEFT JOIN teaches t USING (course_id) LEFT JOIN gaps g ON g.employee_id = k.employee_id AND g.skill_id = t.skill_id GROUP BY ALL),
needs AS (SELECT w.employee_id, w.course_id, w.priority, coalesce(list(k.course_id) FILTER (k.course_id IS NOT NULL), []) AS before FROM weights w LEFT JOIN prerequisite p USING (course_id) LEFT JOIN kept k ON k.employee_id = w.employee_id AND k.course_id = p.prerequisite_id GROUP BY ALL),
took(employee_id, position, done) AS (SELECT DISTINCT employee_id, 0, []::BIGINT[] FROM kept
  UNION ALL SELECT t.employee_id, t.position + 1, list_append(any_value(t.done), arg_min(n.course_id, {'p': -n.priority, 'c': n.course_id})) FROM took t JOIN needs n ON n.employee_id = t.employee_id WHERE NOT list_contains(t.done, n.course_id) AND list_has_all(t.done, n.before) GROUP BY t.employee_id, t.position),
sorted AS (SELECT employee_id, done[-1] AS course_id, position::INT AS position FROM took WHERE position > 0)
"""


@query(ORDERED + "SELECT employee_id, course_id, position FROM sorted", small=True)
def topo_order(d: Domain) -> DataFrame:
    return ordered(d).drop("priority")


@query(ORDERED + "SELECT employee_id, course_id, priority FROM weights")
def course_priority(d: Domain) -> DataFrame:
    rows = api.prioritised(d, d.written("has_skill"), replay.passed_courses(d["training_record"]))
    return rows.select("employee_id", "course_id", F.col("priority").cast("long").alias("priority"))


PACKED = ORDERED + """, packed(employee_id, position, course_id, minutes, first_week, parts, week, used) AS (SELECT employee_id, 0, NULL::BIGINT, 0.0::DOUBLE, 1, 0, 1, 0.0::DOUBLE FROM (SELECT DISTINCT employee_id FROM sorted)
  UNION ALL SELECT employee_id, position, course_id, minutes, first_week, parts, first_week + parts - 1, CASE WHEN parts > 1 THEN minutes - (parts - 1) * 240 WHEN first_week > week THEN minutes ELSE used + minutes END FROM
    (SELECT p.employee_id, s.position, s.course_id, c.duration_minutes::DOUBLE AS minutes, p.week, p.used, CASE WHEN p.used > 1e-9 AND p.used + c.duration_minutes > 240 + 1e-9 THEN p.week + 1 ELSE p.week END AS first_week, greatest(1, ceil((c.duration_minutes - 1e-9) / 240))::INT AS parts FROM packed p JOIN sorted s ON s.employee_id = p.employee_id AND s.position = p.position + 1 JOIN course c ON c.course_id = s.course_id)),
plan AS (SELECT employee_id, (first_week + k)::INT AS week, position::INT AS position, course_id, least(240, minutes - k * 240)::DOUBLE AS minutes, k > 0 AS continued FROM (SELECT *, unnest(range(parts)) AS k FROM packed WHERE position > 0))
"""


@query(PACKED + "SELECT * FROM plan", small=True)
def week_plan(d: Domain) -> DataFrame:
    return api.scheduled(d, d.written("has_skill"), replay.passed_courses(d["training_record"]), hours_per_week=4)


@query(PACKED + "SELECT employee_id, count(DISTINCT course_id) AS course_count, max(week) AS planned_weeks, sum(minutes) AS total_minutes, max(week) <= 8 AS fits_deadline FROM plan GROUP BY employee_id", small=True)
def path_totals(d: Domain) -> DataFrame:
    return api.path_totals(d, d.written("has_skill"), replay.passed_courses(d["training_record"]), hours_per_week=4, deadline_weeks=8)


@query("""SELECT 'prerequisite without course' AS kind, p.prerequisite_id::VARCHAR AS id, count(*) AS n FROM prerequisite p ANTI JOIN course c ON c.course_id = p.prerequisite_id GROUP BY ALL
UNION ALL SELECT 'taught skill unknown', skill_id, count(*) FROM teaches ANTI JOIN skill USING (skill_id) GROUP BY ALL
UNION ALL SELECT 'required skill never taught', skill_id, count(*) FROM requires ANTI JOIN teaches USING (skill_id) GROUP BY ALL
UNION ALL SELECT 'record of an unknown course', course_id::VARCHAR, count(*) FROM training_record ANTI JOIN course USING (course_id) GROUP BY ALL
UNION ALL SELECT 'record of an unknown employee', employee_id::VARCHAR, count(*) FROM training_record ANTI JOIN employee USING (employee_id) GROUP BY ALL""")
def integrity_errors(d: Domain) -> DataFrame:
    checks = [
        (d["prerequisite"], "prerequisite_id", d["course"], "course_id", "prerequisite without course"),
        (d["teaches"], "skill_id", d["skill"], "skill_id", "taught skill unknown"),
        (d["requires"], "skill_id", d["teaches"], "skill_id", "required skill never taught"),
        (d["training_record"], "course_id", d["course"], "course_id", "record of an unknown course"),
        (d["training_record"], "employee_id", d["employee"], "employee_id", "record of an unknown employee"),
    ]
    return reduce(DataFrame.unionAll, [graph.dangling(*c) for c in checks])


REACHED = ", reached(course_id, node) AS (SELECT course_id, prerequisite_id FROM draft_prerequisite UNION SELECT r.course_id, p.prerequisite_id FROM reached r JOIN draft_prerequisite p ON p.course_id = r.node)"


@query(REACHED + " SELECT course_id FROM reached WHERE course_id = node")
def dag_check(d: Domain) -> DataFrame:
    return graph.on_cycles(d["draft_prerequisite"])


CYCLES = """, walk(course_id, node, path) AS (SELECT course_id, prerequisite_id, [course_id, prerequisite_id] FROM draft_prerequisite WHERE prerequisite_id >= course_id
  UNION ALL SELECT w.course_id, p.prerequisite_id, list_append(path, p.prerequisite_id) FROM walk w JOIN draft_prerequisite p ON p.course_id = w.node WHERE w.node <> w.course_id AND p.prerequisite_id >= w.course_id AND NOT list_contains(path[2:], p.prerequisite_id))
SELECT course_id, arg_min(path, {'n': len(path), 'path': path}) AS path FROM walk WHERE course_id = node GROUP BY course_id"""


@query(CYCLES)
def cycle_path(d: Domain) -> DataFrame:
    return graph.cycle_paths(d["draft_prerequisite"])


CLOSED = """, closed(course_id) AS (SELECT DISTINCT course_id FROM training_record JOIN course USING (course_id) WHERE exam_score < 70 UNION SELECT p.prerequisite_id FROM closed c JOIN prerequisite p USING (course_id))
SELECT course_id, coalesce((SELECT list_sort(list(skill_id)) FROM teaches t WHERE t.course_id = c.course_id), []) AS skills, coalesce((SELECT list_sort(list(prerequisite_id)) FROM prerequisite p WHERE p.course_id = c.course_id), []) AS prerequisites FROM closed c"""


@query(CLOSED)
def course_closure(d: Domain) -> DataFrame:
    roots = d["training_record"].where("exam_score < 70").join(d["course"], "course_id", "left_semi")
    return graph.with_lists(graph.closure(roots, d["prerequisite"]), d["teaches"], d["prerequisite"])


@query("""SELECT course_id, count(*) AS n, sum(duration_minutes) AS total_minutes, list(ancestor_id ORDER BY depth DESC, name, ancestor_id) AS chain, list_sort(list(ancestor_id) FILTER (direct)) AS direct
FROM (SELECT d.course_id, d.ancestor_id, d.depth, c.name, c.duration_minutes, (d.course_id, d.ancestor_id) IN (SELECT course_id, prerequisite_id FROM prerequisite) AS direct FROM (SELECT course_id, ancestor_id, max(depth) AS depth FROM chain GROUP BY ALL) d JOIN course c ON c.course_id = d.ancestor_id) GROUP BY course_id""")
def chain_summary(d: Domain) -> DataFrame:
    deep = graph.chains(materialise(d["prerequisite"], "prerequisites"))
    about = d["course"].select(F.col("course_id").alias("ancestor_id"), "name", "duration_minutes")
    direct = d["prerequisite"].select("course_id", F.col("prerequisite_id").alias("ancestor_id"), F.lit(True).alias("direct"))
    rows = deep.join(about, "ancestor_id").join(direct, ["course_id", "ancestor_id"], "left")
    chain = F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "name", "ancestor_id")))
    return rows.groupBy("course_id").agg(F.count("*").alias("n"), F.sum("duration_minutes").alias("total_minutes"), chain.alias("all"), F.array_sort(F.collect_list(F.when(F.col("direct"), F.col("ancestor_id")))).alias("direct")).select("course_id", "n", "total_minutes", F.col("all.ancestor_id").alias("chain"), "direct")


@query("SELECT 'skill' AS label, count(*) AS n FROM skill UNION ALL SELECT 'course', count(*) FROM course UNION ALL SELECT 'employee', count(*) FROM employee UNION ALL SELECT 'requires', count(*) FROM requires UNION ALL SELECT 'teaches', count(*) FROM teaches UNION ALL SELECT 'prerequisite', count(*) FROM prerequisite UNION ALL SELECT 'has_skill', count(*) FROM has_skill")
def edge_counts(d: Domain) -> DataFrame:
    return graph.counts({k: d[k] for k in ("skill", "course", "employee", "requires", "teaches", "prerequisite", "has_skill")})


def replayed(d: Domain) -> DataFrame:
    return replay.steps(d["training_record"], d["course"], d["teaches"], d["has_skill"])


@query("SELECT employee_id, record_id, course_id, skill_id, exam_score, passed_before, raises, from_level::INT AS from_level, to_level::INT AS to_level, flagged_before, flagged FROM steps")
def replay_steps(d: Domain) -> DataFrame:
    return replayed(d)


@query("SELECT employee_id, record_id, course_id, skill_id, from_level::INT AS from_level, to_level::INT AS to_level, kind FROM (SELECT *, CASE WHEN exam_score < 70 AND NOT passed_before THEN 'failed' WHEN raises THEN 'raised' WHEN NOT raises AND exam_score >= 85 AND flagged_before THEN 'cleared' END AS kind FROM steps) WHERE kind IS NOT NULL")
def replay_changes(d: Domain) -> DataFrame:
    return replay.changes(replayed(d))


@query(", fin AS (SELECT employee_id, skill_id, max_by(to_level, record_id) AS l, max_by(flagged, record_id) AS f FROM steps GROUP BY ALL) SELECT employee_id, skill_id, coalesce(l, level)::INT AS level, coalesce(f, false) AS flagged FROM has_skill FULL JOIN fin USING (employee_id, skill_id)")
def replay_profile(d: Domain) -> DataFrame:
    return replay.profile(replayed(d), d["has_skill"])


@query(", todo AS (SELECT t.record_id, p.prerequisite_id FROM training_record t JOIN prerequisite p USING (course_id) WHERE exam_score < 70 AND (t.employee_id, p.prerequisite_id) NOT IN (SELECT employee_id, course_id FROM passed)) SELECT record_id, employee_id, course_id, coalesce(prerequisite_id, course_id) AS suggested_id, prerequisite_id IS NULL AS is_retake FROM training_record LEFT JOIN todo USING (record_id) WHERE exam_score < 70")
def remediation(d: Domain) -> DataFrame:
    return replay.remediation(d["training_record"], d["prerequisite"])


@query("SELECT department, skill_id, lacking, is_core, round(lacking / members, 6) AS share, place FROM (SELECT *, row_number() OVER (PARTITION BY department ORDER BY lacking DESC, skill_id) AS place FROM (SELECT department, skill_id, count(*) AS lacking, max(importance >= 5) AS is_core FROM gaps JOIN employee USING (employee_id) GROUP BY ALL)) JOIN (SELECT department, count(*) AS members FROM employee GROUP BY ALL) USING (department) WHERE place <= 8")
def team_gaps(d: Domain) -> DataFrame:
    return team.team_gaps(gaps(d), d["employee"], limit=8)


@query("SELECT department, CASE WHEN readiness >= 0.8 THEN 'ready' WHEN readiness >= 0.5 THEN 'close' ELSE 'far' END AS bucket, count(*) AS n, round(avg(readiness), 6) AS avg_readiness FROM ready JOIN employee USING (employee_id) GROUP BY ALL")
def team_buckets(d: Domain) -> DataFrame:
    return team.buckets(gap.readiness(d["employee"], requirements(d)), d["employee"])


@query("SELECT e.employee_id, count(*) FILTER (exam_score >= 70) AS completions, count(DISTINCT course_id) FILTER (exam_score >= 70) AS courses, round(avg((exam_score >= 70)::INT), 6) AS pass_rate, round_even(avg(exam_score), 1) AS mean_score FROM employee e LEFT JOIN training_record USING (employee_id) GROUP BY ALL")
def member_stats(d: Domain) -> DataFrame:
    return team.member_stats(d["employee"], d["training_record"])


@query("SELECT employee_id, place, record_id, course_id, exam_score FROM (SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY completed_at DESC, record_id DESC) AS place FROM training_record) WHERE place <= 3")
def recent_records(d: Domain) -> DataFrame:
    return team.recent(d["training_record"], each=3)


@query("SELECT employee_id, skill_id, score, CASE WHEN score >= 85 THEN 'solid' WHEN score >= 70 THEN 'consolidate' ELSE 'fail' END AS verdict FROM (SELECT employee_id, skill_id, exam_score AS score, row_number() OVER (PARTITION BY employee_id, skill_id ORDER BY completed_at DESC, record_id DESC) AS n FROM training_record JOIN teaches USING (course_id)) WHERE n = 1")
def latest_assessment(d: Domain) -> DataFrame:
    return team.latest_assessment(d["training_record"], d["teaches"])


@query("SELECT skill_id, count(*) AS attempts, round(avg(exam_score), 6) AS mean_score, round(avg((exam_score >= 70)::INT), 6) AS pass_rate FROM training_record JOIN teaches USING (course_id) GROUP BY ALL")
def assessment_stats(d: Domain) -> DataFrame:
    return team.assessment_stats(d["training_record"], d["teaches"])


@query("SELECT skill_id, max(importance) AS importance, max(required_level) AS required_level, list_sort(list_distinct(list(position_id))) AS sources FROM requires GROUP BY ALL")
def merge_sources(d: Domain) -> DataFrame:
    return d["requires"].groupBy("skill_id").agg(F.max("importance").alias("importance"), F.max("required_level").alias("required_level"), F.sort_array(F.collect_set("position_id")).alias("sources"))


LABEL = r"regexp_replace(trim(regexp_replace(lower(x), '\s+', ' ', 'g')), '^[ .;:,]+|[ .;:,]+$', '', 'g')"


@query(rf"SELECT doc_id, md5({LABEL.replace('lower(x)', 'lower(text)')}) AS label FROM documents")
def normalize_text(d: Domain) -> DataFrame:
    return d["documents"].select("doc_id", F.md5(T.label(F.col("text"))).alias("label"))


NAMES = rf""", k AS (SELECT DISTINCT p_name AS key, {LABEL.replace('lower(x)', 'lower(p_name)')} AS k, list_distinct([t FOR t IN string_split_regex(lower(p_name), '[^0-9a-z一-鿿]+') IF t <> '']) AS kt FROM part),
i AS (SELECT p_brand AS item_id, min(p_type) AS name, [max(p_name)] AS al, {LABEL.replace('lower(x)', 'lower(min(p_type))')} AS n, list_distinct([t FOR t IN string_split_regex(lower(concat(min(p_type), ' ', max(p_name))), '[^0-9a-z一-鿿]+') IF t <> '']) AS nt FROM part GROUP BY p_brand),
j AS (SELECT key, item_id, name, CASE WHEN len(kt) > 0 THEN len(list_intersect(kt, nt)) / len(kt) ELSE 0 END AS share, CASE WHEN trim(key) = item_id THEN 1 WHEN k = n THEN 2 WHEN k = {LABEL.replace('lower(x)', 'lower(al[1])')} THEN 3 WHEN contains(n, k) OR contains(k, n) THEN 4 WHEN (CASE WHEN len(kt) > 0 THEN len(list_intersect(kt, nt)) / len(kt) ELSE 0 END) >= 0.5 THEN 5 END AS tier FROM k CROSS JOIN i),
b AS (SELECT key, item_id, tier, row_number() OVER (PARTITION BY key ORDER BY tier, CASE WHEN tier = 5 THEN -share ELSE -1 END, CASE WHEN tier = 5 THEN length(name) ELSE 0 END, name, item_id) AS n FROM j WHERE tier IS NOT NULL)
SELECT k.key, b.item_id, b.tier FROM (SELECT DISTINCT key FROM k) k LEFT JOIN b ON b.key = k.key AND b.n = 1"""


@query(NAMES)
def resolve_name(d: Domain) -> DataFrame:
    items = d["part"].groupBy(F.col("p_brand").alias("item_id")).agg(F.min("p_type").alias("name"), F.array(F.max("p_name")).alias("aliases"))
    return retrieval.resolved(d["part"].select(F.col("p_name").alias("key")), items, threshold=0.5)


def vectors_sql(table: str, key: str) -> str:
    """Common table expressions of the lexical vectors of a table: {key}_v with key, dim and value."""
    return rf""", {key}_w AS (SELECT {key}, [x FOR x IN string_split_regex(lower(text), '\s+') IF x <> ''] AS w FROM {table}),
{key}_t AS (SELECT {key}, x, count(*) AS n FROM (SELECT {key}, unnest(w) AS x FROM {key}_w) GROUP BY ALL),
{key}_f AS (SELECT {key}, x AS t, 2.0::DOUBLE * n AS u FROM {key}_t UNION ALL SELECT {key}, unnest([substr(x, i, 2) FOR i IN range(1, length(x))]), n FROM {key}_t UNION ALL SELECT {key}, unnest([substr(x, i, 3) FOR i IN range(1, length(x) - 1)]), n FROM {key}_t),
{key}_r AS (SELECT {key}, (('0x' || substr(md5(t), 1, 8))::BIGINT % 512)::INT AS dim, sum(u * CASE WHEN ('0x' || substr(md5(t), 9, 2))::BIGINT % 2 = 1 THEN 1 ELSE -1 END) AS rs FROM {key}_f GROUP BY ALL HAVING rs <> 0),
{key}_v AS (SELECT {key}, dim, rs / sqrt(sum(rs * rs) OVER (PARTITION BY {key})) AS value FROM {key}_r)"""


@query(vectors_sql("benchmark", "item_id") + " SELECT item_id, dim, round(value, 6) AS value FROM item_id_v")
def lexical_vectors(d: Domain) -> DataFrame:
    return retrieval.lexical_vectors(d["benchmark"], "item_id", "text").withColumn("value", F.round("value", 6))


HITS = vectors_sql("benchmark", "item_id") + vectors_sql("documents", "doc_id") + """, hits AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM
  (SELECT i.item_id, d.doc_id, coalesce(s.score, 0) AS score FROM benchmark i CROSS JOIN documents d LEFT JOIN (SELECT a.item_id, b.doc_id, round(sum(a.value * b.value), 6) AS score FROM item_id_v a JOIN doc_id_v b USING (dim) GROUP BY ALL) s ON s.item_id = i.item_id AND s.doc_id = d.doc_id))"""


def hits(d: Domain, k: int) -> DataFrame:
    return retrieval.lexical_search(d["benchmark"], "item_id", "text", d["documents"], "doc_id", "text", k)


@query(HITS + " SELECT item_id, doc_id, score, rank FROM hits WHERE rank <= 4")
def lexical_topk(d: Domain) -> DataFrame:
    """The documents nearest to every benchmark item."""
    return hits(d, 4)


COSINES = """, v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.v, v.v), 6) AS score FROM v CROSS JOIN v q WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 4"""


@query(COSINES)
def vector_topk(d: Domain) -> DataFrame:
    return retrieval.vector_top(d["embeddings"].where("vec_id % 50 = 0"), d["embeddings"], "vec_id", "embedding", 4)


@query()
def vector_neighbours(d: Domain) -> DataFrame:
    """The neighbours of every vector; vector_topk searches only for those that its SQL names."""
    return retrieval.vector_top(d["embeddings"], d["embeddings"], "vec_id", "embedding", 4)


def tokens_sql(text: str) -> str:
    """The distinct Latin words and pairs of neighbouring Chinese characters of a text."""
    chinese = f"regexp_replace({text}, '[^一-鿿]', '', 'g')"
    return f"list_distinct(list_concat(regexp_extract_all(lower({text}), '[a-z0-9]+'), [substr({chinese}, i, 2) FOR i IN range(1, length({chinese}))]))"


FUSED = HITS + f""", pool AS (SELECT h.item_id, h.doc_id, h.score, {tokens_sql("i.text")} AS q, {tokens_sql("d.text")} AS t FROM hits h JOIN benchmark i USING (item_id) JOIN documents d USING (doc_id) WHERE rank <= 12),
fused AS (SELECT item_id, doc_id, score, CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(q) ELSE 0 END AS share FROM pool)
SELECT item_id, doc_id, score, round(share, 6) AS lexical, round(0.6::DOUBLE * score + 0.4::DOUBLE * share, 6) AS fused, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(0.6::DOUBLE * score + 0.4::DOUBLE * share, 6) DESC, score DESC, doc_id) AS place FROM fused) WHERE place <= 4"""


@query(FUSED)
def rerank(d: Domain) -> DataFrame:
    """Four documents for each benchmark item, chosen from the twelve nearest."""
    pool = materialise(hits(d, retrieval.POOL * 4), "pool")
    both = pool.join(d["benchmark"].select("item_id", F.col("text").alias("query_text")), "item_id").join(d["documents"].select("doc_id", F.col("text").alias("doc_text")), "doc_id")
    return retrieval.reranked(both, "query_text", "doc_text", "item_id", "doc_id", 4)


@query(r"SELECT page_id, coalesce(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')), '') AS title, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS plain FROM pages")
def html_extract(d: Domain) -> DataFrame:
    return d["pages"].select("page_id", F.coalesce(T.html_text(F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1)), F.lit("")).alias("title"), F.md5(T.html_text(F.col("html"), unescape=False)).alias("plain"))


def plan_sql(p: str, levels: str, passed: str) -> str:
    """Common table expressions of a whole plan ({p}_kept) from a table of levels and one of passed courses."""
    return f""", {p}_gaps AS (SELECT e.employee_id, r.skill_id FROM employee e JOIN requires r ON r.position_id = e.target_position_id LEFT JOIN {levels} h ON h.employee_id = e.employee_id AND h.skill_id = r.skill_id WHERE r.required_level > coalesce(h.level, 0)),
{p}_found AS (SELECT DISTINCT g.employee_id, t.course_id FROM {p}_gaps g JOIN teaches t USING (skill_id) WHERE (g.employee_id, t.course_id) NOT IN (SELECT employee_id, course_id FROM {passed})),
{p}_lev AS (SELECT e.employee_id, t.course_id, avg(coalesce(h.level, 0)) AS a FROM employee e CROSS JOIN teaches t LEFT JOIN {levels} h ON h.employee_id = e.employee_id AND h.skill_id = t.skill_id GROUP BY ALL),
{p}_blocked AS (SELECT employee_id, course_id FROM {passed} UNION SELECT l.employee_id, l.course_id FROM {p}_lev l JOIN course c USING (course_id) WHERE a + 1e-9 >= CASE difficulty WHEN 'beginner' THEN 2 WHEN 'intermediate' THEN 3 ELSE 4 END),
{p}_walk(employee_id, course_id, kept) AS (SELECT f.employee_id, f.course_id, (f.employee_id, f.course_id) NOT IN (SELECT employee_id, course_id FROM {p}_blocked) FROM {p}_found f
  UNION SELECT w.employee_id, r.prerequisite_id, (w.employee_id, r.prerequisite_id) NOT IN (SELECT employee_id, course_id FROM {p}_blocked) FROM {p}_walk w JOIN prerequisite r USING (course_id) WHERE w.kept),
{p}_kept AS (SELECT DISTINCT employee_id, course_id FROM {p}_walk WHERE kept)"""


PROFILE = ", fin AS (SELECT employee_id, skill_id, max_by(to_level, record_id) AS l FROM steps GROUP BY ALL), profile AS (SELECT employee_id, skill_id, coalesce(l, level) AS level FROM has_skill FULL JOIN fin USING (employee_id, skill_id)), nothing AS (SELECT employee_id, course_id FROM passed WHERE false)"
PLANS = PROFILE + plan_sql("old", "has_skill", "nothing") + plan_sql("new", "profile", "passed") + " SELECT coalesce(o.employee_id, n.employee_id) AS employee_id, coalesce(o.course_id, n.course_id) AS course_id, CASE WHEN n.course_id IS NULL THEN 'removed' ELSE 'added' END AS change FROM old_kept o FULL JOIN new_kept n ON o.employee_id = n.employee_id AND o.course_id = n.course_id WHERE o.course_id IS NULL OR n.course_id IS NULL"


def profile(d: Domain) -> DataFrame:
    """Levels after all training records."""
    return materialise(replay.profile(replayed(d), d["has_skill"]), "profile")


@query(PLANS)
def plan_diff(d: Domain) -> DataFrame:
    """Courses that the whole plan after the replay lacks or has anew against the plan from the levels before."""
    return plans_compared(d, with_place=False)


@query()
def plan_changes(d: Domain) -> DataFrame:
    """The same with each course's place in its plan, by which a report lists them."""
    return plans_compared(d, with_place=True)


def plans_compared(d: Domain, with_place: bool) -> DataFrame:
    return api.plan_changes(d, d.written("has_skill"), profile(d), materialise(replay.passed_courses(d["training_record"]), "passed"), with_place)
