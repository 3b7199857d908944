"""Look-ups on the course graph, quizzes and their grading, progress, reports and the loop that a finished course sets off.

Keys that are null match nothing. Ties are broken by the smaller id. Lists are sorted as each function says. Percentages
and means are rounded half to even, as whole numbers unless said otherwise. Empty tables give empty results (totals: one
row of zeros and nulls). Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapweave.operators.gap import bucket
from gapweave.operators.recall import SATISFIED_LEVEL, rank_of
from gapweave.operators.replay import PASS, SOLID
from gapweave.sources.scratch import materialise

#: What a learner and a manager read for a status, a bucket and a verdict (fixed values).
STATUS_LABELS = {"met": "已达标", "learning": "提升中", "missing": "待补齐", "extra": "岗位外技能"}
BUCKET_LABELS = {"ready": "已达标", "close": "接近达标", "far": "差距较大"}
VERDICT_LABELS = {"excellent": "优秀", "passed": "通过", "failed": "未通过"}
#: Questions of a quiz, wrong options of a question, and entries of capped lists.
QUESTIONS, WRONG, TOP = 5, 3, 8
#: Skills of a library, at most: they are a list that people keep.
MOST_SKILLS = 5_000
#: Courses of a task that meets them with all skills, and how many times as many digests as are needed lie below a bound.
COURSES_OF_TASK, SPARE = 50_000, 20


def labelled(value: Column, labels: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(value == k, F.lit(v)) for k, v in labels.items()])


def percent(share: Column) -> Column:
    return F.bround(share * 100).cast("long")


def ordered(gaps: DataFrame) -> DataFrame:
    """place: the largest gap first, then the most important skill, then the smaller skill_id."""
    order = Window.partitionBy("employee_id").orderBy(F.desc("gap"), F.desc("importance"), "skill_id")
    return gaps.withColumn("place", F.row_number().over(order))


def position_skills(requires: DataFrame, job: DataFrame) -> DataFrame:
    """What each position requires, the most important first; positions that require nothing have one row without skill."""
    order = Window.partitionBy("position_id").orderBy(F.desc("importance"), "skill_id")
    return job.join(requires, "position_id", "left").withColumn("place", F.row_number().over(order)).select("position_id", "name", "place", "skill_id", "importance", "required_level")


def skill_courses(teaches: DataFrame, course: DataFrame) -> DataFrame:
    """skill_id, n and the names of the courses that teach it, sorted."""
    rows = teaches.join(course.select("course_id", "name"), "course_id")
    return rows.groupBy("skill_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("name")).alias("courses"))


def time_cost(minutes: Column) -> Column:
    return F.when(minutes <= 60, "较低").when(minutes <= 120, "适中").otherwise("较高")


def duration(minutes: Column) -> Column:
    return F.when(minutes >= 60, F.format_string("约 %.1f 小时", minutes / 60)).otherwise(F.concat(minutes.cast("string"), F.lit(" 分钟")))


def reasons(ranked: DataFrame, gaps: DataFrame, course: DataFrame, teaches: DataFrame, prerequisite: DataFrame, has_skill: DataFrame) -> DataFrame:
    """employee_id, course_id and reasons: a sentence each on gaps, difficulty, prerequisites and time of ranked courses."""
    key = ["employee_id", "course_id"]
    taught = ranked.select(*key).join(teaches, "course_id")
    facts = taught.join(gaps.select("employee_id", "skill_id", "gap", "importance", "current_level", "required_level"), ["employee_id", "skill_id"], "left").join(has_skill.select("employee_id", "skill_id", "level"), ["employee_id", "skill_id"], "left")
    one = F.format_string("%s(当前 %d → 要求 %d,重要度 %.1f)", "skill_id", "current_level", "required_level", F.col("importance").cast("double"))
    sorted_ = F.array_sort(F.collect_list(F.when(F.col("gap") > 0, F.struct((-F.col("gap")).alias("g"), (-F.col("importance")).alias("i"), "skill_id", one.alias("text")))))
    facts = facts.groupBy(*key).agg(sorted_.alias("gaps"), F.avg(F.coalesce("level", F.lit(0))).alias("average"))
    levels = has_skill.select("employee_id", "skill_id", "level")
    needed = ranked.select(*key).join(prerequisite, "course_id")
    own = needed.select("employee_id", "prerequisite_id").distinct().join(teaches.withColumnRenamed("course_id", "prerequisite_id"), "prerequisite_id").join(levels, ["employee_id", "skill_id"], "left")
    own = own.groupBy("employee_id", "prerequisite_id").agg((F.avg(F.coalesce("level", F.lit(0))) >= SATISFIED_LEVEL).alias("ok"))
    named = needed.join(own, ["employee_id", "prerequisite_id"], "left").join(course.select(F.col("course_id").alias("prerequisite_id"), F.col("name").alias("needed")), "prerequisite_id")
    ok = F.coalesce("ok", F.lit(False))
    pair = F.struct("prerequisite_id", "needed")
    named = named.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(ok, pair))).alias("has"), F.array_sort(F.collect_list(F.when(~ok, pair))).alias("lacks"))
    rows = ranked.select(*key).join(course, "course_id").join(facts, key, "left").join(named, key, "left")
    names = lambda c: F.concat_ws("、", F.col(f"{c}.needed"))
    covers = F.when(F.size("gaps") > 0, F.concat(F.format_string("覆盖 %d 项能力缺口:", F.size("gaps")), F.concat_ws("、", F.col("gaps.text"))))
    off = rank_of(F.col("difficulty")) - F.when(F.col("average") <= 1, 0).when(F.col("average") <= 2, 1).otherwise(2)
    head = lambda text: F.format_string(f"课程难度 %s {text}当前基础%s(课程所授技能平均等级 %.1f)", "difficulty", F.lit("匹配" if text == "与" else ""), "average")
    fits = F.when(off == 0, head("与")).when(off > 0, F.concat(head("高于"), F.lit(",学习挑战较大"))).otherwise(F.concat(head("低于"), F.lit(",内容可能偏简单")))
    has, lacks = F.coalesce(F.size("has"), F.lit(0)), F.coalesce(F.size("lacks"), F.lit(0))
    before = (
        F.when(has + lacks <= 0, "无前置课程,可立即开始")
        .when(lacks == 0, F.concat(F.lit("前置课程已满足:"), names("has"), F.lit(",可直接学习")))
        .when(has == 0, F.concat(F.lit("前置课程未满足:"), names("lacks"), F.lit("(建议先补齐基础,或确认已具备对应技能)")))
        .otherwise(F.concat(F.lit("前置课程部分满足:"), names("has"), F.lit(" 已具备,"), names("lacks"), F.lit(" 未满足")))
    )
    time = F.concat(F.format_string("学习时长约 %d 分钟,时间成本", "duration_minutes"), time_cost(F.col("duration_minutes")))
    return rows.select(*key, F.filter(F.array(covers, fits, before, time), lambda x: x.isNotNull()).alias("reasons"))


def skill_list(teaches: DataFrame) -> Column:
    """The skills that courses teach, with the number of these, as a literal list of structs; an error beyond MOST_SKILLS."""
    counts = teaches.groupBy("skill_id").agg(F.count("*").alias("n")).orderBy("skill_id").limit(MOST_SKILLS + 1).collect()
    if len(counts) > MOST_SKILLS:
        raise ValueError(f"more than {MOST_SKILLS} skills")
    each = [F.struct(F.lit(r["skill_id"]).alias("skill_id"), F.lit(r["n"]).cast("long").alias("course_count")) for r in counts]
    return F.array(*each).cast("array<struct<skill_id: string, course_count: bigint>>")


def assessable(employee: DataFrame, teaches: DataFrame, has_skill: DataFrame, last: DataFrame) -> DataFrame:
    """Skills that some course teaches, for every employee: level, number of courses, last score and verdict.

    place: skills with a level first, then the one that more courses teach.
    """
    rows = employee.select("employee_id", F.inline(skill_list(teaches))).join(has_skill, ["employee_id", "skill_id"], "left").join(last, ["employee_id", "skill_id"], "left")
    rows = rows.withColumn("current_level", F.coalesce("level", F.lit(0)))
    order = Window.partitionBy("employee_id").orderBy(F.col("current_level") == 0, F.desc("course_count"), "skill_id")
    return rows.select("employee_id", "skill_id", "current_level", "course_count", F.col("score").alias("last_score"), F.col("verdict").alias("last_verdict"), F.row_number().over(order).alias("place"))


def shuffled(options: Column, seed: Column) -> Column:
    """Distinct options in the order of their digests with a seed."""
    return F.transform(F.array_sort(F.transform(F.array_distinct(options), lambda x: F.struct(F.md5(F.concat_ws("|", seed, x)).alias("d"), x.alias("x")))), lambda s: s.x)


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """The rows with their `place` in order of `key`, from 0: ranges of keys are numbered by themselves, after the rows of the ranges before."""
    ranged = materialise(rows.repartitionByRange(F.col(key)).withColumn("gw_range", F.spark_partition_id()), "ranges")
    # One row for each range.
    before = ranged.groupBy("gw_range").count().select("gw_range", (F.sum("count").over(Window.orderBy("gw_range")) - F.col("count")).alias("gw_before"))
    own = F.row_number().over(Window.partitionBy("gw_range").orderBy(key)) - 1
    return ranged.withColumn("place", own).join(before, "gw_range").withColumn("place", F.col("place") + F.col("gw_before")).drop("gw_range", "gw_before")


def quiz(courses: DataFrame) -> DataFrame:
    """course_id, question (from 1), options and answer (place of the right one, from 0) for the first objectives of courses.

    `courses` has course_id and objectives (a list, not empty). Wrong options are objectives of the courses that follow in
    order of course_id, round the catalogue.
    """
    n = numbered(courses.select("course_id", "objectives"), "course_id").withColumn("n", F.lit(courses.count()))
    asked = n.select("course_id", "place", "n", F.posexplode(F.slice("objectives", 1, QUESTIONS)).alias("k", "right"))
    wanted = asked.select("course_id", "k", "right", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(WRONG)), lambda j: (F.col("place") + 1 + (F.col("k") * WRONG + j - 1) % F.greatest(F.col("n") - 1, F.lit(1))) % F.col("n"))).alias("j", "place"))
    others = n.select("place", F.col("course_id").alias("other"), F.col("objectives").alias("pool"))
    wrong = wanted.join(others, "place").where("other <> course_id").withColumn("wrong", F.get("pool", (F.col("k") + F.col("j")) % F.size("pool"))).where("wrong <> right")
    rows = asked.join(wrong.groupBy("course_id", "k").agg(F.collect_set("wrong").alias("wrong")), ["course_id", "k"], "left")
    options = shuffled(F.array_append(F.coalesce("wrong", F.array().cast("array<string>")), F.col("right")), F.concat_ws(":", "course_id", "k"))
    return rows.select("course_id", (F.col("k") + 1).alias("question"), options.alias("options"), (F.array_position(options, F.col("right")) - 1).cast("int").alias("answer"))


def smallest_others(courses: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """Of the courses that don't teach a skill the first `most` in the order of digests, with skill_id and place n.

    Digests are random, so a bound holds enough of them for most skills without sorting all; skills for which it does not are
    worked out with all courses.
    """
    skills, total = skill_list(pairs).skill_id, courses.count()
    spread = courses.repartition(total // COURSES_OF_TASK) if total > COURSES_OF_TASK else courses
    digest = F.md5(F.concat_ws("|", "skill_id", F.col("course_id").cast("string")))

    def found(of: Column, below: str | None) -> DataFrame:
        rows = spread.select("*", F.explode(of).alias("skill_id")).withColumn("digest", digest)
        rows = rows if below is None else rows.where(F.substring("digest", 1, 8) < below)
        rows = rows.join(pairs, ["skill_id", "course_id"], "left_anti")
        place = F.row_number().over(Window.partitionBy("skill_id").orderBy("digest", "course_id"))
        return rows.withColumn("n", place).where(F.col("n") <= most).drop("digest")

    if total <= most * SPARE:
        return found(skills, None)
    near = materialise(found(skills, f"{int(most * SPARE / total * 16**8):08x}"), "near-others")
    full = [r["skill_id"] for r in near.groupBy("skill_id").count().where(F.col("count") >= most).collect()]
    # Null skills are joined by nothing.
    short = F.filter(skills, lambda s: ~s.isin(full)) if full else skills
    if courses.sparkSession.range(1).select(F.size(short).alias("n")).first()["n"] == 0:
        return near
    return near.where(F.col("skill_id").isin(full)).unionByName(found(short, None))


def skill_questions(courses: DataFrame, teaches: DataFrame) -> DataFrame:
    """skill_id, question, course_id, options and answer: one for each of the first courses that teach a skill.

    Wrong options are objectives of courses that don't teach it, in the order of digests.
    """
    pairs = teaches.select("skill_id", "course_id").distinct()
    in_order = Window.partitionBy("skill_id").orderBy("course_id")
    first = pairs.join(courses, "course_id").withColumn("n", F.row_number().over(in_order)).where(F.col("n") <= QUESTIONS).withColumn("k", F.col("n") - 1).drop("n")
    asked = first.withColumn("right", F.get("objectives", F.col("k") % F.size("objectives")))
    others = smallest_others(courses, pairs, QUESTIONS * WRONG)
    wrong = others.select("skill_id", F.floor((F.col("n") - 1) / WRONG).cast("int").alias("k"), F.get("objectives", F.lit(0)).alias("wrong")).groupBy("skill_id", "k").agg(F.collect_set("wrong").alias("wrong"))
    rows = asked.join(wrong, ["skill_id", "k"], "left")
    options = shuffled(F.array_append(F.array_except(F.coalesce("wrong", F.array().cast("array<string>")), F.array("right")), F.col("right")), F.concat_ws(":", "skill_id", "k"))
    return rows.select("skill_id", (F.col("k") + 1).alias("question"), "course_id", options.alias("options"), (F.array_position(options, F.col("right")) - 1).cast("int").alias("answer"))


def verdict(score: Column) -> Column:
    return F.when(score >= SOLID, "excellent").when(score >= PASS, "passed").otherwise("failed")


def graded(attempts: DataFrame, questions: DataFrame, key: str) -> DataFrame:
    """attempt_id, correct, total, score and verdict of attempts (attempt_id, the quiz's key, answers in order of questions).

    Answers beyond the options are wrong; attempts with another number of answers than questions have the error set.
    """
    rows = attempts.join(questions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("question", "answer", F.size("options").alias("n")))).alias("q")), key)
    right = F.size(F.filter(F.arrays_zip("q", "answers"), lambda z: (z.q.answer == z.answers) & z.answers.between(0, z.q.n - 1)))
    fits = F.size("q") == F.size("answers")
    score = F.when(fits, F.bround(100 * right / F.size("q")).cast("int"))
    return rows.select("attempt_id", F.when(fits, right).alias("correct"), F.size("q").alias("total"), score.alias("score"), F.when(fits, verdict(score)).alias("verdict"), F.when(~fits, "answers and questions differ in number").alias("error"))


def progress(units: DataFrame, done: DataFrame) -> DataFrame:
    """Finished units of every learner's course, all of them, and whether its quiz is open (all are done, and there is one).

    `units` has course_id and unit; `done` employee_id, course_id and unit, repeated or of no such unit at will.
    """
    totals = units.groupBy("course_id").agg(F.count_distinct("unit").alias("total"))
    rows = done.select("employee_id", "course_id", "unit").distinct()
    finished = rows.join(units.select("course_id", "unit", F.lit(1).alias("known")).distinct(), ["course_id", "unit"], "left").groupBy("employee_id", "course_id").agg(F.count("known").alias("completed"))
    out = finished.join(totals, "course_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    return out.select("employee_id", "course_id", "completed", "total", ((F.col("completed") == F.col("total")) & (F.col("total") > 0)).alias("quiz_unlocked"))


def histogram(readiness: DataFrame) -> DataFrame:
    """All three buckets with label, number of employees and the whole team's mean readiness in percent."""
    rows = readiness.withColumn("bucket", bucket(F.col("readiness")))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    all_ = readiness.sparkSession.createDataFrame([(b,) for b in BUCKET_LABELS], "bucket string")
    mean = readiness.agg(percent(F.coalesce(F.avg("readiness"), F.lit(0.0))).alias("average"))
    return all_.join(counts, "bucket", "left").join(F.broadcast(mean)).select("bucket", labelled(F.col("bucket"), BUCKET_LABELS).alias("label"), F.coalesce("n", F.lit(0)).alias("n"), "average")


def training_totals(records: DataFrame) -> DataFrame:
    """completions (passed records), pass_rate (of all records) and the mean score of the passed ones to one place."""
    ok = F.col("exam_score") >= PASS
    return records.agg(F.count_if(ok).alias("completions"), percent(F.avg(ok.cast("int"))).alias("pass_rate"), F.bround(F.avg(F.when(ok, F.col("exam_score"))), 1).alias("average_score"))


def assessment_report(scores: DataFrame) -> DataFrame:
    """skill_id, attempts, average and pass_rate of the skills with the most attempts, and of all together (skill_id null)."""
    stats = [F.count("*").alias("attempts"), F.bround(F.avg("score")).cast("long").alias("average"), percent(F.avg((F.col("score") >= PASS).cast("int"))).alias("pass_rate")]
    top = scores.groupBy("skill_id").agg(*stats).orderBy(F.desc("attempts"), "skill_id").limit(TOP)
    return top.unionAll(scores.agg(*stats).select(F.lit(None).cast("string").alias("skill_id"), "attempts", "average", "pass_rate"))


def newest(recent: DataFrame, n: int = 6) -> DataFrame:
    """The newest of each employee's last records: the limit is the feature."""
    return recent.orderBy(F.desc("completed_at"), F.desc("record_id")).limit(n)


def matched_resources(gaps: DataFrame, resources: DataFrame, most: int = 12) -> DataFrame:
    """employee_id, resource_id and place of the first `most` resources that teach a skill the employee lacks.

    Of each skill only its first resources can be among an employee's first, so only they are joined.
    """
    each = resources.select("resource_id", F.explode("skills").alias("skill_id")).distinct()
    first = each.withColumn("n", F.row_number().over(Window.partitionBy("skill_id").orderBy("resource_id"))).where(F.col("n") <= most)
    lists = first.groupBy("skill_id").agg(F.collect_list(F.struct("resource_id")).alias("own"))
    rows = gaps.select("employee_id", "skill_id").join(F.broadcast(lists), "skill_id").groupBy("employee_id").agg(F.flatten(F.collect_set("own")).alias("all"))
    best = rows.select("employee_id", F.posexplode(F.slice(F.sort_array(F.array_distinct("all")), 1, most)).alias("k", "r"))
    return best.select("employee_id", "r.resource_id", (F.col("k") + 1).alias("place"))


def capped(resources: DataFrame, most: int = 30) -> DataFrame:
    """type, n (resources of it) and the ids of the first `most`."""
    first = resources.withColumn("k", F.row_number().over(Window.partitionBy("type").orderBy("resource_id"))).where(F.col("k") <= most)
    ids = first.groupBy("type").agg(F.array_sort(F.collect_list("resource_id")).alias("first"))
    return resources.groupBy("type").agg(F.count("*").alias("n")).join(ids, "type")


def evidence(req: DataFrame, has_skill: DataFrame) -> DataFrame:
    """A sentence on every required skill's level: what it rests on, or that nothing is on record."""
    rows = req.join(has_skill.select("employee_id", "skill_id", "level"), ["employee_id", "skill_id"], "left")
    known = F.format_string("%s: level %d of %d", "skill_id", "level", "required_level")
    return rows.select("employee_id", "skill_id", F.when(F.col("level").isNull(), F.format_string("%s: not on record, counts as level 0 of %d", "skill_id", "required_level")).otherwise(known).alias("text"))


def points(before: Column, after: Column) -> Column:
    """A difference of shares in percentage points, with its sign."""
    return F.format_string("%+.1f pp", (after - before) * 100)


def or_error(keys: DataFrame, known: DataFrame, key: str, kind: str) -> DataFrame:
    """The keys with the columns of `known`; error names the kind for those that aren't there."""
    name = known.select(F.col(key), F.lit(True).alias("is_known"))
    rows = keys.select(key).distinct().join(name.distinct(), key, "left")
    return rows.select(key, F.when(F.col("is_known").isNull(), F.concat(F.lit(f"unknown {kind} "), F.col(key).cast("string"))).alias("error"))


def records_of(records: DataFrame, employees: DataFrame) -> DataFrame:
    """The records of some employees, oldest first within each: place counts from 1."""
    mine = records.join(employees.select("employee_id").distinct(), "employee_id", "left_semi")
    return mine.withColumn("place", F.row_number().over(Window.partitionBy("employee_id").orderBy("record_id")))
