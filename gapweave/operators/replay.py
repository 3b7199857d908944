"""Replay of training records into levels, flags and changes, as windows over each (employee, skill).

Records apply in the order of record_id. A pass (score of 70 or more) raises a skill by one level, to 4 at most, once for
each difficulty; below 85 it also flags the skill for consolidation, and a later pass of 85 or more at a difficulty that
is used up clears the flag. A fail leaves a note unless the course has been passed before. Skills of records exist from
level 0 on. Records of unknown courses are left out and listed by unknown_courses().

Records without score, employee or course pass nothing and raise nothing. record_id orders records and must be unique;
repeated edges of teaches would count twice. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SOLID, PASS, TOP_LEVEL = 85, 70, 4


def outcome(score: Column) -> Column:
    return F.when(score >= SOLID, "solid").when(score >= PASS, "consolidate").otherwise("fail")


def steps(records: DataFrame, course: DataFrame, teaches: DataFrame, has_skill: DataFrame) -> DataFrame:
    """One row for each record and skill that its course teaches, with the level before and after and the flag's event."""
    own = Window.partitionBy("employee_id", "course_id").orderBy("record_id").rowsBetween(Window.unboundedPreceding, -1)
    passed = (F.col("exam_score") >= PASS).cast("int")
    marked = records.withColumn("passed_before", F.coalesce(F.max(passed).over(own), F.lit(0)) == 1)
    rows = marked.join(course.select("course_id", "difficulty"), "course_id").join(teaches, "course_id")
    tier = Window.partitionBy("employee_id", "skill_id", "difficulty", (F.col("exam_score") >= PASS)).orderBy("record_id")
    rows = rows.withColumn("raises", (F.col("exam_score") >= PASS) & (F.row_number().over(tier) == 1))
    event = F.when(F.col("raises") & (F.col("exam_score") < SOLID), 1).when(~F.col("raises") & (F.col("exam_score") >= SOLID), 0)
    rows = rows.withColumn("flag_event", event).join(has_skill.select("employee_id", "skill_id", F.col("level").alias("base")), ["employee_id", "skill_id"], "left")
    skill = Window.partitionBy("employee_id", "skill_id").orderBy("record_id")
    until, before = skill.rowsBetween(Window.unboundedPreceding, 0), skill.rowsBetween(Window.unboundedPreceding, -1)
    raised = F.col("raises").cast("int")
    base = F.coalesce("base", F.lit(0))
    return rows.select(
        "employee_id",
        "record_id",
        "course_id",
        "skill_id",
        "exam_score",
        "passed_before",
        "raises",
        F.least(F.lit(TOP_LEVEL), base + F.coalesce(F.sum(raised).over(before), F.lit(0))).cast("int").alias("from_level"),
        F.least(F.lit(TOP_LEVEL), base + F.sum(raised).over(until)).cast("int").alias("to_level"),
        (F.coalesce(F.last("flag_event", ignorenulls=True).over(before), F.lit(0)) == 1).alias("flagged_before"),
        (F.coalesce(F.last("flag_event", ignorenulls=True).over(until), F.lit(0)) == 1).alias("flagged"),
    )


def changes(steps_: DataFrame) -> DataFrame:
    """The steps that leave a trace: notes of fails, raised levels, cleared flags."""
    fail = (F.col("exam_score") < PASS) & ~F.col("passed_before")
    cleared = ~F.col("raises") & (F.col("exam_score") >= SOLID) & F.col("flagged_before")
    kind = F.when(fail, "failed").when(F.col("raises"), "raised").when(cleared, "cleared")
    return steps_.withColumn("kind", kind).where(F.col("kind").isNotNull()).select("employee_id", "record_id", "course_id", "skill_id", "from_level", "to_level", "kind")


def profile(steps_: DataFrame, has_skill: DataFrame) -> DataFrame:
    """Every skill's level and flag after all records, with skills that no record touched."""
    last = steps_.groupBy("employee_id", "skill_id").agg(F.max_by(F.struct("to_level", "flagged"), "record_id").alias("s"))
    both = has_skill.join(last, ["employee_id", "skill_id"], "full")
    return both.select("employee_id", "skill_id", F.coalesce("s.to_level", "level").alias("level"), F.coalesce("s.flagged", F.lit(False)).alias("flagged"))


def passed_courses(records: DataFrame) -> DataFrame:
    return records.where(F.col("exam_score") >= PASS).select("employee_id", "course_id").distinct()


def remediation(records: DataFrame, prerequisite: DataFrame) -> DataFrame:
    """For each failed record the direct prerequisites never passed, or else the course itself."""
    failed = records.where(F.col("exam_score") < PASS).select("record_id", "employee_id", "course_id")
    passed = passed_courses(records).withColumnRenamed("course_id", "prerequisite_id")
    todo = failed.join(prerequisite, "course_id").join(passed, ["employee_id", "prerequisite_id"], "left_anti").select("record_id", "prerequisite_id")
    return failed.join(todo, "record_id", "left").select("record_id", "employee_id", "course_id", F.coalesce("prerequisite_id", "course_id").alias("suggested_id"), F.col("prerequisite_id").isNull().alias("is_retake"))


def unknown_courses(records: DataFrame, course: DataFrame) -> DataFrame:
    return records.join(course, "course_id", "left_anti").select("record_id", "employee_id", "course_id")
