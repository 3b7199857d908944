"""Team reports: common gaps, readiness buckets, members' training, recent records, assessments.

Null departments are a department of their own where rows are grouped, and match nothing where they are joined. Null
scores count as records but neither as passed nor in means. Of records at one time the larger record_id is newer; equal
counts are ordered by skill_id. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapweave.operators.gap import bucket
from gapweave.operators.replay import PASS, outcome


def team_gaps(gaps: DataFrame, employees: DataFrame, limit: int | None = None) -> DataFrame:
    """Employees who lack each skill, whether it is core to any, and their share of the department."""
    sizes = employees.groupBy("department").agg(F.count("*").alias("members"))
    rows = gaps.join(employees.select("employee_id", "department"), "employee_id").groupBy("department", "skill_id").agg(F.count("*").alias("lacking"), F.max(F.col("importance") >= 5).alias("is_core"))
    rows = rows.join(sizes, "department").withColumn("share", F.round(F.col("lacking") / F.col("members"), 6)).drop("members")
    if limit is None:
        return rows
    place = Window.partitionBy("department").orderBy(F.desc("lacking"), "skill_id")
    return rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= limit)


def buckets(readiness: DataFrame, employees: DataFrame) -> DataFrame:
    rows = readiness.join(employees.select("employee_id", "department"), "employee_id").withColumn("bucket", bucket(F.col("readiness")))
    return rows.groupBy("department", "bucket").agg(F.count("*").alias("n"), F.round(F.avg("readiness"), 6).alias("avg_readiness"))


def member_stats(employees: DataFrame, records: DataFrame) -> DataFrame:
    """Passed records, distinct passed courses, rate and mean of every member; null without records."""
    ok = F.col("exam_score") >= PASS
    stats = records.groupBy("employee_id").agg(F.count_if(ok).alias("completions"), F.count_distinct(F.when(ok, F.col("course_id"))).alias("courses"), F.round(F.avg(ok.cast("int")), 6).alias("pass_rate"), F.bround(F.avg("exam_score"), 1).alias("mean_score"))
    return employees.select("employee_id").join(stats, "employee_id", "left").select("employee_id", F.coalesce("completions", F.lit(0)).alias("completions"), F.coalesce("courses", F.lit(0)).alias("courses"), "pass_rate", "mean_score")


def recent(records: DataFrame, each: int) -> DataFrame:
    """The last records of every employee."""
    newest = Window.partitionBy("employee_id").orderBy(F.desc("completed_at"), F.desc("record_id"))
    return records.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= each).select("employee_id", "place", "record_id", "course_id", "exam_score")


def latest_assessment(records: DataFrame, teaches: DataFrame) -> DataFrame:
    """The newest score of every (employee, skill) and its verdict."""
    rows = records.join(teaches, "course_id").groupBy("employee_id", "skill_id").agg(F.max_by("exam_score", F.struct("completed_at", "record_id")).alias("score"))
    return rows.withColumn("verdict", outcome(F.col("score")))


def assessment_stats(records: DataFrame, teaches: DataFrame) -> DataFrame:
    """Attempts, mean and pass rate by skill."""
    return records.join(teaches, "course_id").groupBy("skill_id").agg(F.count("*").alias("attempts"), F.round(F.avg("exam_score"), 6).alias("mean_score"), F.round(F.avg((F.col("exam_score") >= PASS).cast("int")), 6).alias("pass_rate"))
