"""Skill gaps of employees against the skills that their target position requires.

Missing skills count as level 0. Requirements of level 0 or null ask for nothing. Employees without a target, or with a
target that requires nothing, have no gaps and a readiness of 1. Keys that are null match nothing. Repeated rows of an
input repeat in the result, so tables must be unique by their keys (plans/checks reports rows that are not). Empty
tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def requirements(employee: DataFrame, requires: DataFrame, has_skill: DataFrame) -> DataFrame:
    """Every positive requirement of every employee's target with the current level (0 if the skill is absent)."""
    wanted = employee.select("employee_id", F.col("target_position_id").alias("position_id")).join(requires.where("required_level > 0"), "position_id")
    return wanted.join(has_skill, ["employee_id", "skill_id"], "left").select("employee_id", "skill_id", F.coalesce("level", F.lit(0)).alias("current_level"), "required_level", "importance")


def gaps(req: DataFrame) -> DataFrame:
    """Requirements above the current level, with gap, gap_ratio and weighted_gap."""
    gap = F.col("required_level") - F.col("current_level")
    return req.where(gap > 0).withColumn("gap", gap).withColumn("gap_ratio", F.col("gap") / F.col("required_level")).withColumn("weighted_gap", F.col("gap") * F.col("importance"))


def met(req: DataFrame) -> DataFrame:
    return req.where("current_level >= required_level")


def extra(employee: DataFrame, requires: DataFrame, has_skill: DataFrame) -> DataFrame:
    """Skills of employees that their target does not list, at whatever level."""
    listed = requires.select(F.col("position_id").alias("target_position_id"), "skill_id")
    return has_skill.join(employee.select("employee_id", "target_position_id"), "employee_id").join(listed, ["target_position_id", "skill_id"], "left_anti").select("employee_id", "skill_id", "level")


def readiness(employee: DataFrame, req: DataFrame) -> DataFrame:
    """Covered share of weighted requirements (1 without weight), number and sum of gaps, for every employee."""
    gap = F.greatest(F.lit(0), F.col("required_level") - F.col("current_level"))
    sums = req.groupBy("employee_id").agg(
        F.count_if(gap > 0).alias("missing_count"),
        F.sum(gap).alias("total_gap"),
        F.sum(gap * F.col("importance")).alias("weighted_total_gap"),
        F.sum(F.col("required_level") * F.col("importance")).alias("weight"),
        F.sum(F.least("current_level", "required_level") * F.col("importance")).alias("covered"),
    )
    none = F.lit(0)
    return employee.select("employee_id").join(sums, "employee_id", "left").select(
        "employee_id",
        *[F.coalesce(c, none).alias(c) for c in ("missing_count", "total_gap", "weighted_total_gap")],
        F.round(F.when(F.col("weight") > 0, F.col("covered") / F.col("weight")).otherwise(1.0), 6).alias("readiness"),
    )


def status(level: Column, required: Column) -> Column:
    """extra, met, missing or learning."""
    return F.when(required.isNull() | (required == 0), "extra").when(level >= required, "met").when(level == 0, "missing").otherwise("learning")


def bucket(readiness_: Column) -> Column:
    return F.when(readiness_ >= 0.8, "ready").when(readiness_ >= 0.5, "close").otherwise("far")


def summary_label(importance: Column, required: Column, current: Column) -> Column:
    """core or side, deep or shallow."""
    return F.concat(F.when(importance >= 5, "core").otherwise("side"), F.lit("-"), F.when(required - current >= 3, "deep").otherwise("shallow"))
