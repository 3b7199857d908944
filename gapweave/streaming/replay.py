"""The replay of training records as a stream: levels and flags are kept as state for each employee."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gapweave.operators.replay import PASS, SOLID, TOP_LEVEL

OUT = "employee_id long, skill_id string, record_id long, level int, flagged boolean"


def levels(records: DataFrame, course: DataFrame, teaches: DataFrame, has_skill: DataFrame) -> DataFrame:
    """The new level and flag of every (record, skill), in update mode; the last record_id of a skill is its profile.

    Records must arrive in the order of record_id over micro-batches; within one they are ordered here. Records without
    score raise nothing, those of unknown courses are left out, those without employee are one employee's; repeated records
    count again. State is one small map of skills for each employee.
    """
    base = has_skill.select("employee_id", "skill_id", F.col("level").alias("base"))
    rows = records.join(course.select("course_id", "difficulty"), "course_id").join(teaches, "course_id").join(base, ["employee_id", "skill_id"], "left")

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = json.loads(state.get[0]) if state.exists else {}
        out = []
        for r in pd.concat(list(batches)).sort_values(["record_id", "skill_id"]).itertuples():
            s = known.setdefault(r.skill_id, {"level": 0 if pd.isna(r.base) else int(r.base), "used": [], "flag": False})
            if r.exam_score >= PASS:
                if r.difficulty not in s["used"]:
                    s["level"], s["flag"] = min(s["level"] + 1, TOP_LEVEL), s["flag"] or r.exam_score < SOLID
                    s["used"].append(r.difficulty)
                elif r.exam_score >= SOLID:
                    s["flag"] = False
            out.append((key[0], r.skill_id, r.record_id, s["level"], s["flag"]))
        state.update((json.dumps(known),))
        yield pd.DataFrame(out, columns=["employee_id", "skill_id", "record_id", "level", "flagged"])

    return rows.groupBy("employee_id").applyInPandasWithState(update, OUT, "known string", "update", GroupStateTimeout.NoTimeout)
