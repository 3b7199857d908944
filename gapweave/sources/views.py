"""Domain tables as views of the star-schema tables, for Spark and (with other JSON access) for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from gapweave.sources.scratch import materialise, spread

#: Each view's SQL; later views use earlier ones. Every row of `part` is a course; records name two courses more than there are.
VIEWS = {
    "skill": "SELECT DISTINCT p_brand AS skill_id, CAST(substr(p_brand, 7) AS INT) AS skill_no FROM part",
    "job": "SELECT r_regionkey AS position_id, r_name AS name FROM region",
    "requires": "SELECT p.position_id, s.skill_id, CAST(1 + (s.skill_no * 5 + p.position_id) % 5 AS INT) AS importance, CAST((s.skill_no + p.position_id) % 5 AS INT) AS required_level FROM job p CROSS JOIN skill s WHERE (s.skill_no * 7 + p.position_id * 3) % 3 <> 0",
    "employee": "SELECT c_custkey AS employee_id, c_name AS name, c_mktsegment AS department, CAST(c_nationkey % 5 AS INT) AS target_position_id FROM customer",
    "has_skill": "SELECT o.o_custkey AS employee_id, p.p_brand AS skill_id, CAST(least(4, count(*)) AS INT) AS level FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey GROUP BY o.o_custkey, p.p_brand",
    "course": "SELECT p_partkey AS course_id, p_name AS name, CASE p_size % 3 WHEN 0 THEN 'beginner' WHEN 1 THEN 'intermediate' ELSE 'advanced' END AS difficulty, CAST(p_size * 7 AS INT) AS duration_minutes FROM part",
    "teaches": "SELECT p_partkey AS course_id, p_brand AS skill_id FROM part UNION SELECT p_partkey, concat('Brand#', CAST((CAST(substr(p_brand, 7) AS INT) * 3 + p_partkey) % 25 + 1 AS VARCHAR(10))) FROM part WHERE p_partkey % 2 = 0",
    "prerequisite": "SELECT course_id, CAST(floor(course_id / 2) AS BIGINT) AS prerequisite_id FROM course WHERE course_id >= 2 AND course_id % 3 <> 0 UNION SELECT course_id, CAST(floor(course_id / 3) AS BIGINT) FROM course WHERE course_id >= 6 AND course_id % 5 = 0",
    "draft_prerequisite": "SELECT course_id, prerequisite_id FROM prerequisite UNION SELECT CAST(floor(course_id / 2) AS BIGINT), course_id FROM course WHERE course_id % 12 = 4 UNION SELECT CAST(floor(course_id / 4) AS BIGINT), course_id FROM course WHERE course_id % 24 = 8 UNION SELECT course_id, course_id FROM course WHERE course_id % 31 = 7",
    "training_record": "SELECT event_id AS record_id, user_id AS employee_id, CAST((CAST(get_json_object(props, '$.k') AS INT) + user_id * 100) % (n + 2) AS BIGINT) AS course_id, CAST(floor(value) AS INT) % 101 AS exam_score, ts AS completed_at FROM events CROSS JOIN (SELECT count(*) AS n FROM part)",
}


class Domain:
    """The domain tables of one folder as DataFrames: `domain["employee"]`."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.views = spark, sf_dir, VIEWS
        self.frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.frames:
            if name in self.views:
                used = set(re.findall(r"(?:FROM|JOIN) (\w+)", self.views[name]))
                self.frames[name] = self.spark.sql(re.sub(r"(FROM|JOIN) (\w+)", r"\1 {\2}", self.views[name]), **{x: self[x] for x in used})
            else:
                self.frames[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.frames[name]

    def written(self, name: str) -> DataFrame:
        """The table, written to the shared folder first: for views that cost a join and are used several times."""
        read = [x for x in re.findall(r"(?:FROM|JOIN) (\w+)", self.views.get(name, "")) if x not in self.views]
        with spread(self.spark, max((self[x].count() for x in read), default=0)):
            self.frames[name] = materialise(self[name], name)
        return self.frames[name]


def duckdb_views() -> str:
    """The views as common table expressions of a recursive WITH clause, without the word WITH."""
    json = "CAST(json_extract_string(props, '$.k') AS INT)"
    return ",\n".join(f"{k} AS ({v.replace("CAST(get_json_object(props, '$.k') AS INT)", json)})" for k, v in VIEWS.items())
