"""Validation of documents against their schemas: documents with faults of every kind, built from the domain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.operators import schemas
from gapweave.plans.skills import query
from gapweave.sources.views import Domain


def thing(**fields: str) -> str:
    """SQL of a JSON object; a field whose SQL is null is left out."""
    return "concat('{', concat_ws(',', " + ", ".join(f"""'"{k}":' || {v}""" for k, v in fields.items()) + "), '}')"


def text(sql: str) -> str:
    return f"""'"' || {sql} || '"'"""


def number(prefix: str, sql: str) -> str:
    return text(f"'{prefix}_' || CASE WHEN {sql} < 10 THEN '00' WHEN {sql} < 100 THEN '0' ELSE '' END || CAST({sql} AS VARCHAR(20))")


SOURCE = """CASE {0} % 3 WHEN 0 THEN '["esco","esco"]' WHEN 1 THEN '[]' ELSE '["onet","curated"]' END"""
SKILL = number("SKILL", "skill_no")

#: Documents of each kind as SQL of both engines; LISTED is replaced by the engine's sorted list.
DOCS = {
    "skills": "SELECT CAST(skill_no AS BIGINT) AS id, "
    + thing(skill_id=SKILL, name=text("skill_id"), category="CASE skill_no % 4 WHEN 0 THEN '\"database\"' WHEN 1 THEN '\"ai-ml\"' WHEN 2 THEN '\"cooking\"' ELSE '7' END", description="CASE WHEN skill_no % 5 > 0 THEN '\"d\"' WHEN skill_no % 2 = 0 THEN '\"\"' END", aliases="""CASE WHEN skill_no % 6 = 0 THEN '["a",""]' ELSE '["a"]' END""", sources=SOURCE.format("skill_no"), extra="CASE WHEN skill_no % 8 = 0 THEN 'true' END")
    + " AS doc FROM skill",
    "positions": "SELECT CAST(p.position_id AS BIGINT) AS id, "
    + thing(
        position_id=number("POS", "p.position_id"), name=text("name"), description="'\"d\"'", responsibilities="CASE WHEN p.position_id = 1 THEN '[]' ELSE '[\"r\"]' END", sources=SOURCE.format("p.position_id"),
        external_ids=thing(esco_uri="CASE WHEN p.position_id = 2 THEN '5' END", onet_code="CASE p.position_id WHEN 3 THEN '\"15-12\"' ELSE '\"15-1252.00\"' END", more="CASE WHEN p.position_id = 4 THEN 'null' END"), skills="'[' || coalesce(l.l, '') || ']'",
    )
    + " AS doc FROM job AS p LEFT JOIN (SELECT position_id, LISTED(" + thing(skill_id=SKILL, importance="CASE WHEN skill_no % 9 = 0 THEN '9.5' WHEN skill_no % 10 = 0 THEN '0.5' ELSE CAST(importance AS VARCHAR(20)) || '.0' END", required_level="CASE WHEN skill_no % 7 = 0 THEN '2.5' ELSE CAST(required_level AS VARCHAR(20)) || '.0' END", sources="'[\"onet\"]'") + ") AS l FROM requires JOIN skill USING (skill_id) GROUP BY position_id) AS l ON l.position_id = p.position_id",
    "courses": "SELECT c.course_id AS id, "
    + thing(
        course_id=number("CRS", "c.course_id"), uid="CASE WHEN c.course_id % 19 > 0 THEN '\"u\"' ELSE '\"\"' END", name=text("name"), description="'\"\"'", difficulty="CASE WHEN c.course_id % 13 = 0 THEN '\"hard\"' ELSE " + text("difficulty") + " END",
        duration_minutes="CASE WHEN c.course_id % 11 = 0 THEN '\"long\"' WHEN c.course_id % 23 = 0 THEN '2001' ELSE CAST(duration_minutes AS VARCHAR(20)) END", learning_objectives="CASE WHEN c.course_id % 29 = 0 THEN '[]' ELSE '[\"o\"]' END",
        skills="'[' || coalesce(t.l, '') || CASE WHEN c.course_id % 31 = 0 THEN ',' || t.l ELSE '' END || ']'", prerequisites="'[' || coalesce(p.l, '') || ']'", url="CASE WHEN c.course_id % 17 = 0 THEN '\"ftp://x\"' WHEN c.course_id % 37 = 0 THEN '\"http://a b\"' ELSE '\"https://x/y\"' END", source="CASE WHEN c.course_id % 41 = 0 THEN '\"other\"' ELSE '\"microsoft_learn\"' END",
    )
    + " AS doc FROM course AS c LEFT JOIN (SELECT course_id, LISTED(" + SKILL + ") AS l FROM teaches JOIN skill USING (skill_id) GROUP BY course_id) AS t ON t.course_id = c.course_id LEFT JOIN (SELECT course_id, LISTED(" + number("CRS", "prerequisite_id") + ") AS l FROM prerequisite GROUP BY course_id) AS p ON p.course_id = c.course_id",
    "employees": "SELECT e.employee_id AS id, CASE WHEN e.employee_id % 97 = 5 THEN '{\"employee_id\":' WHEN e.employee_id % 97 = 6 THEN '[1]' ELSE "
    + thing(
        employee_id=number("EMP", "e.employee_id"), name=text("e.name"), department="CASE WHEN e.employee_id % 17 > 0 THEN " + text("department") + " END", current_position_id=number("POS", "target_position_id"), target_position_id=number("POS", "target_position_id"), years_of_experience="CASE WHEN e.employee_id % 10 = 0 THEN '46' WHEN e.employee_id % 10 = 1 THEN '-1' WHEN e.employee_id % 10 = 2 THEN '1.5' ELSE '7' END", skills="'[' || coalesce(l.l, '') || ']'",
    )
    + " END AS doc FROM employee AS e LEFT JOIN (SELECT employee_id, LISTED("
    + thing(skill_id=SKILL, level="CASE WHEN skill_no % 13 = 0 THEN '\"3\"' WHEN skill_no % 12 = 0 THEN '5' ELSE CAST(level AS VARCHAR(20)) END", evidence=thing(assessment_score="CASE WHEN level > 1 THEN CAST(level * 30 AS VARCHAR(20)) END", project_experience="'\"\"'", self_assessment="CAST(level AS VARCHAR(20))", training_records="CASE WHEN skill_no % 14 = 0 THEN '[1,\"t\"]' ELSE '[]' END"))
    + ") AS l FROM has_skill JOIN skill USING (skill_id) GROUP BY employee_id) AS l ON l.employee_id = e.employee_id",
}


def faults_sql(kind: str) -> str:
    """DuckDB SQL over {kind}_docs that gives the faults by the rules of the kind's schema, rule by rule."""
    parts = [f"SELECT id, '<root>' AS path, 'json' AS rule, NULL AS detail FROM {kind}_docs WHERE NOT json_valid(doc)"]

    def walk(schema: dict, rows: str) -> None:
        """`rows` is SQL with id, path and v (json)."""
        kinds = {"object": "json_type(v) = 'OBJECT'", "array": "json_type(v) = 'ARRAY'", "string": "json_type(v) = 'VARCHAR'", "number": "json_type(v) IN ('BIGINT', 'UBIGINT', 'DOUBLE')"}
        kinds["integer"] = f"({kinds['number']} AND TRY_CAST(v AS DOUBLE) = floor(TRY_CAST(v AS DOUBLE)))"
        rules = {
            "type": lambda x: f"NOT coalesce({kinds[x]}, false)",
            "enum": lambda x: f"v::VARCHAR NOT IN ({', '.join(repr(schemas.text_of(y)) for y in x)})",
            "const": lambda x: f"v::VARCHAR <> {schemas.text_of(x)!r}",
            "minimum": lambda x: f"{kinds['number']} AND TRY_CAST(v AS DOUBLE) < {x}",
            "maximum": lambda x: f"{kinds['number']} AND TRY_CAST(v AS DOUBLE) > {x}",
            "minLength": lambda x: f"{kinds['string']} AND length(v->>'$') < {x}",
            "pattern": lambda x: f"{kinds['string']} AND NOT regexp_matches(v->>'$', '{x}')",
            "minItems": lambda x: f"{kinds['array']} AND json_array_length(v) < {x}",
            "uniqueItems": lambda x: f"{kinds['array']} AND len(list_distinct(json_extract(v, '$[*]')::VARCHAR[])) < json_array_length(v)",
        }
        at = "CASE path WHEN '' THEN '<root>' ELSE path END AS path"
        for rule, condition in rules.items():
            if rule in schema:
                parts.append(f"SELECT id, {at}, '{rule}', NULL FROM ({rows}) WHERE {condition(schema[rule])}")
        if schema.get("required"):
            parts.append(f"SELECT id, {at}, 'required', n FROM ({rows}), (SELECT unnest({schema['required']!r}) AS n) WHERE {kinds['object']} AND NOT list_contains(json_keys(v), n)")
        if "additionalProperties" in schema:
            parts.append(f"SELECT id, {at}, 'additionalProperties', n FROM (SELECT id, path, unnest(json_keys(v)) AS n FROM ({rows}) WHERE {kinds['object']}) WHERE n NOT IN ({', '.join(map(repr, schema['properties']))})")
        below = "CASE path WHEN '' THEN '' ELSE path || '/' END || "
        for name, inner in schema.get("properties", {}).items():
            walk(inner, f"SELECT id, {below}'{name}' AS path, json_extract(v, '$.{name}') AS v FROM ({rows}) WHERE {kinds['object']} AND list_contains(json_keys(v), '{name}')")
        if "items" in schema:
            walk(schema["items"], f"SELECT id, {below}i AS path, json_extract(v, '$[' || i || ']') AS v FROM (SELECT *, unnest(range(json_array_length(v)::BIGINT)) AS i FROM ({rows}) WHERE {kinds['array']})")

    walk(schemas.SCHEMAS[kind], f"SELECT id, '' AS path, TRY_CAST(doc AS JSON) AS v FROM {kind}_docs WHERE json_valid(doc)")
    return " UNION ALL ".join(parts)


def engine(sql: str, listed: str) -> str:
    """`sql` with LISTED(x) as the engine's comma-joined sorted list of x."""
    while (a := sql.find("LISTED(")) >= 0:
        depth, b = 1, a + 7
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[b], 0)
            b += 1
        sql = sql[:a] + listed.format(sql[a + 7 : b - 1]) + sql[b:]
    return sql


DUCKDB_DOCS = ", " + ", ".join(f"{k}_docs AS (SELECT id, doc FROM ({engine(v, 'array_to_string(list_sort(list({})), chr(44))')}))" for k, v in DOCS.items())


@query(DUCKDB_DOCS + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, * FROM ({faults_sql(k)}) AS f(id, path, rule, detail)" for k in DOCS) + ")")
def schema_faults(d: Domain) -> DataFrame:
    """kind, id, path, rule and detail of every fault of the skill, position, course and employee documents."""
    d.written("has_skill")
    spark_sql = {f"{k}_docs": engine(v, "array_join(sort_array(collect_list({})), ',')") for k, v in DOCS.items()}
    d.views = d.views | {k: v.replace("{", "{{").replace("}", "}}") for k, v in spark_sql.items()}
    found = [schemas.faults(d[f"{k}_docs"], "doc", schemas.SCHEMAS[k]).select(F.lit(k).alias("kind"), "id", "path", "rule", "detail") for k in DOCS]
    return reduce(DataFrame.unionAll, found)
