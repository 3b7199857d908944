"""JSON Schema as one Column: every fault of a document with its path and the rule that it breaks.

compiled() turns a schema into an expression over a VARIANT value, so a table of documents is checked in one pass in the JVM.
Known keywords: type, required, enum, const, minimum, maximum, minLength, pattern, minItems, maxItems, uniqueItems,
properties, additionalProperties (false) and items; others are an error, so that no rule is passed over. Keywords say
nothing of values of other types, as JSON Schema has it. A whole number is an integer however it is written, true and false
are no numbers. Values of enum, const and uniqueItems are compared by their JSON text.

A path has names and places joined by "/", and is <root> for the document itself. A missing property is a fault of its
object, one for each name (detail); so is a property too many. Text that is no JSON has the one fault "json"; null text has
none. Empty tables give no rows. Other columns come through faults() untouched.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAULT = "array<struct<path: string, rule: string, detail: string>>"
KNOWN = {"type", "required", "enum", "const", "minimum", "maximum", "minLength", "pattern", "minItems", "maxItems", "uniqueItems", "properties", "additionalProperties", "items"}
NOTES = {"$schema", "$id", "title", "description"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def below(path: Column, name: Column) -> Column:
    return F.when(path == "", name).otherwise(F.concat(path, F.lit("/"), name))


def compiled(schema: dict, value: Column, path: Column | None = None) -> Column:
    """The faults of a VARIANT value as an array of (path, rule, detail); none for a null value."""
    if unknown := set(schema) - KNOWN - NOTES:
        raise ValueError(f"unknown keywords: {sorted(unknown)}")
    if schema.get("additionalProperties", False) is not False:
        raise ValueError("additionalProperties can only be false")
    path = F.lit("") if path is None else path
    return F.coalesce(let(value, lambda v: let(F.schema_of_variant(v), lambda kind: _faults(schema, v, kind, path))), F.array().cast(FAULT))


def _faults(schema: dict, v: Column, kind: Column, path: Column) -> Column:
    number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    double = F.try_variant_get(v, "$", "double")
    kinds = {"object": kind.startswith("OBJECT"), "array": kind.startswith("ARRAY"), "string": kind == "STRING", "number": number, "integer": number & (double == F.rint(double)), "boolean": kind == "BOOLEAN", "null": kind == "VOID"}
    string = F.when(kinds["string"], F.try_variant_get(v, "$", "string"))
    items = F.when(kinds["array"], F.try_variant_get(v, "$", "array<variant>"))
    at = F.when(path == "", "<root>").otherwise(path)

    def fault(rule: str, detail: Column | None = None) -> Column:
        return F.struct(at.alias("path"), F.lit(rule).alias("rule"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"))

    broken = {
        "type": lambda x: ~kinds[x],
        "enum": lambda x: ~F.to_json(v).isin([text_of(y) for y in x]),
        "const": lambda x: F.to_json(v) != text_of(x),
        "minimum": lambda x: number & (double < x),
        "maximum": lambda x: number & (double > x),
        "minLength": lambda x: F.char_length(string) < x,
        "pattern": lambda x: ~string.rlike(x),
        "minItems": lambda x: F.size(items) < x,
        "maxItems": lambda x: F.size(items) > x,
        "uniqueItems": lambda x: F.lit(x) & let(F.transform(items, lambda i: F.to_json(i)), lambda t: F.size(F.array_distinct(t)) < F.size(t)),
    }
    own = [F.when(condition(schema[rule]), fault(rule)) for rule, condition in broken.items() if rule in schema]
    out = [F.filter(F.array(*own), lambda x: x.isNotNull())] if own else []
    names = F.when(kinds["object"], F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))
    listed = lambda found, rule: F.coalesce(F.transform(F.array_sort(found), lambda n: fault(rule, n)), F.array().cast(FAULT))
    if schema.get("required"):
        out.append(listed(F.array_except(F.array(*map(F.lit, schema["required"])), names), "required"))
    if "additionalProperties" in schema:
        out.append(listed(F.array_except(names, F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>")), "additionalProperties"))
    for name, inner in schema.get("properties", {}).items():
        out.append(compiled(inner, F.when(kinds["object"], F.try_variant_get(v, f"$['{name}']", "variant")), below(path, F.lit(name))))
    if "items" in schema:
        each = F.transform(items, lambda x, i: compiled(schema["items"], x, below(path, i.cast("string"))))
        out.append(F.coalesce(F.flatten(each), F.array().cast(FAULT)))
    return F.concat(*out).cast(FAULT) if out else F.array().cast(FAULT)


def faults(rows: DataFrame, text: str, schema: dict) -> DataFrame:
    """The rows whose JSON in column `text` breaks rules, once for each fault, with path, rule and detail in place of the text."""
    value = F.try_parse_json(F.col(text))
    bad = F.array(F.struct(F.lit("<root>").alias("path"), F.lit("json").alias("rule"), F.lit(None).cast("string").alias("detail"))).cast(FAULT)
    found = F.when(F.col(text).isNotNull() & value.isNull(), bad).otherwise(compiled(schema, value))
    return rows.select(*[c for c in rows.columns if c != text], F.inline(found))


def entity(required: str, **properties: dict) -> dict:
    """An object of exactly these properties, of which the named ones must be there (all for "*")."""
    names = list(properties) if required == "*" else required.split()
    return {"type": "object", "required": names, "additionalProperties": False, "properties": properties}


def some(items: dict, least: int = 0, unique: bool = False) -> dict:
    return {"type": "array", "items": items} | ({"minItems": least} if least else {}) | ({"uniqueItems": True} if unique else {})


# Fixed values of the four kinds of documents: identifiers, words, bounds.
TEXT, ANY_TEXT = {"type": "string", "minLength": 1}, {"type": "string"}
SKILL_ID, POSITION_ID, COURSE_ID, EMPLOYEE_ID = ({"type": "string", "pattern": rf"^{x}_\d{{3}}$"} for x in ("SKILL", "POS", "CRS", "EMP"))
CATEGORY = {"enum": ["programming-language", "database", "ai-ml", "platform", "engineering-practice", "data", "governance"]}
SOURCES = some({"enum": ["esco", "onet", "curated"]}, 1, True)
LEVEL, IMPORTANCE = {"type": "integer", "minimum": 0, "maximum": 4}, {"type": "number", "minimum": 1, "maximum": 5}
EVIDENCE = entity("*", assessment_score={"type": "integer", "minimum": 0, "maximum": 100}, project_experience=ANY_TEXT, self_assessment=LEVEL, training_records=some(ANY_TEXT))
EXTERNAL = entity("", esco_uri=ANY_TEXT, onet_code={"type": "string", "pattern": r"^\d{2}-\d{4}\.\d{2}$"})

#: The schema of one record of each kind.
SCHEMAS = {
    "skills": entity("*", skill_id=SKILL_ID, name=TEXT, category=CATEGORY, description=TEXT, aliases=some(TEXT), sources=SOURCES),
    "positions": entity("*", position_id=POSITION_ID, name=TEXT, description=TEXT, responsibilities=some(TEXT, 1), sources=SOURCES, external_ids=EXTERNAL, skills=some(entity("*", skill_id=SKILL_ID, importance=IMPORTANCE, required_level=LEVEL, sources=SOURCES), 3)),
    "courses": entity("*", course_id=COURSE_ID, uid=TEXT, name=TEXT, description=ANY_TEXT, difficulty={"enum": ["beginner", "intermediate", "advanced"]}, duration_minutes={"type": "integer", "minimum": 1, "maximum": 2000}, learning_objectives=some(TEXT, 1), skills=some(SKILL_ID, 1, True), prerequisites=some(COURSE_ID, 0, True), url={"type": "string", "pattern": r"^https?://\S+$"}, source={"const": "microsoft_learn"}),
    "employees": entity("*", employee_id=EMPLOYEE_ID, name=TEXT, department=TEXT, current_position_id=POSITION_ID, target_position_id=POSITION_ID, years_of_experience={"type": "integer", "minimum": 0, "maximum": 45}, skills=some(entity("*", skill_id=SKILL_ID, level=LEVEL, evidence=EVIDENCE), 5)),
}


def document(kind: str) -> dict:
    """The schema of a whole file: when it was made, and its records."""
    seed = {"seed": {"type": "integer"}} if kind == "employees" else {}
    return entity("*", generated_at=TEXT, **seed, **{kind: some(SCHEMAS[kind], 1)})
