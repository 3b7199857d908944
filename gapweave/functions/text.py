"""Text functions on columns: names, tokens, HTML, intents, information lines. Null for null, unless a function says otherwise."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words with signs that normalisation must keep (fixed values).
PROTECTED = {"c++": "cplusplus", "c#": "csharp", "f#": "fsharp", ".net": "dotnet", "node.js": "nodejs", "vue.js": "vuejs"}
#: Words that say nothing at either end of a skill's name (fixed values).
GENERIC = ("skill", "skills", "ability", "abilities", "knowledge", "proficiency", "expertise", "技术", "技能", "能力", "知识", "经验")
#: Chinese characters as ranges (fixed values).
CHINESE = r"\u4e00-\u9fff\u3400-\u4dbf\uf900-\ufaff"
#: HTML entities that are unescaped, the ampersand last (fixed values).
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def label(text: Column) -> Column:
    """Lower case, single blanks, no signs around."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), r"^[ .;:,]+|[ .;:,]+$", "")


def folded(text: Column) -> Column:
    """Compatibility characters (full width, ligatures) as plain ones, Unicode NFKC; only texts beyond ASCII leave the JVM."""

    @F.arrow_udf("string")
    def nfkc(texts: pa.Array) -> pa.Array:
        return pc.utf8_normalize(texts, form="NFKC")

    return F.when(text.rlike(r"[^\x00-\x7F]"), nfkc(text)).otherwise(text)


def normalized(text: Column) -> Column:
    """A skill's name in its one form: folded, lower case, protected words spelt out, separators as blanks, other signs and
    generic words at the ends dropped, no blanks beside Chinese characters. Null for null."""
    out = F.lower(folded(text))
    for sign, word in PROTECTED.items():
        out = F.replace(out, F.lit(sign), F.lit(f" {word} "))
    out = F.regexp_replace(out, r"[-_/\\+&,]+", " ")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))
    generic = "|".join(GENERIC)
    out = F.regexp_replace(F.regexp_replace(out, f"^(?:(?:{generic})(?: |$))+", ""), f"(?:(?:^| )(?:{generic}))+$", "")
    return F.trim(F.regexp_replace(out, rf"(?<=[{CHINESE}])\s+|\s+(?=[{CHINESE}])", ""))


def name_tokens(text: Column) -> Column:
    """Distinct runs of digits, Latin letters and Chinese characters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^0-9a-z一-鿿]+"), lambda x: x != ""))


def rerank_tokens(text: Column) -> Column:
    """Distinct Latin words and pairs of neighbouring Chinese characters, whatever stands between them."""
    latin = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"))
    chinese = F.regexp_replace(text, "[^一-鿿]", "")
    pairs = F.when(F.char_length(chinese) > 1, F.transform(F.sequence(F.lit(1), F.char_length(chinese) - 1), lambda i: F.substring(chinese, i, 2))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(latin, pairs))


def coverage(query: Column, text: Column) -> Column:
    """Share of the query's tokens that the text has; 0 for none."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, text)) / F.size(query)).otherwise(0.0)


def html_text(html: Column, unescape: bool = True) -> Column:
    """Text without tags, with single blanks."""
    out = F.regexp_replace(html, "<[^>]+>", " ")
    for entity, sign in ENTITIES.items() if unescape else ():
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def html_blocks(html: Column, tag: str) -> Column:
    """The text of every element of a kind, in order."""
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(f"(?s)<{tag}[^>]*>(.*?)</{tag}>")), lambda x: html_text(x)), lambda x: x != "")


def slug(text: Column) -> Column:
    """Lower case, runs of other signs than letters, digits, - and _ as one hyphen; doc if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "-"), "^-+|-+$", "")
    return F.when(out == "", "doc").otherwise(out)


def minutes(duration: Column) -> Column:
    """Whole minutes of HH:MM:SS or MM:SS, seconds rounded up; 0 without any number."""
    parts = F.filter(F.transform(F.split(duration, ":"), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())
    at = lambda k: F.get(parts, F.lit(k))
    up = lambda x: F.when(x > 0, 1).otherwise(0)
    return F.when(F.size(parts) == 3, at(0) * 60 + at(1) + up(at(2))).when(F.size(parts) == 2, at(0) + up(at(1))).when(F.size(parts) == 1, at(0)).otherwise(0)


#: Hours of a week, weeks, and words of questions that want a plan, courses or an answer (fixed values).
HOURS = r"(?i)每(?:周|星期)\s*(\d+(?:\.\d+)?)\s*(?:个)?\s*(?:小时|h|hour)"
WEEKS = r"(\d+)\s*周"
PLAN_WORDS = ("规划", "计划", "路径", "课表", "安排", "帮我规划")
COURSE_WORDS = ("推荐", "学什么", "课程", "top")
ANSWER_WORDS = ("制度", "规定", "政策", "报销", "手册", "为什么", "岗位说明", "职责")


def hours_per_week(text: Column, default: float = 4.0) -> Column:
    return F.coalesce(F.regexp_extract(text, HOURS, 1).try_cast("double"), F.lit(default))


def weeks(text: Column, default: int = 8) -> Column:
    """The first number of weeks that is not part of hours a week, 1 at least."""
    found = F.regexp_extract(F.regexp_replace(text, HOURS, ""), WEEKS, 1).try_cast("int")
    return F.coalesce(F.greatest(F.lit(1), found), F.lit(default))


def compact(text: Column) -> Column:
    """Lower case without white space and common separators."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\-_/·,，。:：]+", ""))


def employee_key(text: Column) -> Column:
    """The number of an employee that a text names as emp_1, EMP-1 or emp1; null without."""
    return F.regexp_extract(compact(text), r"emp(\d+)", 1).try_cast("long")


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(text.rlike("|".join(words)), F.lit(False))


def json_object(text: Column) -> Column:
    """From the first opening to the last closing brace; null without."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def meta_lines(text: Column) -> Column:
    """Lines of `key: value` (or with a full-width colon) as a map; of equal keys the last counts, other lines are left out."""
    pairs = F.transform(F.split(text, r"\r?\n"), lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:：]*)[:：](.*)$", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^([^:：]*)[:：](.*)$", 2)).alias("v")))
    named = F.filter(pairs, lambda p: p.k != "")
    return F.map_from_entries(F.filter(named, lambda p, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda q: q.k == p.k)))


def source_url(text: Column) -> Column:
    """What follows 来源: up to the next blank; empty without."""
    return F.regexp_extract(text, r"来源[:：]\s*(\S+)", 1)


def folded_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))
