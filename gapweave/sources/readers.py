"""Readers of occupation files, course catalogues, search results, pages and folders of texts, and the choice of a source's tier.

Nested files are read with a schema, so a missing field is null; what each parser does with it is said there. Labels are
matched with skills by an alias table (label in its plain form, skill_id). Repeated documents and entries count once for
each skill. Empty files give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapweave.functions.text import html_blocks, html_text, label, minutes

OCCUPATION = "query string, detail struct<title: string, uri: string, description: struct<en: struct<literal: string>>, _links: struct<hasEssentialSkill: array<struct<title: string>>, hasOptionalSkill: array<struct<title: string>>>>"
RATED = "code string, occupation struct<title: string, description: string>, tasks array<struct<task: string>>, skills array<struct<element_name: string, data_value: double>>, technology_skills array<struct<example: array<struct<element_name: string>>>>"
MODULE = "uid string, title string, summary string, levels array<string>, roles array<string>, duration_in_minutes int, url string, units array<string>"
#: Importance and level of essential and optional skills; importance of a technology; importance from which a level is asked for (fixed values).
ESSENTIAL, OPTIONAL, TECHNOLOGY = (5.0, 3), (3.0, 2), 3.5
LEVELS = ((4.25, 4), (3.5, 3), (2.5, 2))
#: Difficulties from easy to hard (fixed values).
DIFFICULTIES = ("beginner", "intermediate", "advanced")
#: Least minutes and plays of a video that counts as a lesson (fixed values).
LEAST_MINUTES, LEAST_PLAYS = 10, 1000
#: Words in the title or summary of a module on artificial intelligence (fixed values).
AI_WORDS = ("artificial intelligence", " ai ", "machine learning", "generative ai", "large language model", " llm", "copilot", " ai agent", "agent", "rag", "prompt", "neural network", "deep learning", "data scientist", "natural language", "computer vision", "openai")


def matched(rows: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """The rows whose label is an alias, with its skill_id."""
    index = aliases.select(label(F.col("label")).alias("alias"), "skill_id").groupBy("alias").agg(F.max("skill_id").alias("skill_id"))
    return rows.withColumn("alias", label(F.col(column))).join(index, "alias").drop("alias", column)


def strongest(rows: DataFrame, source: str) -> DataFrame:
    """position, skill_id, importance, required_level and source: of a skill's entries the most important one."""
    best = rows.groupBy("position", "skill_id").agg(F.max(F.struct("importance", "required_level")).alias("b"))
    return best.select("position", "skill_id", "b.importance", "b.required_level", F.lit(source).alias("source"))


def occupations(docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Skills of occupations that list essential and optional ones; labels that are no alias are left out."""
    name = F.coalesce("detail.title", "query").alias("position")
    kinds = [docs.select(name, F.explode(f"detail._links.{links}.title").alias("title"), F.lit(i).alias("importance"), F.lit(n).alias("required_level")) for links, (i, n) in (("hasEssentialSkill", ESSENTIAL), ("hasOptionalSkill", OPTIONAL))]
    return strongest(matched(kinds[0].unionAll(kinds[1]), aliases, "title"), "esco")


def level_of(importance: Column) -> Column:
    """1 to 4, by importance."""
    out = F.lit(1)
    for least, n in reversed(LEVELS):
        out = F.when(importance >= least, n).otherwise(out)
    return out


def rated_occupations(docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Skills of occupations that rate them, and technologies, which count as important; a missing rating counts as 0."""
    name = F.coalesce("occupation.title", "code").alias("position")
    skills = docs.select(name, F.explode("skills").alias("s")).select("position", F.col("s.element_name").alias("title"), F.coalesce("s.data_value", F.lit(0.0)).alias("importance"))
    technology = docs.select(name, F.explode(F.flatten("technology_skills.example")).alias("e")).select("position", F.col("e.element_name").alias("title"), F.lit(TECHNOLOGY).alias("importance"))
    rows = matched(skills.unionAll(technology), aliases, "title")
    return strongest(rows.withColumn("required_level", level_of(F.col("importance"))), "onet")


def provenance(*sources: DataFrame) -> DataFrame:
    """skill_id and the sorted sources that name it, curated among them always."""
    rows = sources[0].select("skill_id", "source")
    for s in sources[1:]:
        rows = rows.unionAll(s.select("skill_id", "source"))
    return rows.groupBy("skill_id").agg(F.array_sort(F.array_union(F.collect_set("source"), F.array(F.lit("curated")))).alias("sources"))


def merged(*sources: DataFrame) -> DataFrame:
    """position, skill_id, largest importance and largest level of all sources, and these in the order given here."""
    rows = [s.select("position", "skill_id", "importance", "required_level", F.struct(F.lit(k).alias("k"), "source").alias("of")) for k, s in enumerate(sources)]
    union = rows[0]
    for r in rows[1:]:
        union = union.unionAll(r)
    out = union.groupBy("position", "skill_id").agg(F.max("importance").alias("importance"), F.max("required_level").alias("required_level"), F.array_sort(F.collect_set("of")).alias("of"))
    return out.select("position", "skill_id", "importance", "required_level", F.col("of.source").alias("sources"))


def hit(results: DataFrame, wanted: str, title: str, place: str, key: str) -> DataFrame:
    """Of each key's search results the first of exactly the wanted title (in any case), else the first."""
    exact = F.lower(F.trim(F.col(title))) == F.lower(F.trim(F.col(wanted)))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.when(exact, 0).otherwise(1), place))
    return results.withColumns({"exact": F.coalesce(exact, F.lit(False)), "n": best}).where("n = 1").drop("n")


def hardest(levels: Column) -> Column:
    """The hardest of the known difficulties; beginner without any."""
    ranks = F.transform(F.filter(F.coalesce(levels, F.array().cast("array<string>")), lambda x: x.isin(*DIFFICULTIES)), lambda x: F.array_position(F.array(*map(F.lit, DIFFICULTIES)), x))
    return F.element_at(F.array(*map(F.lit, DIFFICULTIES)), F.greatest(F.lit(1), F.array_max(ranks)).cast("int"))


def courses(curriculum: DataFrame, modules: DataFrame, objectives: DataFrame) -> DataFrame:
    """The curriculum's courses (course_id, uid) with their module's data; null in name where the catalogue has no module.

    Without objectives the summary stands in, without that a remark.
    """
    rows = curriculum.join(modules, "uid", "left").join(objectives, "uid", "left")
    summary = F.trim(F.coalesce("summary", F.lit("")))
    fallback = F.array(F.when(summary != "", F.concat(F.lit("Summary: "), summary)).otherwise("(no objectives)"))
    return rows.select("course_id", "uid", F.col("title").alias("name"), summary.alias("description"), hardest(F.col("levels")).alias("difficulty"), F.coalesce("duration_in_minutes", F.lit(0)).alias("duration_minutes"), F.when(F.size("objectives") > 0, F.col("objectives")).otherwise(fallback).alias("objectives"), F.get(F.split(F.coalesce("url", F.lit("")), r"\?"), F.lit(0)).alias("url"))


def ai_modules(modules: DataFrame, units: DataFrame) -> DataFrame:
    """Title, description and sections (heading, body) of the modules on artificial intelligence; modules without title are left out."""
    words = "|".join(AI_WORDS)
    padded = lambda c: F.concat(F.lit(" "), F.lower(F.coalesce(c, F.lit(""))), F.lit(" "))
    found = modules.where((F.trim("title") != "") & (padded(F.col("title")).rlike(words) | padded(F.col("summary")).rlike(words)))
    titles = found.select("uid", F.posexplode("units").alias("k", "unit")).join(units.select(F.col("uid").alias("unit"), F.col("title").alias("unit_title")), "unit").where("unit_title <> ''")
    listed = titles.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("k", "unit_title"))).alias("t")).select("uid", F.concat_ws("\n", F.transform("t.unit_title", lambda x: F.concat(F.lit("- "), x))).alias("unit_list"))
    joined = lambda c: F.nullif(F.concat_ws(", ", c), F.lit(""))
    about = F.concat_ws("\n", F.concat(F.lit("难度:"), joined("levels")), F.when(F.col("duration_in_minutes") > 0, F.concat(F.lit("时长:"), F.col("duration_in_minutes").cast("string"), F.lit(" 分钟"))), F.concat(F.lit("适用角色:"), joined("roles")))
    sections = F.filter(F.array(F.struct(F.lit("课程信息").alias("heading"), about.alias("body")), F.struct(F.lit("单元目录").alias("heading"), F.coalesce("unit_list", F.lit("")).alias("body"))), lambda s: s.body != "")
    return found.join(listed, "uid", "left").select("uid", F.trim("title").alias("title"), F.trim(F.coalesce("summary", F.lit(""))).alias("description"), "url", sections.alias("sections"))


def lessons(results: DataFrame) -> DataFrame:
    """Videos of enough minutes and plays, each once: of rows with one id the first by `place`."""
    rows = results.select("place", "bvid", F.trim(html_text(F.col("title"))).alias("title"), html_text(F.col("author")).alias("author"), "duration", minutes(F.col("duration")).alias("minutes"), F.coalesce("play", F.lit(0)).alias("plays"), F.left(html_text(F.col("description")), F.lit(300)).alias("description"), "keyword")
    rows = rows.where((F.col("bvid") != "") & (F.col("title") != "") & (F.col("minutes") >= LEAST_MINUTES) & (F.col("plays") >= LEAST_PLAYS))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("bvid").orderBy("place"))).where("n = 1").drop("n", "place")


def lesson_sections(videos: DataFrame) -> DataFrame:
    """Videos as documents: title, description and sections (heading, body)."""
    about = F.concat_ws("\n", F.concat(F.lit("UP主:"), "author"), F.concat(F.lit("时长:"), "duration", F.lit("("), F.col("minutes").cast("string"), F.lit(" 分钟)")), F.concat(F.lit("播放量:"), F.col("plays").cast("string")), F.concat(F.lit("匹配关键词:"), "keyword"))
    sections = F.filter(F.array(F.struct(F.lit("视频信息").alias("heading"), about.alias("body")), F.struct(F.lit("简介").alias("heading"), F.col("description").alias("body"))), lambda s: s.body != "")
    return videos.select("bvid", F.concat(F.lit("视频课程:"), "title").alias("title"), sections.alias("sections"))


def page(html: Column) -> dict[str, Column]:
    """title, description and sections (heading, body) of a course page; a page without title has an error."""
    title = F.coalesce(html_text(F.regexp_extract(html, "(?is)<h1[^>]*>(.*?)</h1>", 1)), F.lit(""))
    described = F.regexp_extract(html, '(?is)<meta[^>]*name="description"[^>]*content="([^"]*)"', 1)
    parts = F.slice(F.split(html, "(?i)<h2[^>]*>"), 2, F.size(F.split(html, "(?i)<h2[^>]*>")))
    section = lambda x: F.struct(html_text(F.regexp_extract(x, "(?is)^(.*?)</h2>", 1)).alias("heading"), F.concat_ws("\n\n", html_blocks(x, "p")).alias("body"))
    sections = F.filter(F.transform(parts, section), lambda s: (s.heading != "") & (s.body != ""))
    return {"title": title, "description": html_text(described), "sections": sections, "error": F.when(title == "", "no title")}


def unit_links(html: Column) -> Column:
    """href and title of every link to a unit."""
    found = F.regexp_extract_all(html, F.lit(r'(<a class="unit-title[^"]*"[^>]*href="[\w-]+"[^>]*>[^<]+</a>)'))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r'href="([\w-]+)"', 1).alias("href"), html_text(x).alias("title")))


def unit_content(html: Column, least_chars: int = 40, most: int = 12) -> dict[str, Column]:
    """title and the first paragraphs of some length of a unit's main part; error without any of them."""
    main = F.regexp_extract(html, "(?is)(<main[^>]*>.*)", 1)
    title = html_text(F.regexp_extract(main, "(?is)<h1[^>]*>(.*?)</h1>", 1))
    paragraphs = F.slice(F.filter(html_blocks(main, "p"), lambda x: F.char_length(x) >= least_chars), 1, most)
    return {"title": title, "paragraphs": paragraphs, "error": F.when(main == "", "no main part").when(title == "", "no title").when(F.size(paragraphs) == 0, "no paragraphs")}


def objectives(html: Column) -> Column:
    """What the list below the heading on learning objectives names, else its first paragraph; empty without."""
    rest = F.regexp_extract(html, r"(?is)<h2[^>]*>\s*(?:<[^>]+>\s*)*Learning objectives(.*?)(?:<h2|$)", 1)
    items = F.filter(html_blocks(F.regexp_extract(rest, "(?s)<ul[^>]*>(.*?)</ul>", 1), "li"), lambda x: F.char_length(x) > 5)
    text = html_text(F.regexp_extract(rest, "(?s)<p[^>]*>(.*?)</p>", 1))
    return F.when(F.size(items) > 0, items).when(F.char_length(text) > 10, F.array(text)).otherwise(F.array().cast("array<string>"))


def folder(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("md", "markdown", "txt"), prefix: str = "") -> DataFrame:
    """file, doc_id (prefix and the file's path below the folder, without suffix) and text of every file of these kinds."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(suffixes)}}}").text(path, wholetext=True)
    file = F.col("_metadata.file_path")
    below = F.regexp_extract(file, rf"{path.rstrip('/').rsplit('/', 1)[-1]}/(.*)\.[A-Za-z]+$", 1)
    return rows.select(file.alias("file"), F.concat(F.lit(prefix), below).alias("doc_id"), F.col("value").alias("text"))


def first_of(spark: SparkSession, schema: str, explicit: str | None, usual: str, built_in: Callable[[], DataFrame]) -> DataFrame:
    """JSON rows of a file that is named, which must be there; else of the usual one if it is there; else the built-in rows."""
    if explicit is not None:
        return spark.read.schema(schema).json(explicit)
    try:
        return spark.read.schema(schema).json(usual)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return built_in()


def tier(source: Column, fetched_at: Column, now: Column, has_cache: Column, api_works: Column, ttl_days: float = 7) -> Column:
    """Where data come from: api if that works, unless a copy fetched from it is younger than ttl_days; else cache, else fixture."""
    fresh = F.coalesce((source == "api") & (fetched_at >= now - F.expr(f"INTERVAL {int(ttl_days * 86400)} SECONDS")), F.lit(False))
    return F.when(~fresh & api_works, "api").when(has_cache, "cache").otherwise("fixture")


def load(spark: SparkSession, name: str, live: Callable[[], DataFrame] | None, fixture: str, raw: str, schema: str, offline: bool = False, refresh: bool = False, ttl_days: float = 7) -> tuple[DataFrame, str]:
    """JSON rows of a source and the tier that they are from. Live rows are written to `raw`; rows there that don't parse
    are passed over for the fixture. `live` raises OSError if its source can't be reached."""
    import datetime as dt

    def read(path: str) -> DataFrame | None:
        try:
            rows = spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        rows.cache()  # Spark reads the column of corrupt rows by itself from cached rows only
        n, bad = rows.count(), rows.where("_corrupt_record IS NOT NULL").count()
        rows.unpersist()
        return None if bad or not n else rows.drop("_corrupt_record")

    now = dt.datetime.now(dt.timezone.utc)
    log = spark.createDataFrame([], "source string, fetched_at timestamp")
    try:
        log = spark.read.schema("source string, fetched_at timestamp").json(f"{raw}/{name}-manifest")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    last = log.orderBy(F.desc("fetched_at")).first()
    fresh = last is not None and last["source"] == "api" and now.replace(tzinfo=None) - last["fetched_at"] <= dt.timedelta(days=ttl_days)
    if live is not None and not offline and (refresh or not fresh):
        try:
            live().write.mode("overwrite").json(f"{raw}/{name}")
        except OSError:
            pass
        else:
            spark.createDataFrame([("api", now.replace(tzinfo=None))], "source string, fetched_at timestamp").write.mode("append").json(f"{raw}/{name}-manifest")
            return read(f"{raw}/{name}"), "api"
    if (rows := read(f"{raw}/{name}")) is not None:
        return rows, "cache"
    return read(fixture), "fixture"
