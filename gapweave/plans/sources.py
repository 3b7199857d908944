"""Queries over nested files, pages and folders, which are first written from the driver's tables, and over what stores hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.operators import checks, documents, retrieval, store
from gapweave.operators.commits import Table
from gapweave.plans.skills import query, replayed
from gapweave.sources import readers
from gapweave.sources.scratch import materialise, scratch, spread
from gapweave.sources.views import Domain


def as_json(df: DataFrame, name: str, schema: str) -> DataFrame:
    """`df` written as JSON lines and read with a schema."""
    path = scratch(df.sparkSession, name)
    df.write.json(path)
    return df.sparkSession.read.schema(schema).json(path)


def written(d: Domain, sql: str, **views: DataFrame) -> DataFrame:
    """A statement over the views that it names in braces."""
    return d.spark.sql(sql, **views)


def aliases(d: Domain) -> DataFrame:
    return d["skill"].select("skill_id", F.concat(F.lit(" "), F.upper("skill_id"), F.lit(" ;")).alias("label"))


def esco_docs(d: Domain) -> DataFrame:
    """An occupation file for each position: skills of importance 4 and 5 are essential, those of level 3 and 4 optional, too."""
    rows = d["requires"].join(d["job"], "position_id").withColumn("title", F.lower("skill_id"))
    links = rows.groupBy("name").agg(F.collect_list(F.when(F.col("importance") >= 4, F.struct("title"))).alias("e"), F.collect_list(F.when(F.col("required_level") >= 3, F.struct("title"))).alias("o"))
    other = F.array(F.struct(F.lit("perform research").alias("title")))
    detail = F.struct(F.col("name").alias("title"), F.lower("name").alias("uri"), F.struct(F.struct(F.lit("x").alias("literal")).alias("en")).alias("description"), F.struct(F.concat("e", other).alias("hasEssentialSkill"), F.concat("o", other).alias("hasOptionalSkill")).alias("_links"))
    return as_json(links.select(F.lower("name").alias("query"), detail.alias("detail")), "occupations", readers.OCCUPATION)


def onet_docs(d: Domain) -> DataFrame:
    """The same positions with rated skills (importance and half the level over ten) and technologies of uneven number."""
    rows = d["requires"].join(d["job"], "position_id").join(d["skill"], "skill_id")
    rated = rows.groupBy("name").agg(F.collect_list(F.struct(F.concat("skill_id", F.lit(" ")).alias("element_name"), (F.col("importance") - F.col("required_level") / 5.0).alias("data_value"))).alias("skills"), F.collect_list(F.when(F.col("skill_no") % 2 == 1, F.struct(F.upper("skill_id").alias("element_name")))).alias("t"))
    return as_json(rated.select(F.lower("name").alias("code"), F.struct(F.col("name").alias("title"), F.lit("").alias("description")).alias("occupation"), "skills", F.array(F.struct(F.col("t").alias("example"))).alias("technology_skills")), "rated-occupations", readers.RATED)


ESCO = ", esco AS (SELECT name AS position, skill_id, CASE WHEN importance >= 4 THEN 5.0 ELSE 3.0 END::DOUBLE AS importance, CASE WHEN importance >= 4 THEN 3 ELSE 2 END AS required_level, 'esco' AS source FROM requires JOIN job USING (position_id) WHERE importance >= 4 OR required_level >= 3)"
ONET = ", rated AS (SELECT name AS position, skill_id, greatest(importance - required_level / 5.0, CASE WHEN skill_no % 2 = 1 THEN 3.5 ELSE 0 END)::DOUBLE AS importance FROM requires JOIN job USING (position_id) JOIN skill USING (skill_id)), onet AS (SELECT position, skill_id, importance, CASE WHEN importance >= 4.25 THEN 4 WHEN importance >= 3.5 THEN 3 WHEN importance >= 2.5 THEN 2 ELSE 1 END AS required_level, 'onet' AS source FROM rated)"
CURATED = ", cur AS (SELECT name AS position, skill_id, importance::DOUBLE AS importance, required_level, 'curated' AS source FROM requires JOIN job USING (position_id) WHERE required_level > 0)"


@query(ESCO + " SELECT position, skill_id, importance, required_level, source FROM esco")
def occupation_scan(d: Domain) -> DataFrame:
    return readers.occupations(esco_docs(d), aliases(d))


@query(ONET + " SELECT position, skill_id, importance, required_level, source FROM onet")
def rated_occupation_scan(d: Domain) -> DataFrame:
    return readers.rated_occupations(onet_docs(d), aliases(d))


def three_sources(d: Domain) -> list[DataFrame]:
    curated = d["requires"].where("required_level > 0").join(d["job"], "position_id").select(F.col("name").alias("position"), "skill_id", F.col("importance").cast("double").alias("importance"), "required_level", F.lit("curated").alias("source"))
    return [readers.occupations(esco_docs(d), aliases(d)), readers.rated_occupations(onet_docs(d), aliases(d)), curated]


UNION = ESCO + ONET + CURATED + ", every AS (SELECT *, 1 AS k FROM esco UNION ALL SELECT *, 2 FROM onet UNION ALL SELECT *, 3 FROM cur)"


@query(UNION + " SELECT position, skill_id, max(importance) AS importance, max(required_level) AS required_level, list(source ORDER BY k) AS sources FROM every GROUP BY ALL")
def merged_positions(d: Domain) -> DataFrame:
    return readers.merged(*three_sources(d))


@query(UNION + " SELECT skill_id, list_sort(list_distinct(list_append(list(source), 'curated'))) AS sources FROM every GROUP BY skill_id")
def skill_provenance(d: Domain) -> DataFrame:
    return readers.provenance(*three_sources(d))


MODULES = "SELECT concat('uid.', course_id) AS uid, concat(name, CASE course_id % 4 WHEN 0 THEN ' for AI' WHEN 1 THEN ' with an Agent' ELSE ' basics' END) AS title, CASE WHEN course_id % 6 = 2 THEN NULL WHEN course_id % 7 = 3 THEN ' deep learning ' ELSE concat(' About ', name) END AS summary, duration_minutes AS minutes, difficulty, course_id FROM course"


def module_docs(d: Domain) -> DataFrame:
    rows = written(d, MODULES.replace("FROM course", "FROM {course}"), course=d["course"])
    levels = F.when(F.col("course_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("beginner"), "difficulty", F.lit("expert")))
    units = F.array(F.concat("uid", F.lit(".u1")), F.concat("uid", F.lit(".gone")), F.concat("uid", F.lit(".u2")))
    return as_json(rows.select("uid", "title", "summary", levels.alias("levels"), F.array(F.lit("developer"), F.lit("student")).alias("roles"), F.col("minutes").alias("duration_in_minutes"), F.concat(F.lit("https://x.example/"), "uid", F.lit("?WT.mc_id=1")).alias("url"), units.alias("units")), "modules", readers.MODULE)


OBJECTIVES = "CASE WHEN course_id % 3 = 0 THEN [concat('Explain ', name), concat('Apply ', name)] END"


@query(
    f", m AS ({MODULES}), wanted AS (SELECT DISTINCT course_id FROM training_record) SELECT w.course_id, concat('uid.', w.course_id) AS uid, m.title AS name, trim(coalesce(m.summary, '')) AS description, CASE WHEN w.course_id % 5 = 0 OR m.difficulty IS NULL THEN 'beginner' ELSE m.difficulty END AS difficulty, coalesce(m.minutes, 0) AS duration_minutes, CASE WHEN c.course_id IS NOT NULL AND w.course_id % 3 = 0 THEN [concat('Explain ', c.name), concat('Apply ', c.name)] WHEN trim(coalesce(m.summary, '')) <> '' THEN [concat('Summary: ', trim(m.summary))] ELSE ['(no objectives)'] END AS objectives, CASE WHEN m.uid IS NULL THEN '' ELSE concat('https://x.example/', m.uid) END AS url FROM wanted w LEFT JOIN m USING (course_id) LEFT JOIN course c USING (course_id)"
)
def catalogue_courses(d: Domain) -> DataFrame:
    """The courses that records name, with their modules; those that the catalogue lacks have no name."""
    curriculum = d["training_record"].select("course_id", F.concat(F.lit("uid."), "course_id").alias("uid")).distinct()
    objectives = d["course"].where("course_id % 3 = 0").select(F.concat(F.lit("uid."), "course_id").alias("uid"), F.array(F.concat(F.lit("Explain "), "name"), F.concat(F.lit("Apply "), "name")).alias("objectives"))
    return readers.courses(curriculum, module_docs(d), objectives)


@query(
    f", m AS ({MODULES}) SELECT uid, trim(title) AS title, trim(coalesce(summary, '')) AS description, concat('https://x.example/', uid, '?WT.mc_id=1') AS url, concat_ws(chr(10), CASE WHEN course_id % 5 <> 0 THEN concat('难度:beginner, ', difficulty, ', expert') END, CASE WHEN minutes > 0 THEN concat('时长:', minutes, ' 分钟') END, '适用角色:developer, student') AS about, concat('- Start ', uid, chr(10), '- End ', uid) AS unit_list FROM m WHERE regexp_matches(concat(' ', lower(title), ' '), ' ai |agent|rag|prompt') OR regexp_matches(concat(' ', lower(coalesce(summary, '')), ' '), ' ai |deep learning|agent|rag|prompt')"
)
def ai_modules(d: Domain) -> DataFrame:
    units = d["course"].select(F.explode(F.array(F.struct(F.concat(F.lit("uid."), "course_id", F.lit(".u1")).alias("uid"), F.concat(F.lit("Start uid."), "course_id").alias("title")), F.struct(F.concat(F.lit("uid."), "course_id", F.lit(".u2")).alias("uid"), F.concat(F.lit("End uid."), "course_id").alias("title")))).alias("u")).select("u.*")
    docs = readers.ai_modules(module_docs(d), units)
    body = lambda k: F.get("sections.body", F.lit(k))
    return docs.select("uid", "title", "description", "url", body(0).alias("about"), body(1).alias("unit_list"))


@query("SELECT course_id, name, concat('https://x.example/', course_id) AS url FROM course WHERE duration_minutes > 0 ORDER BY course_id LIMIT 20")
def course_urls(d: Domain) -> DataFrame:
    """The first twenty courses that have a page: the limit is the feature."""
    rows = d["course"].withColumn("url", F.when(F.col("duration_minutes") > 0, F.concat(F.lit("https://x.example/"), "course_id")))
    return rows.where("url IS NOT NULL").orderBy("course_id").limit(20).select("course_id", "name", "url")


RESULTS = "SELECT event_id AS place, concat('BV', user_id) AS bvid, concat('<em>Lesson</em> ', event_type) AS title, concat('Up &amp; ', user_id % 7) AS author, concat(CAST(event_id % 2 AS VARCHAR(10)), ':', lpad(CAST(user_id % 40 AS VARCHAR(10)), 2, '0'), ':', lpad(CAST(event_id % 60 AS VARCHAR(10)), 2, '0')) AS duration, CAST(floor(value * 100) AS INT) AS play, CASE WHEN user_id % 3 = 0 THEN '' ELSE concat('<b>on</b> ', event_type) END AS description, event_type AS keyword FROM events"


@query(
    f", r AS ({RESULTS}), ok AS (SELECT *, (event_id % 2) * 60 + user_id % 40 + CASE WHEN event_id % 60 > 0 THEN 1 ELSE 0 END AS minutes FROM r JOIN events ON events.event_id = r.place), best AS (SELECT *, row_number() OVER (PARTITION BY bvid ORDER BY place) AS n FROM ok WHERE minutes >= 10 AND play >= 1000) SELECT bvid, concat('Lesson ', keyword) AS title, concat('Up & ', user_id % 7) AS author, duration, minutes::INT AS minutes, play AS plays, CASE WHEN user_id % 3 = 0 THEN '' ELSE concat('on ', keyword) END AS description, keyword FROM best WHERE n = 1"
)
def video_lessons(d: Domain) -> DataFrame:
    return readers.lessons(written(d, RESULTS.replace("FROM events", "FROM {events}"), events=d["events"]))


@query(
    f", r AS ({RESULTS}), ok AS (SELECT *, (event_id % 2) * 60 + user_id % 40 + CASE WHEN event_id % 60 > 0 THEN 1 ELSE 0 END AS minutes FROM r JOIN events ON events.event_id = r.place), best AS (SELECT *, row_number() OVER (PARTITION BY bvid ORDER BY place) AS n FROM ok WHERE minutes >= 10 AND play >= 1000) SELECT bvid, concat('视频课程:Lesson ', keyword) AS title, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 2 END AS sections, concat('UP主:Up & ', user_id % 7, chr(10), '时长:', duration, '(', minutes, ' 分钟)', chr(10), '播放量:', play, chr(10), '匹配关键词:', keyword) AS about FROM best WHERE n = 1"
)
def video_documents(d: Domain) -> DataFrame:
    docs = readers.lesson_sections(readers.lessons(written(d, RESULTS.replace("FROM events", "FROM {events}"), events=d["events"])))
    return docs.select("bvid", "title", F.size("sections").alias("sections"), F.get("sections.body", F.lit(0)).alias("about"))


HTML = "SELECT course_id, CASE WHEN course_id % 11 = 10 THEN '<p>blocked</p>' ELSE concat('<html><head><meta name=\"description\" content=\"About &amp; ', name, '\"></head><h1 class=\"t\">', name, ' &lt;1&gt;</h1><h2>Learning objectives</h2>', CASE course_id % 3 WHEN 0 THEN concat('<ul><li>Explain ', name, '</li><li>x</li><li><b>Apply</b> it all</li></ul>') WHEN 1 THEN concat('<p>In this module: ', name, '</p>') ELSE '' END, '<h2>Units</h2><p>See <i>below</i></p><p> </p><a class=\"unit-title x\" href=\"1-start\">Start &amp; go</a><a class=\"unit-title\" href=\"2-end\">End</a><h2></h2><p>lost</p><h2>Empty</h2>', CASE WHEN course_id % 5 <> 4 THEN concat('<main id=\"m\"><h1>Unit of ', name, '</h1><p>short</p>', CASE WHEN course_id % 5 <> 3 THEN '<p>A paragraph that is long enough to be taken as text.</p>' ELSE '' END, '</main>') ELSE '' END) END AS html FROM course"


def course_pages(d: Domain) -> DataFrame:
    return written(d, HTML.replace("FROM course", "FROM {course}"), course=d["course"])


@query("SELECT course_id, CASE WHEN course_id % 11 = 10 THEN '' ELSE concat(name, ' <1>') END AS title, CASE WHEN course_id % 11 = 10 THEN '' ELSE concat('About & ', name) END AS description, CASE WHEN course_id % 11 = 10 THEN '' WHEN course_id % 3 = 1 THEN 'Learning objectives, Units' ELSE 'Units' END || CASE WHEN course_id % 11 <> 10 AND course_id % 5 NOT IN (3, 4) THEN ', Empty' WHEN course_id % 11 <> 10 AND course_id % 5 = 3 THEN ', Empty' ELSE '' END AS headings, CASE WHEN course_id % 11 = 10 THEN 'no title' END AS error FROM course")
def course_page_parse(d: Domain) -> DataFrame:
    parsed = readers.page(F.col("html"))
    return course_pages(d).select("course_id", parsed["title"].alias("title"), parsed["description"].alias("description"), F.concat_ws(", ", parsed["sections"]["heading"]).alias("headings"), parsed["error"].alias("error"))


@query("SELECT course_id, CASE WHEN course_id % 11 = 10 THEN [] WHEN course_id % 3 = 0 THEN [concat('Explain ', name), 'Apply it all'] WHEN course_id % 3 = 1 THEN [concat('In this module: ', name)] ELSE [] END AS objectives FROM course")
def page_objectives(d: Domain) -> DataFrame:
    return course_pages(d).select("course_id", readers.objectives(F.col("html")).alias("objectives"))


@query("SELECT course_id, unnest([{'href': '1-start', 'title': 'Start & go'}, {'href': '2-end', 'title': 'End'}], recursive := true) FROM course WHERE course_id % 11 <> 10")
def page_unit_links(d: Domain) -> DataFrame:
    return course_pages(d).select("course_id", F.inline(readers.unit_links(F.col("html"))))


@query("SELECT course_id, CASE WHEN course_id % 11 = 10 OR course_id % 5 = 4 THEN 0 WHEN course_id % 5 = 3 THEN 0 ELSE 1 END AS paragraphs, CASE WHEN course_id % 11 = 10 OR course_id % 5 = 4 THEN 'no main part' WHEN course_id % 5 = 3 THEN 'no paragraphs' END AS error FROM course")
def page_unit_content(d: Domain) -> DataFrame:
    unit = readers.unit_content(F.col("html"))
    return course_pages(d).select("course_id", F.size(unit["paragraphs"]).alias("paragraphs"), unit["error"].alias("error"))


MARKDOWN = "SELECT course_id, concat('# ', name, chr(10), chr(10), 'About ', name, chr(10), chr(10), '## 课程信息', chr(10), chr(10), '难度:', difficulty, chr(10), '时长:', duration_minutes, ' 分钟', CASE WHEN course_id % 2 = 0 THEN concat(chr(10), chr(10), '## 单元目录', chr(10), chr(10), '- one', chr(10), '- two') ELSE '' END, chr(10), chr(10), '课程编号:', course_id, chr(10), '来源:https://x.example/', course_id, chr(10)) AS md FROM course"


def markdown_docs(d: Domain) -> DataFrame:
    about = F.concat(F.lit("难度:"), "difficulty", F.lit("\n时长:"), F.col("duration_minutes").cast("string"), F.lit(" 分钟"))
    units = F.when(F.col("course_id") % 2 == 0, "- one\n- two").otherwise(" ")
    sections = F.array(F.struct(F.lit("课程信息").alias("heading"), about.alias("body")), F.struct(F.lit("单元目录").alias("heading"), units.alias("body")))
    rows = d["course"].select("course_id", F.col("name").alias("title"), F.concat(F.lit("About "), "name", F.lit(" ")).alias("description"), sections.alias("sections"), F.concat(F.lit("https://x.example/"), "course_id").alias("url"))
    return rows.select("course_id", store.markdown(F.col("title"), F.col("description"), F.col("sections"), F.col("course_id").cast("string"), F.col("url")).alias("md"))


@query(f", docs AS ({MARKDOWN}) SELECT course_id, md FROM docs")
def markdown_pages(d: Domain) -> DataFrame:
    """Courses as Markdown, written as text files and read again."""
    path = scratch(d.spark, "markdown")
    store.save_texts(markdown_docs(d), "course_id", "md", path)
    return store.read_texts(d.spark, path, "course_id").select(F.col("course_id").cast("long").alias("course_id"), F.col("text").alias("md"))


@query("SELECT concat('kb/', course_id) AS doc_id, 'module' AS type, name AS title, concat('https://x.example/', course_id) AS url, difficulty, CASE WHEN course_id % 2 = 0 THEN 2 END AS unit_count FROM course")
def resource_index(d: Domain) -> DataFrame:
    """Files as resources: kind by name, title, address, and what the information section says."""
    path = scratch(d.spark, "knowledge")
    store.save_texts(markdown_docs(d).withColumn("course_id", F.concat(F.lit("catalog-"), "course_id")), "course_id", "md", path)
    r = store.resources(store.read_texts(d.spark, path, "file"), "file", "text")
    return r.select(F.concat(F.lit("kb/"), F.replace("file", F.lit("catalog-"), F.lit(""))).alias("doc_id"), "type", "title", "url", F.col("meta")["难度"].alias("difficulty"), F.col("meta")["单元数"].try_cast("int").alias("unit_count"))


@query("SELECT course_id, count(*) AS units, sum(n) AS paragraphs FROM (SELECT course_id, '课程信息' AS unit, 1 AS n FROM course WHERE course_id % 2 = 1 UNION ALL SELECT course_id, unnest(['课程信息', '单元目录']), unnest([1, 2]) FROM course WHERE course_id % 2 = 0 UNION ALL SELECT course_id, NULL, 1 FROM course WHERE false) GROUP BY course_id".replace("'课程信息' AS unit, 1 AS n", "'课程信息' AS unit, 2 AS n"))
def course_units(d: Domain) -> DataFrame:
    u = store.units(markdown_docs(d), "course_id", "md")
    return u.groupBy("course_id").agg(F.count("*").alias("units"), F.sum(F.size("paragraphs")).alias("paragraphs"))


@query("SELECT concat('bench/', item_id) AS doc_id, 1 AS sections, length(trim(text)) AS n FROM benchmark")
def ingest_files(d: Domain) -> DataFrame:
    """Benchmark items as a folder of text files, read back and cut in sections."""
    path = scratch(d.spark, "texts")
    store.save_texts(d["benchmark"], "item_id", "text", path)
    files = store.read_texts(d.spark, path, "item_id").withColumn("doc_id", F.concat(F.lit("bench/"), "item_id"))
    s = documents.sections(files, "doc_id", "text")
    return s.groupBy(F.col("key").alias("doc_id")).agg(F.count("*").cast("int").alias("sections"), F.sum(F.char_length("text")).alias("n"))


TIERS = "SELECT user_id, event_type, ts, value, event_id FROM events"


@query("""SELECT name, source, fetched_at, CASE WHEN NOT fresh AND works THEN 'api' WHEN cached THEN 'cache' ELSE 'fixture' END AS tier FROM (SELECT name, arg_max(event_type, (ts, event_id)) AS source, max(ts) AS fetched_at, arg_max(event_type, (ts, event_id)) = 'view' AND max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS AS fresh, max(value) > 20 AS works, count(*) > 5 AS cached FROM (SELECT *, concat('source-', user_id) AS name FROM events) GROUP BY name)""".replace("arg_max(event_type, (ts, event_id))", "arg_max(event_type, {'t': ts, 'e': event_id})"))
def source_tiers(d: Domain) -> DataFrame:
    """Where each source's data come from, by the newest entry of its log; `view` entries stand for the api."""
    log = d["events"].select(F.concat(F.lit("source-"), "user_id").alias("name"), "event_type", "ts", "event_id", "value")
    now = log.agg(F.max("ts").alias("now"))
    last = log.groupBy("name").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("source"), F.max("ts").alias("fetched_at"), (F.max("value") > 20).alias("works"), (F.count("*") > 5).alias("cached"))
    api = F.when(F.col("source") == "view", "api").otherwise(F.col("source"))
    return last.join(F.broadcast(now)).select("name", "source", "fetched_at", readers.tier(api, F.col("fetched_at"), F.col("now"), F.col("cached"), F.col("works")).alias("tier"))


@query("SELECT name AS key, min(course_id) AS hit, bool_or(name = wanted) AS exact FROM (SELECT name, course_id, name AS wanted FROM course) GROUP BY name")
def search_hits(d: Domain) -> DataFrame:
    """For each course's name, of two results the exact one, which stands second."""
    results = d["course"].select("name", F.explode(F.array(F.struct(F.lit(1).alias("place"), F.concat("name", F.lit(" II")).alias("title"), F.lit(-1).cast("long").alias("course_id")), F.struct(F.lit(2).alias("place"), F.concat(F.lit(" "), F.upper("name")).alias("title"), F.col("course_id")))).alias("r")).select("name", "r.*")
    return readers.hit(results, "name", "title", "place", "name").select(F.col("name").alias("key"), F.col("course_id").alias("hit"), "exact")


@query("""SELECT 'has_skill' AS of, 'level above 4' AS error, count(*) AS n FROM (SELECT count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_custkey, p_brand) WHERE n > 4 HAVING count(*) > 0
UNION ALL SELECT 'requires', 'level of 0', count(*) FROM requires WHERE required_level = 0 HAVING count(*) > 0
UNION ALL SELECT 'training_record', 'score above 100', count(*) FROM events WHERE floor(value) > 100 HAVING count(*) > 0
UNION ALL SELECT 'course', 'no duration', count(*) FROM course WHERE duration_minutes <= 0 HAVING count(*) > 0
UNION ALL SELECT 'course', 'difficulty unknown', count(*) FROM course WHERE difficulty NOT IN ('beginner', 'intermediate', 'advanced') HAVING count(*) > 0
UNION ALL SELECT 'training_record', 'key twice', count(*) FROM (SELECT employee_id, course_id FROM training_record GROUP BY ALL HAVING count(*) > 1) HAVING count(*) > 0""")
def validation_errors(d: Domain) -> DataFrame:
    raw = d["orders"].join(d["lineitem"], F.col("l_orderkey") == F.col("o_orderkey")).join(d["part"], F.col("p_partkey") == F.col("l_partkey")).groupBy("o_custkey", "p_brand").agg(F.count("*").alias("level"))
    rules = {
        "has_skill": (raw, {"level above 4": F.col("level") > 4, "level below 0": F.col("level") < 0}),
        "requires": (d["requires"], {"level of 0": F.col("required_level") == 0, "importance out of 1 to 5": ~F.col("importance").between(1, 5)}),
        "training_record": (d["events"], {"score above 100": F.floor("value") > 100}),
        "course": (d["course"], {"no duration": F.col("duration_minutes") <= 0, "difficulty unknown": ~F.col("difficulty").isin(*readers.DIFFICULTIES)}),
    }
    return checks.broken(rules).unionAll(checks.repeated({"training_record": (d["training_record"], ["employee_id", "course_id"]), "course": (d["course"], ["course_id"])}))


@query("SELECT e.employee_id, e.name, e.target_position_id, count(h.skill_id) AS skills, coalesce(sum(h.level), 0) AS levels FROM employee e LEFT JOIN has_skill h USING (employee_id) GROUP BY ALL")
def processed_scan(d: Domain) -> DataFrame:
    """Employees with their skills as nested JSON, read with a schema and unfolded into rows again."""
    nested = d["employee"].join(store.nested(d["has_skill"], "employee_id", ["skill_id", "level"], "skills"), "employee_id", "left").select("employee_id", "name", "target_position_id", "skills")
    docs = as_json(nested, "employees", "employee_id long, name string, target_position_id int, skills array<struct<skill_id: string, level: int>>")
    rows = docs.select("employee_id", "name", "target_position_id", F.inline_outer("skills"))
    return rows.groupBy("employee_id", "name", "target_position_id").agg(F.count("skill_id").alias("skills"), F.coalesce(F.sum("level"), F.lit(0)).alias("levels"))


DRAWN = "(('0x' || substr(md5(concat('42', ':', '{}', ':', employee_id, ':', skill_id)), 1, 8))::BIGINT % {})"


@query(
    f", j AS (SELECT employee_id, skill_id, greatest(0, least(4, level + CASE WHEN {DRAWN.format('move', 100)} < 34 THEN CASE WHEN {DRAWN.format('way', 2)} = 0 THEN -1 ELSE 1 END ELSE 0 END)) AS level FROM has_skill) SELECT employee_id, skill_id, level::INT AS level, CASE WHEN level = 0 THEN 0 ELSE least(100, level * 22 + {DRAWN.format('score', 13)}) END::INT AS assessment_score, greatest(0, least(4, level + CASE {DRAWN.format('self', 4)} WHEN 0 THEN -1 WHEN 3 THEN 1 ELSE 0 END))::INT AS self_assessment FROM j"
)
def generated_employees(d: Domain) -> DataFrame:
    return store.generated(d["has_skill"], seed=42)


@query(f" SELECT employee_id, count(*) AS skills, round(avg(level), 6) AS mean_level FROM (SELECT employee_id, greatest(0, least(4, level + CASE WHEN {DRAWN.format('move', 100)} < 34 THEN CASE WHEN {DRAWN.format('way', 2)} = 0 THEN -1 ELSE 1 END ELSE 0 END)) AS level FROM has_skill) GROUP BY employee_id")
def employees_or_generated(d: Domain) -> DataFrame:
    """Employees' skills from a file that isn't there, so they are generated."""
    rows = readers.first_of(d.spark, "employee_id long, skill_id string, level int", None, f"{scratch(d.spark, 'missing')}/employees.json", lambda: store.generated(d["has_skill"], seed=42))
    return rows.groupBy("employee_id").agg(F.count("*").alias("skills"), F.round(F.avg("level"), 6).alias("mean_level"))


def later(d: Domain) -> DataFrame:
    """Requirements that come anew: a level more for uneven skills, and each first skill for all positions."""
    return d["requires"].join(d["skill"], "skill_id").where("skill_no % 2 = 1").select("position_id", "skill_id", "importance", (F.col("required_level") + 1).cast("int").alias("required_level")).unionAll(d["job"].select("position_id", F.lit("Brand#1").alias("skill_id"), F.lit(5).alias("importance"), F.lit(4).alias("required_level")).where("false"))


@query("SELECT position_id, skill_id, importance, (required_level + skill_no % 2)::INT AS required_level FROM requires JOIN skill USING (skill_id)")
def graph_merge(d: Domain) -> DataFrame:
    """Edges merged twice with new ones: the second time changes nothing."""
    edges = d["requires"].select("position_id", "skill_id", "importance", "required_level")
    graph = Table.create(d.spark, scratch(d.spark, "graph"), edges.schema, ["position_id", "skill_id"])
    graph.append(edges, ("import", 0))
    for _ in range(2):
        graph.merge(later(d), ("import", 1))
    return graph.read()


@query("SELECT 'Skill' AS label, skill_id AS id, skill_id AS name FROM skill UNION ALL SELECT 'Position', position_id::VARCHAR, name FROM job UNION ALL SELECT 'Course', course_id::VARCHAR, name FROM course UNION ALL SELECT 'Employee', employee_id::VARCHAR, name FROM employee")
def graph_nodes(d: Domain) -> DataFrame:
    return store.nodes({"Skill": (d["skill"], "skill_id", "skill_id"), "Position": (d["job"], "position_id", "name"), "Course": (d["course"], "course_id", "name"), "Employee": (d["employee"], "employee_id", "name")})


@query("SELECT 'REQUIRES' AS type, position_id::VARCHAR AS a, skill_id AS b FROM requires UNION ALL SELECT 'TEACHES', course_id::VARCHAR, skill_id FROM teaches UNION ALL SELECT 'PREREQUISITE', course_id::VARCHAR, prerequisite_id::VARCHAR FROM prerequisite UNION ALL SELECT 'TARGET_POSITION', employee_id::VARCHAR, target_position_id::VARCHAR FROM employee")
def graph_edges(d: Domain) -> DataFrame:
    """Edges unfolded from nested course and position documents."""
    positions = store.nested(d["requires"], "position_id", ["skill_id", "importance"], "skills")
    courses = store.nested(d["teaches"], "course_id", ["skill_id"], "skills").join(store.nested(d["prerequisite"], "course_id", ["prerequisite_id"], "before"), "course_id", "left")
    return store.edges({
        "REQUIRES": (positions.select("position_id", F.explode("skills.skill_id").alias("b")), "position_id", "b"),
        "TEACHES": (courses.select("course_id", F.explode("skills.skill_id").alias("b")), "course_id", "b"),
        "PREREQUISITE": (courses.select("course_id", F.explode("before.prerequisite_id").alias("b")), "course_id", "b"),
        "TARGET_POSITION": (d["employee"], "employee_id", "target_position_id"),
    })


LINES = "SELECT doc_id, unnest(range(len(ls))) AS k, unnest(ls) AS line FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)"


def lines(docs: DataFrame, changed: bool = False) -> DataFrame:
    split = F.split("text", "\n", -1)
    return docs.where("text IS NOT NULL").select("doc_id", F.posexplode(F.slice(split, 1, F.greatest(F.size(split) - 1, F.lit(1))) if changed else split).alias("k", "content"))


@query("SELECT doc_id, count(*) AS chunk_count, md5(string_agg(line, '|' ORDER BY k)) AS content FROM (SELECT l.*, lang, max(k) OVER (PARTITION BY doc_id) AS last FROM (SELECT doc_id, unnest(range(len(ls))) AS k, unnest(ls) AS line, lang FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)) l) WHERE lang IS DISTINCT FROM 'en' OR k < greatest(last, 1) GROUP BY doc_id")
def chunk_upsert(d: Domain) -> DataFrame:
    """Lines of all documents, then those of English ones again without their last: old rows of these documents go."""
    path = scratch(d.spark, "chunks")
    store.save(lines(d["documents"]), path)
    path = store.replace_documents(d.spark, path, lines(d["documents"].where("lang = 'en'"), changed=True), "doc_id")
    rows = d.spark.read.parquet(path).groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.array_sort(F.collect_list(F.struct("k", "content"))).alias("all"))
    return rows.select("doc_id", "chunk_count", F.md5(F.concat_ws("|", "all.content")).alias("content"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)")
def delete_documents(d: Domain) -> DataFrame:
    path = scratch(d.spark, "documents")
    store.save(d["documents"].select("doc_id", "n_chars"), path)
    return d.spark.read.parquet(store.delete_documents(d.spark, path, d["labels"].where("toxic = 1").select("doc_id"), "doc_id"))


@query("SELECT record_id, employee_id, course_id, exam_score, exam_score >= 70 AS passed, CASE WHEN exam_score >= 85 THEN 'solid' WHEN exam_score >= 70 THEN 'consolidate' ELSE 'fail' END AS outcome FROM training_record JOIN course USING (course_id)")
def append_records(d: Domain) -> DataFrame:
    """Records with their assessment, appended in two batches, of which the second comes twice."""
    known = store.assessed(d["training_record"].join(d["course"].select("course_id"), "course_id", "left_semi")).select("record_id", "employee_id", "course_id", "exam_score", "passed", "outcome")
    records = Table.create(d.spark, scratch(d.spark, "records"), known.schema, ["record_id"])
    for number, part in ((0, "record_id % 2 = 0"), (1, "record_id % 2 = 1"), (1, "record_id % 2 = 1")):
        records.append(known.where(part), ("records", number))
    return records.read()


@query("SELECT user_id AS employee_id, (user_id * 7 + event_id % 5)::BIGINT AS course_id, (event_id % 4)::INT AS unit, min(event_id) AS first_event FROM events GROUP BY ALL")
def insert_ignore(d: Domain) -> DataFrame:
    """Finished units, batch after batch: a unit that is there already stays as it is."""
    rows = d["events"].select(F.col("user_id").alias("employee_id"), (F.col("user_id") * 7 + F.col("event_id") % 5).alias("course_id"), (F.col("event_id") % 4).cast("int").alias("unit"), F.col("event_id").alias("first_event"))
    half = (rows.agg(F.max("first_event")).first()[0] or 0) // 2
    progress = Table.create(d.spark, scratch(d.spark, "progress"), rows.schema, ["employee_id", "course_id", "unit"])
    progress.insert(rows.where(F.col("first_event") <= half), ("events", 0))
    progress.insert(rows.where(F.col("first_event") > half), ("events", 1))
    return progress.read()


@query(", fin AS (SELECT employee_id, skill_id, max_by(to_level, record_id)::INT AS l FROM steps GROUP BY ALL) SELECT employee_id, skill_id, coalesce(l, level)::INT AS level, l IS NOT NULL AS synced FROM has_skill FULL JOIN fin USING (employee_id, skill_id)")
def profile_sync(d: Domain) -> DataFrame:
    """Levels after the replay merged into has_skill, with those that the records touched marked."""
    old = d.written("has_skill")
    with spread(d.spark, old.count() + d["training_record"].count()):
        touched = replayed(d).groupBy("employee_id", "skill_id").agg(F.max_by("to_level", "record_id").alias("level")).withColumn("synced", F.lit(True))
        synced = store.merged(old.withColumn("synced", F.lit(False)), materialise(touched, "touched"), ["employee_id", "skill_id"])
        return materialise(synced.select("employee_id", "skill_id", "level", "synced"), "synced")


@query("SELECT skill_id, count(*) AS n, max(required_level) AS top FROM requires GROUP BY skill_id")
def json_documents(d: Domain) -> DataFrame:
    """Skills with the positions that require them, as JSON documents with a date and read again."""
    docs = store.nested(d["requires"], "skill_id", ["position_id", "required_level"], "positions").withColumn("generated_at", store.now_iso())
    back = as_json(docs, "skills", "skill_id string, generated_at string, positions array<struct<position_id: int, required_level: int>>")
    return back.where(F.col("generated_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$")).select("skill_id", F.size("positions").cast("long").alias("n"), F.array_max("positions.required_level").alias("top"))


#: Names of skills and what else they are called in texts (fixed values).
SKILL_NAMES = ("Large Language Models", "Generative AI", "Machine Learning", "AI Agent", "RAG", "Prompt Engineering", "Kubernetes", "Docker", "Python", "SQL", "CI/CD", "Monitoring")
TEXT_ALIASES = {
    "llm": "Large Language Models", "large language model": "Large Language Models", "genai": "Generative AI", "generative ai": "Generative AI", "生成式": "Generative AI",
    "机器学习": "Machine Learning", "machine learning": "Machine Learning", "深度学习": "Machine Learning", "langchain": "AI Agent", "agent": "AI Agent", "智能体": "AI Agent",
    "rag": "RAG", "知识库": "RAG", "向量数据库": "RAG", "milvus": "RAG", "prompt": "Prompt Engineering", "提示词": "Prompt Engineering", "kubernetes": "Kubernetes", "docker": "Docker",
    "python": "Python", "sql": "SQL", "devops": "CI/CD", "监控": "Monitoring", "monitor": "Monitoring",
}
TAGS_SQL = "[x FOR x IN [" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{w.lower()}{chr(39)})' for w in [s, *[a for a, t in TEXT_ALIASES.items() if t == s]])} THEN '{s}' END" for s in SKILL_NAMES) + "] IF x IS NOT NULL]"


@query(f"SELECT doc_id, list_sort({TAGS_SQL}) AS skills FROM documents WHERE text IS NOT NULL")
def tag_documents(d: Domain) -> DataFrame:
    """The skills whose name or alias a document's text holds."""
    rows = d["documents"].where("text IS NOT NULL").select("doc_id", "text")
    return rows.select("doc_id", F.array_sort(retrieval.tags(F.col("text"), SKILL_NAMES, TEXT_ALIASES)).alias("skills"))
