"""Queries over names, documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave import api
from gapweave.functions import text as T
from gapweave.operators import documents, ingestion, normalise, tagging
from gapweave.plans.skills import query, vectors_sql
from gapweave.sources.scratch import materialise, scratch
from gapweave.sources.views import Domain

#: Names as people write them, from the names in `part` and `nation`.
RAW = "raws AS (SELECT DISTINCT p_name AS raw FROM part UNION SELECT concat(upper(p_name), ' Skills') FROM part UNION SELECT concat('knowledge ', replace(p_name, ' ', '-')) FROM part UNION SELECT concat(p_name, 's') FROM part UNION SELECT concat('C++ & ', p_brand, '!') FROM part UNION SELECT n_name FROM nation)"
LABELS = "labels AS (SELECT DISTINCT p_brand AS skill_id, p_name AS label FROM part UNION SELECT p_brand, concat('C++ ', p_brand) FROM part)"
PLAIN = r"""trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(lower(x), 'c++', ' cplusplus '), 'c#', ' csharp '), 'f#', ' fsharp '), '.net', ' dotnet '), 'node.js', ' nodejs '), 'vue.js', ' vuejs '), '[-_/\\+&,]+', ' ', 'g'), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')), '^((skill|skills|ability|abilities|knowledge|proficiency|expertise)( |$))+', ''), '((^| )(skill|skills|ability|abilities|knowledge|proficiency|expertise))+$', ''))"""


def plain_sql(x: str) -> str:
    return PLAIN.replace("lower(x)", f"lower({x})")


def raws(d: Domain) -> DataFrame:
    p, n = d["part"], d["nation"]
    forms = [p.select("p_name"), p.select(F.concat(F.upper("p_name"), F.lit(" Skills"))), p.select(F.concat(F.lit("knowledge "), F.replace("p_name", F.lit(" "), F.lit("-")))), p.select(F.concat("p_name", F.lit("s"))), p.select(F.concat(F.lit("C++ & "), "p_brand", F.lit("!"))), n.select("n_name")]
    out = forms[0]
    for f in forms[1:]:
        out = out.unionAll(f)
    return out.distinct().toDF("raw")


def labels(d: Domain) -> DataFrame:
    p = d["part"]
    return p.select(F.col("p_brand").alias("skill_id"), F.col("p_name").alias("label")).unionAll(p.select("p_brand", F.concat(F.lit("C++ "), "p_brand"))).distinct()


@query(f", {RAW} SELECT raw, {plain_sql('raw')} AS normalized FROM raws")
def normalized_names(d: Domain) -> DataFrame:
    return raws(d).withColumn("normalized", T.normalized(F.col("raw")))


LIBRARY = f", {RAW}, {LABELS}, lib AS (SELECT skill_id, label, {plain_sql('label')} AS norm FROM labels), alias AS (SELECT norm, max(skill_id) AS skill_id FROM lib WHERE norm <> '' GROUP BY norm), asked AS (SELECT raw, {plain_sql('raw')} AS text FROM raws)"


@query(LIBRARY + " SELECT raw, a.skill_id FROM asked LEFT JOIN alias a ON a.norm = asked.text")
def alias_lookup(d: Domain) -> DataFrame:
    return normalise.by_alias(raws(d), normalise.alias_index(labels(d)))


NORMALISED = (
    LIBRARY
    + ", open AS (SELECT raw, text FROM asked WHERE text <> '' AND text NOT IN (SELECT norm FROM alias)), libt AS (SELECT DISTINCT norm, norm AS text FROM lib WHERE norm <> '')"
    + vectors_sql("open", "raw")
    + vectors_sql("libt", "norm")
    + """, sims AS (SELECT a.raw, b.norm, sum(a.value * b.value) AS s FROM raw_v a JOIN norm_v b USING (dim) GROUP BY ALL),
best AS (SELECT raw, skill_id, round(max(s), 6) AS score FROM sims JOIN lib USING (norm) GROUP BY ALL HAVING max(s) >= 0.6 - 1e-9),
ranked AS (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY score DESC, skill_id) AS place FROM best),
mapped AS (SELECT q.raw, q.text AS normalized, coalesce(a.skill_id, r.skill_id) AS skill_id, CASE WHEN a.skill_id IS NOT NULL THEN 'alias' WHEN r.skill_id IS NOT NULL THEN 'embedding' END AS method, CASE WHEN a.skill_id IS NOT NULL THEN 1.0 ELSE r.score END::DOUBLE AS score FROM asked q LEFT JOIN alias a ON a.norm = q.text LEFT JOIN ranked r ON r.raw = q.raw AND r.place = 1)"""
)


@query(NORMALISED + " SELECT raw, skill_id, score, place FROM ranked WHERE place <= 3")
def normalise_candidates(d: Domain) -> DataFrame:
    return normalise.candidates(normalise.unmatched(raws(d), normalise.alias_index(labels(d))), labels(d))


@query(NORMALISED + " SELECT raw, normalized, skill_id, method, score FROM mapped")
def normalise_skills(d: Domain) -> DataFrame:
    return normalise.cascade(raws(d), labels(d))


@query(NORMALISED + " SELECT raw, skill_id, method FROM mapped")
def skill_id_map(d: Domain) -> DataFrame:
    """The mapping written as JSON and read again."""
    path = scratch(d.spark, "skill-id-map")
    normalise.cascade(raws(d), labels(d)).select("raw", "skill_id", "method").write.json(path)
    return d.spark.read.schema("raw string, skill_id string, method string").json(path)


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def embedded_json(d: Domain) -> DataFrame:
    """What stands between the braces of answers with words around them."""
    answer = F.concat(F.lit("Here it is:\n```json "), "props", F.lit("\n``` Done."))
    return d["events"].select("event_id", F.get_json_object(T.json_object(answer), "$.k").try_cast("int").alias("k"))


@query(NORMALISED + " SELECT *, round_even(n / (SELECT count(*) FROM mapped), 4) AS share FROM (SELECT 'total' AS kind, NULL AS name, count(*) AS n FROM mapped UNION ALL SELECT 'matched', NULL, count(skill_id) FROM mapped UNION ALL SELECT CASE WHEN skill_id IS NULL THEN 'unmatched' ELSE 'skill' END, coalesce(skill_id, raw), count(*) FROM mapped GROUP BY 1, 2)")
def normalise_summary(d: Domain) -> DataFrame:
    return normalise.summary(materialise(normalise.cascade(raws(d), labels(d)), "mapped"))


#: A document's lines, whether they are headings, and the section that each belongs to.
SECTIONS = r""", lines AS (SELECT doc_id, n, line, regexp_matches(line, '^#{1,6}\s+\S') AND NOT regexp_matches(line, '^#{1,6}\s+#*\s*$') AS is_heading FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS n FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\r\n|\n|\r') AS ls FROM documents))),
placed AS (SELECT *, sum(is_heading::INT) OVER (PARTITION BY doc_id ORDER BY n) AS k FROM lines),
heads AS (SELECT doc_id, k, CASE WHEN is_heading THEN length(regexp_extract(line, '^(#{1,6})\s', 1)) END AS level, regexp_extract(line, '^#{1,6}\s+(.+?)\s*#*\s*$', 1) AS heading FROM placed WHERE is_heading),
bodies AS (SELECT doc_id, k, regexp_replace(coalesce(string_agg(CASE WHEN NOT is_heading THEN line END, chr(10) ORDER BY n), ''), '^\s+|\s+$', '', 'g') AS body FROM placed GROUP BY ALL),
kept AS (SELECT b.doc_id, b.k, CASE WHEN b.k >= 2 THEN h.heading END AS heading, CASE WHEN b.k >= 2 THEN h.level ELSE 0 END AS level, body, t.heading AS title FROM bodies b LEFT JOIN heads h ON h.doc_id = b.doc_id AND h.k = b.k LEFT JOIN heads t ON t.doc_id = b.doc_id AND t.k = 1),
secs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS section FROM (SELECT *, count(*) FILTER (k >= 2 OR body <> '') OVER (PARTITION BY doc_id) AS filled FROM kept) WHERE k >= 2 OR body <> '' OR (filled = 0 AND k = 0))"""


@query(SECTIONS + " SELECT doc_id::VARCHAR AS key, title, section, level, heading, md5(body) AS body FROM secs")
def document_sections(d: Domain) -> DataFrame:
    return documents.sections(d["documents"]).select("key", "title", "section", "level", "heading", F.md5("text").alias("body"))


#: Chunks: paragraphs or sentences are units, greedily packed within runs of one kind by recursion over their numbers.
CHUNKS = SECTIONS + r""", up AS (SELECT s.doc_id, s.section, string_agg(a.heading, ' > ' ORDER BY a.k) AS path FROM secs s JOIN secs a ON a.doc_id = s.doc_id AND s.heading IS NOT NULL AND a.heading IS NOT NULL AND (a.k = s.k OR a.k < s.k AND a.level < s.level AND NOT EXISTS (SELECT 1 FROM secs b WHERE b.doc_id = s.doc_id AND b.k > a.k AND b.k <= s.k AND b.level <= a.level)) GROUP BY ALL),
paras AS (SELECT doc_id, section, n, trim(regexp_replace(p, '\s+', ' ', 'g')) AS p FROM (SELECT doc_id, section, unnest(ps) AS p, unnest(range(len(ps))) AS n FROM (SELECT doc_id, section, string_split_regex(body, '
\s*
+') AS ps FROM secs))),
sents AS (SELECT doc_id, section, n, unnest(range(len(ss))) AS m, unnest(ss) AS x FROM (SELECT doc_id, section, n, regexp_extract_all(p, '[^。!?！？;；]*[。!?！？;；]|[^。!?！？;；]+') AS ss FROM paras WHERE length(p) > 800)),
parts AS (SELECT doc_id, section, n, 0 AS m, 0 AS h, p AS x, 'p' AS kind FROM paras WHERE length(p) BETWEEN 1 AND 800
 UNION ALL SELECT doc_id, section, n, m, 0, x, 's' FROM sents WHERE length(x) <= 800
 UNION ALL SELECT doc_id, section, n, m, h, substr(x, 1 + h * 800, 800), 'h' FROM (SELECT *, unnest(range(((length(x) + 799) // 800)::BIGINT)) AS h FROM sents WHERE length(x) > 800)),
numbered AS (SELECT *, row_number() OVER w AS u, lag(kind) OVER w AS before, lag(n) OVER w AS before_n FROM parts WINDOW w AS (PARTITION BY doc_id, section ORDER BY n, m, h)),
packed(doc_id, section, u, chunk, size) AS (SELECT doc_id, section, u, 1, length(x) FROM numbered WHERE u = 1
 UNION ALL SELECT t.doc_id, t.section, t.u, p.chunk + CASE WHEN joins THEN 0 ELSE 1 END, CASE WHEN joins THEN p.size + gap + length(t.x) ELSE length(t.x) END FROM packed p JOIN (SELECT *, CASE WHEN kind = 'p' THEN 1 ELSE 0 END AS gap, kind = before AND (kind = 'p' OR kind = 's' AND n = before_n) AS alike FROM numbered) t ON t.doc_id = p.doc_id AND t.section = p.section AND t.u = p.u + 1, LATERAL (SELECT t.alike AND p.size + t.gap + length(t.x) <= 800 AS joins) j),
pieces AS (SELECT t.doc_id, t.section, p.chunk, CASE WHEN any_value(t.kind) = 'p' THEN string_agg(t.x, chr(10) ORDER BY t.u) ELSE string_agg(t.x, '' ORDER BY t.u) END AS content FROM packed p JOIN numbered t USING (doc_id, section, u) GROUP BY ALL),
chunks AS (SELECT doc_id, coalesce(title, doc_id::VARCHAR) AS title, coalesce(path, '') AS path, content, row_number() OVER (PARTITION BY doc_id ORDER BY section, chunk) - 1 AS chunk_index FROM pieces JOIN secs USING (doc_id, section) LEFT JOIN up USING (doc_id, section))"""


@query(CHUNKS + " SELECT doc_id::VARCHAR AS doc_id, printf('%s:%04d', doc_id::VARCHAR, chunk_index) AS chunk_id, concat('《', title, '》', CASE WHEN path <> '' THEN concat(' ', path) ELSE '' END) AS citation, content FROM chunks")
def chunk_documents(d: Domain) -> DataFrame:
    c = documents.chunks(d["documents"])
    return c.select("doc_id", documents.chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), documents.citation(F.col("title"), F.col("path")).alias("citation"), "content")


@query("SELECT doc_id::VARCHAR AS doc_id, 'nothing to chunk' AS error FROM documents WHERE regexp_replace(coalesce(text, ''), '^\\s*(#{1,6}\\s[^\\n]*)?\\s*$', '') = ''".replace("\\\\", "\\"))
def empty_documents(d: Domain) -> DataFrame:
    return documents.without_chunks(d["documents"], documents.chunks(d["documents"]))


@query(CHUNKS + " SELECT doc_id::VARCHAR AS doc_id, title, count(*) AS chunk_count, min(length(content))::INT AS shortest FROM chunks GROUP BY ALL")
def chunk_counts(d: Domain) -> DataFrame:
    """Every document with its title, number of chunks and the fewest characters of one."""
    c = documents.chunks(d["documents"])
    return c.groupBy("doc_id", "title").agg(F.count("*").alias("chunk_count"), F.min(F.char_length("content")).alias("shortest"))


@query()
def cited_context(d: Domain) -> DataFrame:
    """For every benchmark item a text with the four best of the twelve nearest chunks and where they are from."""
    return api.ask(d["benchmark"], api.ingest(d["documents"])["chunks"], "item_id", "text")["context"]


QUESTIONS = "questions AS (SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN concat('每周', 3 + conv_id % 4, '.5 个小时,EMP_', conv_id, ' 帮我规划,', 2 + turn, '周内学完 ', text) WHEN 1 THEN concat('emp-', conv_id, ' 推荐什么课程? 0 周 ', text) WHEN 2 THEN concat('每星期 ', 4 + turn % 3, ' h 报销制度? ', text) ELSE text END AS text FROM conversations)"
HOURS_SQL = "'(?i)每(?:周|星期)\\s*(\\d+(?:\\.\\d+)?)\\s*(?:个)?\\s*(?:小时|h|hour)'"
COMPACT_SQL = r"lower(regexp_replace(text, '[\s\-_/·,，。:：]+', '', 'g'))"
INTENTS = f""", {QUESTIONS} SELECT conv_id, turn, coalesce(TRY_CAST(nullif(regexp_extract(text, {HOURS_SQL}, 1), '') AS DOUBLE), 4) AS hours_per_week,
coalesce(greatest(1, TRY_CAST(nullif(regexp_extract(regexp_replace(text, {HOURS_SQL}, '', 'g'), '(\\d+)\\s*周', 1), '') AS INT)), 8) AS deadline_weeks, TRY_CAST(nullif(regexp_extract({COMPACT_SQL}, 'emp(\\d+)', 1), '') AS BIGINT) AS employee_id,
regexp_matches(text, '规划|计划|路径|课表|安排') AS wants_plan, regexp_matches(text, '规划|计划|路径|课表|安排|推荐|学什么|课程|top') AS wants_courses, regexp_matches(text, '制度|规定|政策|报销|手册|为什么|岗位说明|职责') AS wants_answer FROM questions"""


@query(INTENTS)
def intent_parse(d: Domain) -> DataFrame:
    q = d["conversations"]
    start = F.col("text")
    k, t = F.col("conv_id"), F.col("turn")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("每周"), (3 + k % 4).cast("string"), F.lit(".5 个小时,EMP_"), k.cast("string"), F.lit(" 帮我规划,"), (2 + t).cast("string"), F.lit("周内学完 "), start))
        .when(k % 5 == 1, F.concat(F.lit("emp-"), k.cast("string"), F.lit(" 推荐什么课程? 0 周 "), start))
        .when(k % 5 == 2, F.concat(F.lit("每星期 "), (4 + t % 3).cast("string"), F.lit(" h 报销制度? "), start))
        .otherwise(F.col("text"))
    )
    q = q.select("conv_id", "turn", text.alias("text"))
    x = F.col("text")
    plan = T.has_any(x, T.PLAN_WORDS)
    return q.select("conv_id", "turn", T.hours_per_week(x).alias("hours_per_week"), T.weeks(x).alias("deadline_weeks"), T.employee_key(x).alias("employee_id"), plan.alias("wants_plan"), (plan | T.has_any(x, T.COURSE_WORDS)).alias("wants_courses"), T.has_any(x, T.ANSWER_WORDS).alias("wants_answer"))


@query(r"SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(lower(regexp_extract(url, '^https?://([^?#]*)', 1)), '[^\p{L}\p{N}_]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'doc') AS slug FROM pages")
def page_slugs(d: Domain) -> DataFrame:
    return d["pages"].select("page_id", T.slug(F.regexp_extract("url", r"^https?://([^?#]*)", 1)).alias("slug"))


@query("SELECT doc_id, length(text) AS n, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS folded FROM documents".replace("\\\\", "\\"))
def folded_texts(d: Domain) -> DataFrame:
    return d["documents"].select("doc_id", F.char_length("text").cast("long").alias("n"), F.md5(T.folded_blanks(F.col("text"))).alias("folded"))


WORDS = "SELECT DISTINCT item_id, lower(w) AS w FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS w FROM benchmark)"


@query(
    f""", dictionary AS (SELECT DISTINCT w AS alias, concat('topic-', substr(md5(w), 1, 2)) AS name FROM ({WORDS})),
places AS (SELECT doc_id, name, min(instr(lower(text), alias)) AS place FROM documents, dictionary WHERE contains(lower(text), alias) GROUP BY ALL)
SELECT d.doc_id, coalesce((SELECT list(name ORDER BY place, name) FROM places p WHERE p.doc_id = d.doc_id), []) AS names FROM documents d"""
)
def tag_from_table(d: Domain) -> DataFrame:
    """The topics of every document, by the words of all benchmark items as aliases, in the order of their first places."""
    words = d["benchmark"].select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{4,})"))).alias("w")).select(F.lower("w").alias("alias")).distinct()
    dictionary = words.select("alias", F.concat(F.lit("topic-"), F.substring(F.md5("alias"), 1, 2)).alias("name"))
    return tagging.tagged(d["documents"].select("doc_id", "text"), "text", dictionary).select("doc_id", "names")


@query("SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 11 <> 0 THEN sha256(coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN ' more' ELSE '' END) END AS digest, CASE WHEN doc_id % 11 = 0 THEN 'gone' WHEN doc_id % 7 = 0 THEN 'changed' END AS state FROM documents")
def incremental_ingest(d: Domain) -> DataFrame:
    """The manifest after all documents were ingested and then again with some changed and some gone, and what the second time was cut anew."""
    kept = ingestion.tables_at(d.spark, scratch(d.spark, "ingestion"))
    docs = d["documents"].select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ingestion.refresh(kept, docs)
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))
    states = ingestion.refresh(kept, docs.where("doc_id % 11 <> 0").withColumn("text", text))
    return kept["manifest"].read().join(states, "doc_id", "full").select("doc_id", "digest", "state")
