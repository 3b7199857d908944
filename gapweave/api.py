"""The engine's main jobs as single calls on a mapping of tables (see sources/views.py for their columns).

Tables are DataFrames by name: employee, requires, has_skill, course, teaches, prerequisite, training_record. Whatever the
operators say of nulls, ties, repeated and empty tables holds here.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.operators import catalogue as cat
from gapweave.operators import commits, documents, gap, graph, learning, recall, replay, retrieval, team
from gapweave.sources.scratch import materialise

Tables = Mapping[str, DataFrame]


def nobody(tables: Tables) -> DataFrame:
    """No (employee_id, course_id)."""
    return tables["training_record"].select("employee_id", "course_id").where("false")


def catalogue_of(tables: Tables) -> cat.Catalogue | None:
    """The catalogue as arrays, if it is small enough to broadcast."""
    return cat.Catalogue.of(tables["course"], tables["teaches"], tables["prerequisite"])


def people(tables: Tables, levels: DataFrame, passed: DataFrame | None) -> DataFrame:
    """Everyone with gaps, as lists of levels, gaps and passed courses."""
    return cat.people(levels, gap.gaps(gap.requirements(tables["employee"], tables["requires"], levels)), passed)


def recommend(tables: Tables, top_k: int = 5, exclude: DataFrame | None = None, weights: tuple = recall.WEIGHTS, whole: cat.Catalogue | None = None) -> DataFrame:
    """The top_k courses for everyone, with factors, total and rank; `exclude` has (employee_id, course_id) not to be named.

    Of a catalogue too large to broadcast the courses that may be named are searched piece by piece; `whole` is catalogue_of() the tables, if it is there already.
    """
    levels = materialise(tables["has_skill"], "has-skill")
    if (whole := whole or catalogue_of(tables)) is None:
        edges = [tables[x] for x in ("teaches", "prerequisite")]
        catalogues = cat.Catalogue.pieces(materialise(cat.contenders(tables["course"], *edges, top_k, exclude, weights), "contenders"), *edges)
    else:
        catalogues = [whole]
    return cat.ranked(materialise(people(tables, levels, exclude), "people"), catalogues, top_k, weights)


def reachable(tables: Tables, levels: DataFrame, passed: DataFrame) -> DataFrame:
    """employee_id, course_id and kept of what everyone's candidates lead to; passed and mastered courses are not kept.

    A catalogue too large to broadcast is expanded by joins, a round for each step.
    """
    if (whole := catalogue_of(tables)) is not None:
        return cat.expanded(materialise(people(tables, levels, passed), "people"), whole)
    gaps = gap.gaps(gap.requirements(tables["employee"], tables["requires"], levels))
    roots = materialise(recall.candidates(gaps, tables["teaches"], passed), "candidates")
    near = graph.expanded(roots, tables["prerequisite"], roots.where("false")).select("employee_id", "course_id")
    blocked = passed.unionAll(graph.mastered(recall.average_levels(near, tables["teaches"], levels), tables["course"]))
    return graph.expanded(roots, tables["prerequisite"], materialise(blocked, "blocked"))


def ordered(tables: Tables, levels: DataFrame, passed: DataFrame) -> DataFrame:
    """employee_id, course_id, position and priority of everyone's plan."""
    if (whole := catalogue_of(tables)) is not None:
        return cat.ordered(materialise(people(tables, levels, passed), "people"), whole)
    kept = materialise(reachable(tables, levels, passed).where("kept").select("employee_id", "course_id"), "kept")
    gaps = gap.gaps(gap.requirements(tables["employee"], tables["requires"], levels))
    priority = materialise(graph.with_priority(kept, tables["teaches"], gaps), "priority")
    return graph.topological(kept, tables["prerequisite"], priority).join(priority.withColumn("priority", F.col("priority").cast("double")), ["employee_id", "course_id"])


def ordered_lists(tables: Tables, levels: DataFrame, passed: DataFrame, whole: cat.Catalogue | None = None) -> DataFrame:
    """employee_id, first (position of a list's first course) and list of everyone's plan, in lists of bounded length."""
    if (whole := whole or catalogue_of(tables)) is not None:
        return cat.ordered_lists(materialise(people(tables, levels, passed), "people"), whole)
    return commits.as_lists(ordered(tables, levels, passed), "employee_id", "course_id", "position")


def prioritised(tables: Tables, levels: DataFrame, passed: DataFrame) -> DataFrame:
    """employee_id, course_id and priority of everyone's plan."""
    if (whole := catalogue_of(tables)) is not None:
        return cat.prioritised(materialise(people(tables, levels, passed), "people"), whole)
    kept = materialise(reachable(tables, levels, passed).where("kept").select("employee_id", "course_id"), "kept")
    gaps = gap.gaps(gap.requirements(tables["employee"], tables["requires"], levels))
    return graph.with_priority(kept, tables["teaches"], gaps).withColumn("priority", F.col("priority").cast("double"))


def scheduled(tables: Tables, levels: DataFrame, passed: DataFrame, hours_per_week: float = 4) -> DataFrame:
    """employee_id, week, position, course_id, minutes and continued of everyone's plan."""
    if (whole := catalogue_of(tables)) is not None:
        return cat.scheduled(materialise(people(tables, levels, passed), "people"), whole, hours_per_week)
    return graph.packed(ordered(tables, levels, passed).join(tables["course"].select("course_id", "duration_minutes"), "course_id"), hours_per_week)


def path_totals(tables: Tables, levels: DataFrame, passed: DataFrame, hours_per_week: float = 4, deadline_weeks: int = 8) -> DataFrame:
    """employee_id, course_count, planned_weeks, total_minutes and fits_deadline of everyone's plan."""
    if (whole := catalogue_of(tables)) is not None:
        return cat.totals(materialise(people(tables, levels, passed), "people"), whole, hours_per_week, deadline_weeks)
    return graph.path_totals(scheduled(tables, levels, passed, hours_per_week), deadline_weeks)


def next_course(tables: Tables, levels: DataFrame, passed: DataFrame, done: DataFrame) -> DataFrame:
    """employee_id and the first course_id of everyone's plan that isn't in `done` (employee_id, course_id).

    Plans are worked out only for those few whose first course is not among the first of each set of skills.
    """
    key = ["employee_id", "course_id"]
    whole = catalogue_of(tables)
    part = whole or cat.Catalogue.of_first(*[tables[x] for x in ("course", "teaches", "prerequisite")], done.select(*key).unionAll(passed.select(*key)))
    if part is None:
        return graph.next_course(ordered(tables, levels, passed), done.distinct())
    lists = done.groupBy("employee_id").agg(F.collect_set(F.col("course_id").cast("long")).alias("done"))
    who = materialise(people(tables, levels, passed).join(lists, "employee_id", "left"), "people")
    near = materialise(cat.nearest(who, part), "nearest")
    sure, rest = near.where("sure AND course_id IS NOT NULL").select(*key), near.where("NOT sure").select("employee_id")
    if rest.isEmpty():
        return sure
    if whole is not None:
        return sure.unionAll(cat.following(who.join(rest, "employee_id", "left_semi"), whole))
    some = {**{k: tables[k] for k in ("requires", "course", "teaches", "prerequisite")}, "employee": tables["employee"].join(rest, "employee_id", "left_semi")}
    return sure.unionAll(graph.next_course(ordered(some, levels, passed), done.distinct()))


def prerequisite_context(tables: Tables, levels: DataFrame, passed: DataFrame) -> DataFrame:
    """employee_id and course_id of direct prerequisites of everyone's candidates that are no candidates themselves."""
    if (whole := catalogue_of(tables)) is not None:
        return cat.context(materialise(people(tables, levels, passed), "people"), whole)
    return recall.context(recall.candidates(gap.gaps(gap.requirements(tables["employee"], tables["requires"], levels)), tables["teaches"], passed), tables["prerequisite"])


def context_counts(tables: Tables, levels: DataFrame, passed: DataFrame) -> DataFrame:
    """course_id and for how many employees it is in prerequisite_context(). Pairs of them never become rows."""
    gaps = gap.gaps(gap.requirements(tables["employee"], tables["requires"], levels))
    return recall.context_counts(gaps, tables["teaches"], tables["prerequisite"], passed)


def plan_changes(tables: Tables, before: DataFrame, after: DataFrame, passed: DataFrame, with_place: bool = True) -> DataFrame:
    """employee_id, course_id, change (removed, added) and place (in the plan that has it) between the plan of the levels
    `before`, with nothing passed, and that of the levels `after`. Without places no plan needs to be put in order."""
    if (whole := catalogue_of(tables)) is not None:
        return cat.changes(materialise(people(tables, before, None), "people-before"), materialise(people(tables, after, passed), "people-after"), whole, with_place)
    key, place = ["employee_id", "course_id"], ["place"] * with_place
    if with_place:
        old, new = (materialise(ordered(tables, levels, done), "order").select(*key, F.col("position").alias("place")) for levels, done in ((before, passed.where("false")), (after, passed)))
    else:
        old, new = (materialise(reachable(tables, levels, done).where("kept").select(*key), "kept") for levels, done in ((before, passed.where("false")), (after, passed)))
    return old.join(new, key, "left_anti").withColumn("change", F.lit("removed")).unionByName(new.join(old, key, "left_anti").withColumn("change", F.lit("added"))).select(*key, "change", *place)


def learning_path(tables: Tables, hours_per_week: float = 4, deadline_weeks: int = 8, completed: DataFrame | None = None) -> dict[str, DataFrame]:
    """order (employee_id, course_id, position), plan (by week), totals and pruned courses of everyone's learning path."""
    levels, done = materialise(tables["has_skill"], "has-skill"), nobody(tables) if completed is None else completed
    order = materialise(ordered(tables, levels, done).select("employee_id", "course_id", "position"), "order")
    plan = graph.packed(order.join(tables["course"].select("course_id", "duration_minutes"), "course_id"), hours_per_week)
    pruned = reachable(tables, levels, done).where("NOT kept").select("employee_id", "course_id")
    return {"order": order, "plan": plan, "totals": graph.path_totals(plan, deadline_weeks), "pruned": pruned}


def recalculated(tables: Tables, top_k: int = 5, hours_per_week: float = 4, deadline_weeks: int = 8) -> dict[str, DataFrame]:
    """After all training records: profile, readiness, recommendations and learning path, without courses that are passed."""
    steps = replay.steps(tables["training_record"], tables["course"], tables["teaches"], tables["has_skill"])
    profile = materialise(replay.profile(steps, tables["has_skill"]), "profile")
    passed = materialise(replay.passed_courses(tables["training_record"]), "passed")
    now = {**{k: tables[k] for k in ("employee", "requires", "course", "teaches", "prerequisite", "training_record")}, "has_skill": profile}
    readiness = gap.readiness(now["employee"], gap.requirements(now["employee"], now["requires"], profile))
    return {"profile": profile, "readiness": readiness, "recommendations": recommend(now, top_k, passed), **learning_path(now, hours_per_week, deadline_weeks, passed)}


def team_home(tables: Tables) -> dict[str, DataFrame]:
    """What a manager sees: buckets, common gaps, members, training totals and the newest records."""
    req = gap.requirements(tables["employee"], tables["requires"], tables["has_skill"])
    records = tables["training_record"]
    last = team.recent(records, each=3).join(records.select("record_id", "completed_at"), "record_id")
    return {
        "buckets": learning.histogram(materialise(gap.readiness(tables["employee"], req), "readiness")),
        "gaps": team.team_gaps(gap.gaps(req), tables["employee"], limit=learning.TOP),
        "members": team.member_stats(tables["employee"], records),
        "training": learning.training_totals(records),
        "newest": learning.newest(last),
    }


def ingest(docs: DataFrame, key: str = "doc_id", text: str = "text", max_chars: int = documents.MAX_CHARS) -> dict[str, DataFrame]:
    """chunks (with chunk_id, citation and the text to encode) of documents, and errors for those that give none."""
    chunks = documents.chunks(docs, key, text, max_chars)
    chunks = chunks.select("*", documents.chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), documents.citation(F.col("title"), F.col("path")).alias("citation"), documents.embed_text(F.col("title"), F.col("path"), F.col("content")).alias("embedded"))
    chunks = materialise(chunks, "chunks")
    return {"chunks": chunks, "errors": documents.without_chunks(docs, chunks, key)}


def ask(questions: DataFrame, chunks: DataFrame, key: str, text: str, k: int = 4) -> dict[str, DataFrame]:
    """hits (the k best of several times as many nearest chunks) and context (one cited text) of every question.

    Questions of blanks alone have neither.
    """
    asked = questions.where(F.trim(F.col(text)) != "").select(F.col(key), F.col(text).alias("question"))
    pool = materialise(retrieval.lexical_search(asked, key, "question", chunks, "chunk_id", "embedded", k * retrieval.POOL), "pool")
    best = retrieval.reranked(pool.join(asked, key).join(chunks.select("chunk_id", "embedded"), "chunk_id"), "question", "embedded", key, "chunk_id", k)
    hits = materialise(best.join(chunks.select("chunk_id", "doc_id", "citation", "content"), "chunk_id"), "hits")
    shown = hits.select(key, "place", "citation", F.concat(F.lit("documents/"), "doc_id").alias("source"), F.col("fused").alias("score"), F.col("score").alias("vector_score"), "lexical", "content")
    return {"hits": hits, "context": documents.context(shown, key, "place")}
