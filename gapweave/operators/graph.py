"""Prerequisite chains, pruned closures, schedules and checks of the course graph.

Graphs are edge tables; searches go on in rounds that write what they find to the shared folder. Chains, closures and cycles
take a round for each doubling of the number of steps: walks of exactly 2**k steps are joined with themselves, and with all
shorter ones, so the number of rounds is the logarithm of the longest way. expanded(), cycle_paths() and, up to MOST_ROUNDS
steps, on_cycles() take a round a step. Edges whose ends are null lead nowhere. Repeated edges count once. Empty tables give empty results.
Ties are broken by smaller course_id, as each function says. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapweave.sources.scratch import materialise, spread

#: Average level over a course's skills from which it is mastered, by difficulty (fixed values).
MASTERED = {"beginner": 2, "intermediate": 3, "advanced": 4}
#: Peeling goes on while a round takes away one edge in so many at least.
PEEL = 10
#: Steps of a search for cycles that are taken one by one, at most.
MOST_ROUNDS = 40


def doubled(jump: DataFrame) -> DataFrame:
    """(a, b) of walks of twice as many steps."""
    onward = jump.select(F.col("a").alias("b"), F.col("b").alias("c"))
    return materialise(jump.join(onward, "b").select("a", F.col("c").alias("b")).distinct(), "jumps")


def walks(edges: DataFrame, acyclic: bool) -> DataFrame:
    """a, b and depth (most steps of a walk from a to b) of all pairs that edges (a, b) connect.

    If `acyclic`, a pair of equal ends is an error as soon as it is found; else depth is only some number of steps.
    """
    jump, steps = materialise(edges.distinct(), "jumps"), 1
    known = jump.select("a", "b", F.lit(1).cast("long").alias("depth"))
    while True:
        if acyclic and not known.where("a = b").isEmpty():
            raise ValueError("courses wait for each other: there is a cycle")
        before = known.count()
        # A round gives up to twice the pairs, from as many again.
        with spread(edges.sparkSession, 4 * before):
            jump, steps = doubled(jump), 2 * steps
            if jump.isEmpty():
                return known
            onward = known.select(F.col("a").alias("b"), F.col("b").alias("c"), "depth")
            longer = jump.join(onward, "b").select("a", F.col("c").alias("b"), (F.col("depth") + steps).alias("depth"))
            new = known.unionAll(jump.select("a", "b", F.lit(steps).cast("long").alias("depth"))).unionAll(longer)
            known = materialise(new.groupBy("a", "b").agg(F.max("depth").alias("depth")), "walks")
        if not acyclic and known.count() == before:
            return known


def chains(prerequisite: DataFrame) -> DataFrame:
    """course_id, ancestor_id and the most steps between them, for every course with prerequisites; a cycle is an error."""
    found = walks(prerequisite.where("course_id IS NOT NULL AND prerequisite_id IS NOT NULL").select(F.col("course_id").alias("a"), F.col("prerequisite_id").alias("b")), acyclic=True)
    return found.select(F.col("a").alias("course_id"), F.col("b").alias("ancestor_id"), F.col("depth").cast("int").alias("depth"))


def expanded(roots: DataFrame, prerequisite: DataFrame, blocked: DataFrame) -> DataFrame:
    """employee_id, course_id and kept of all courses reached from the roots. Blocked pairs are reached but not passed.

    One round for each step away from the roots; what is reached is written before the next round.
    """
    stop = blocked.select("employee_id", "course_id").distinct().withColumn("stop", F.lit(True))
    new = materialise(roots.select("employee_id", "course_id").distinct().join(stop, ["employee_id", "course_id"], "left").withColumn("kept", F.col("stop").isNull()).drop("stop"), "reached")
    rounds = [new]
    while not new.isEmpty():
        seen = reduce(DataFrame.unionAll, rounds)
        step = new.where("kept").join(prerequisite, "course_id").select("employee_id", F.col("prerequisite_id").alias("course_id")).distinct()
        step = step.join(seen, ["employee_id", "course_id"], "left_anti").join(stop, ["employee_id", "course_id"], "left")
        new = materialise(step.withColumn("kept", F.col("stop").isNull()).drop("stop"), "reached")
        rounds.append(new)
    return reduce(DataFrame.unionAll, rounds)


def mastered(levels: DataFrame, course: DataFrame) -> DataFrame:
    """(employee_id, course_id) of courses whose skills the employee has, by the level that the difficulty asks for."""
    least: Column = F.coalesce(*[F.when(F.col("difficulty") == k, v) for k, v in MASTERED.items()])
    return levels.join(course, "course_id").where(F.col("avg_level") + 1e-9 >= least).select("employee_id", "course_id")


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """label and n for each table of nodes or edges."""
    return reduce(DataFrame.unionAll, [t.select(F.lit(k).alias("label")).groupBy("label").agg(F.count("*").alias("n")) for k, t in tables.items()])


def dangling(edges: DataFrame, key: str, nodes: DataFrame, node_key: str, kind: str) -> DataFrame:
    """Edges whose end is no node, as error rows."""
    known = nodes.select(F.col(node_key).alias("known")).distinct()
    return edges.join(known, F.col(key) == F.col("known"), "left_anti").groupBy(F.col(key).cast("string").alias("id")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "id", "n")


def tangled(edges: DataFrame) -> DataFrame:
    """Edges without many of those that lead to or from dead ends only; all edges of cycles are left."""
    left = materialise(edges.where("course_id IS NOT NULL AND prerequisite_id IS NOT NULL").select("course_id", "prerequisite_id").distinct(), "edges")
    while True:
        waiting, behind = left.select(F.col("course_id").alias("prerequisite_id")).distinct(), left.select(F.col("prerequisite_id").alias("course_id")).distinct()
        new = materialise(left.join(waiting, "prerequisite_id", "left_semi").join(behind, "course_id", "left_semi").select("course_id", "prerequisite_id"), "edges")
        if (left.count() - new.count()) * PEEL < left.count() or new.isEmpty():
            return new
        left = new


def smallest_sources(edge: DataFrame) -> DataFrame | None:
    """node and label (the smallest node that leads to it, or itself) of all ends of edges (a, b); None beyond MOST_ROUNDS steps."""
    label = materialise(edge.select(F.col("a").alias("node")).union(edge.select(F.col("b").alias("node"))).distinct().withColumn("label", F.col("node")), "labels")
    new = label
    for _ in range(MOST_ROUNDS):
        lower = edge.join(new.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("lower"))
        new = materialise(lower.join(label, "node").where("lower < label").select("node", F.col("lower").alias("label")), "labels")
        if new.isEmpty():
            return label
        label = materialise(label.join(new.withColumnRenamed("label", "lower"), "node", "left").select("node", F.coalesce("lower", "label").alias("label")), "labels")
    return None


def leading_back(edge: DataFrame) -> DataFrame | None:
    """node and label of what leads to its label's node by edges (a, b, label) of that label, with that node; None beyond MOST_ROUNDS steps."""
    new = materialise(edge.where("b = label").select(F.col("a").alias("node"), "label").distinct(), "leading-back")
    known = new.unionAll(new.select(F.col("label").alias("node"), "label").distinct())
    for _ in range(MOST_ROUNDS):
        more = edge.join(new.select(F.col("node").alias("b")), "b").select(F.col("a").alias("node"), "label").distinct()
        new = materialise(more.join(known, "node", "left_anti"), "leading-back")
        if new.isEmpty():
            return materialise(known.distinct(), "on-cycles")
        known = known.unionAll(new)
    return None


def on_cycles(prerequisite: DataFrame) -> DataFrame:
    """course_id of the courses that lead back to themselves, among those that peeling leaves.

    Edges from a course to itself are no part of longer cycles; without them more is peeled. Courses on a cycle have the same
    smallest course that leads to them, so edges between others are cut; what leads back to that course is on a cycle with it.
    The rest is peeled and searched anew. Only graphs with ways of more than MOST_ROUNDS steps are searched by walks.
    """
    found = [materialise(prerequisite.where("course_id = prerequisite_id").select("course_id").distinct(), "own-cycles")]
    edge = tangled(prerequisite.where("course_id <> prerequisite_id")).select(F.col("course_id").alias("a"), F.col("prerequisite_id").alias("b"))
    while (n := edge.count()) > 0:
        with spread(edge.sparkSession, n):
            label, back = smallest_sources(edge), None
            if label is not None:
                own, other = label.withColumnRenamed("node", "a"), label.select(F.col("node").alias("b"), F.col("label").alias("other"))
                edge = materialise(edge.join(own, "a").join(other, "b").where("label = other").select("a", "b", "label"), "edges")
                back = leading_back(edge)
            if back is None:
                found.append(walks(edge.select("a", "b"), acyclic=False).where("a = b").select(F.col("a").alias("course_id")))
                break
            found.append(back.select(F.col("node").alias("course_id")))
            left = edge.join(back.select(F.col("node").alias("a")), "a", "left_anti").join(back.select(F.col("node").alias("b")), "b", "left_anti")
            edge = tangled(left.select(F.col("a").alias("course_id"), F.col("b").alias("prerequisite_id"))).select(F.col("course_id").alias("a"), F.col("prerequisite_id").alias("b"))
    return reduce(DataFrame.unionAll, found).distinct()


def cycle_paths(prerequisite: DataFrame) -> DataFrame:
    """course_id and path of a shortest cycle through each course that is the smallest of such a one; path begins and ends with it."""
    edge = tangled(prerequisite)
    step = edge.select(F.col("course_id").alias("node"), F.col("prerequisite_id").alias("next"))
    new = edge.where("prerequisite_id >= course_id").select("course_id", F.col("prerequisite_id").alias("node"), F.array("course_id", "prerequisite_id").alias("path"))
    rounds = [materialise(new, "paths")]
    while not rounds[-1].isEmpty():
        seen = reduce(DataFrame.unionAll, [r.select("course_id", "node") for r in rounds])
        longer = rounds[-1].where("node <> course_id").join(step, "node").where("next >= course_id")
        longer = longer.select("course_id", F.col("next").alias("node"), F.array_append("path", F.col("next")).alias("path")).groupBy("course_id", "node").agg(F.min("path").alias("path"))
        rounds.append(materialise(longer.join(seen, ["course_id", "node"], "left_anti"), "paths"))
    return reduce(DataFrame.unionAll, rounds).where("course_id = node").select("course_id", "path")


def closure(roots: DataFrame, prerequisite: DataFrame) -> DataFrame:
    """course_id of the roots and of everything they lead to."""
    jump = materialise(prerequisite.where("course_id IS NOT NULL AND prerequisite_id IS NOT NULL").select(F.col("course_id").alias("a"), F.col("prerequisite_id").alias("b")).distinct(), "jumps")
    known = materialise(roots.select("course_id").distinct(), "closure")
    n = known.count()
    while True:
        # So far all within 2**k - 1 steps; no new one within twice as many means that there is none at all.
        onward = known.select(F.col("course_id").alias("a")).join(jump, "a").select(F.col("b").alias("course_id"))
        known = materialise(known.unionAll(onward).distinct(), "closure")
        if (more := known.count()) == n:
            return known
        n, jump = more, doubled(jump)


def with_lists(courses: DataFrame, teaches: DataFrame, prerequisite: DataFrame) -> DataFrame:
    """The courses with skills and prerequisites as sorted lists; empty without any."""
    out = courses
    for edges, key, name in ((teaches, "skill_id", "skills"), (prerequisite, "prerequisite_id", "prerequisites")):
        lists = edges.groupBy("course_id").agg(F.array_sort(F.collect_set(key)).alias(name))
        out = out.join(lists, "course_id", "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return out


def with_priority(courses: DataFrame, teaches: DataFrame, gaps: DataFrame) -> DataFrame:
    """employee_id, course_id and priority: the weighted gaps that the course's skills cover together."""
    rows = courses.join(teaches, "course_id", "left").join(gaps.select("employee_id", "skill_id", "weighted_gap"), ["employee_id", "skill_id"], "left")
    return rows.groupBy("employee_id", "course_id").agg(F.coalesce(F.sum("weighted_gap"), F.lit(0)).alias("priority"))


def topological(kept: DataFrame, prerequisite: DataFrame, priority: DataFrame) -> DataFrame:
    """employee_id, course_id and position: prerequisites first, then higher priority, then smaller course_id.

    An employee's kept courses are at most the catalogue, so one group is one small task.
    """
    import pandas as pd

    open_edges = kept.join(prerequisite, "course_id").select("employee_id", "course_id", F.col("prerequisite_id"))
    inner = open_edges.join(kept.select("employee_id", F.col("course_id").alias("prerequisite_id")), ["employee_id", "prerequisite_id"], "left_semi")
    waits = inner.groupBy("employee_id", "course_id").agg(F.collect_set("prerequisite_id").alias("before"))
    rows = kept.join(waits, ["employee_id", "course_id"], "left").join(priority, ["employee_id", "course_id"], "left").select("employee_id", "course_id", "before", F.coalesce(F.col("priority").cast("double"), F.lit(0.0)).alias("priority"))

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        import heapq

        waiting = {c: set(b) if b is not None else set() for c, b in zip(pdf.course_id, pdf.before, strict=True)}
        weight = dict(zip(pdf.course_id, pdf.priority, strict=True))
        behind: dict[int, list[int]] = {}
        for c, b in waiting.items():
            for p in b:
                behind.setdefault(p, []).append(c)
        ready = [(-weight[c], c) for c, b in waiting.items() if not b]
        heapq.heapify(ready)
        done = []
        while ready:
            _, c = heapq.heappop(ready)
            done.append(c)
            for d in behind.get(c, []):
                waiting[d].discard(c)
                if not waiting[d]:
                    heapq.heappush(ready, (-weight[d], d))
        if len(done) < len(waiting):
            raise ValueError(f"courses of employee {pdf.employee_id.iloc[0]} wait for each other: {sorted(set(waiting) - set(done))}")
        return pd.DataFrame({"employee_id": pdf.employee_id.iloc[0], "course_id": done, "position": range(1, len(done) + 1)})

    return rows.groupBy("employee_id").applyInPandas(order, "employee_id long, course_id long, position int")


def packed(ordered: DataFrame, hours_per_week: float) -> DataFrame:
    """employee_id, week, position, course_id, minutes and continued: courses dealt to weeks in order.

    A course that doesn't fit moves to the next week; one longer than a week goes on in the following ones. `ordered` has
    employee_id, position, course_id and duration_minutes.
    """
    if hours_per_week <= 0:
        raise ValueError(f"hours_per_week must be above 0: {hours_per_week}")
    budget = hours_per_week * 60.0
    import pandas as pd

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        out, week, used = [], 1, 0.0
        pdf = pdf.sort_values(["position", "course_id"])
        for position, course_id, minutes in zip(pdf.position, pdf.course_id, pdf.minutes, strict=True):
            if used > 1e-9 and used + minutes > budget + 1e-9:
                week, used = week + 1, 0.0
            # A course that begins in a fresh week may take several; one that doesn't always fits.
            parts = max(1, ceil((minutes - 1e-9) / budget))
            out += [(week + k, position, course_id, min(budget, minutes - k * budget), k > 0) for k in range(parts)]
            week, used = week + parts - 1, minutes - (parts - 1) * budget if parts > 1 else used + minutes
        return pd.DataFrame(out, columns=["week", "position", "course_id", "minutes", "continued"]).assign(employee_id=pdf.employee_id.iloc[0])

    rows = ordered.select("employee_id", "position", "course_id", F.col("duration_minutes").cast("double").alias("minutes"))
    return rows.groupBy("employee_id").applyInPandas(place, "employee_id long, week int, position int, course_id long, minutes double, continued boolean")


def path_totals(plan: DataFrame, deadline_weeks: int) -> DataFrame:
    return plan.groupBy("employee_id").agg(F.count_distinct("course_id").alias("course_count"), F.max("week").alias("planned_weeks"), F.sum("minutes").alias("total_minutes"), (F.max("week") <= deadline_weeks).alias("fits_deadline"))


def next_course(plan: DataFrame, done: DataFrame) -> DataFrame:
    """The first course of every plan that isn't done."""
    left = plan.join(done, ["employee_id", "course_id"], "left_anti")
    return left.withColumn("n", F.row_number().over(Window.partitionBy("employee_id").orderBy("position"))).where("n = 1").select("employee_id", "course_id")
