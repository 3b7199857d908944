"""Names as people write them mapped to skills: by alias, else by the most similar label.

A library is a table of skill_id and label (names and aliases alike). Names and labels are compared in their normalised
form; null names and names that normalise to nothing are matched by nothing. Of several skills that claim a label the last
in order of skill_id has it, as alias_conflicts() reports. Equal scores go to the skill_id that sorts first. Repeated
names count once each in the mapping and in its summary. Empty tables give empty results (the summary: one row of zeros).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapweave.functions.text import normalized
from gapweave.operators.retrieval import lexical_vectors
from gapweave.sources.scratch import materialise

#: Least similarity of a candidate, and the one from which no verdict is asked for.
CANDIDATE, CERTAIN = 0.6, 0.9


def alias_index(labels: DataFrame) -> DataFrame:
    """alias (normalised) and the skill that it stands for."""
    return labels.select(normalized(F.col("label")).alias("alias"), "skill_id").where("alias <> ''").groupBy("alias").agg(F.max("skill_id").alias("skill_id"))


def alias_conflicts(labels: DataFrame) -> DataFrame:
    """Normalised labels that several skills claim."""
    claims = labels.select(normalized(F.col("label")).alias("alias"), "skill_id").where("alias <> ''").groupBy("alias").agg(F.array_sort(F.collect_set("skill_id")).alias("skills"))
    return claims.where(F.size("skills") > 1)


def by_alias(names: DataFrame, index: DataFrame, name: str = "raw") -> DataFrame:
    """The names with the skill whose alias they are; null without."""
    asked = names.select(name, normalized(F.col(name)).alias("alias"))
    return asked.join(index, "alias", "left").select(name, "skill_id")


def unmatched(names: DataFrame, index: DataFrame, name: str = "raw") -> DataFrame:
    """raw and text (normalised) of the names that are no alias."""
    return names.select(F.col(name).alias("raw"), normalized(F.col(name)).alias("text")).where("text <> ''").join(index, F.col("text") == F.col("alias"), "left_anti")


def candidates(open_names: DataFrame, labels: DataFrame, k: int = 3, threshold: float = CANDIDATE) -> DataFrame:
    """raw, skill_id, score and place of the k skills with the most similar label, from a similarity of `threshold` on.

    Lexical vectors are compared; a name meets the labels that share a hashed feature with it, by dimension.
    """
    lib = labels.select("skill_id", normalized(F.col("label")).alias("text")).where("text <> ''").distinct()
    vectors = lexical_vectors(lib.select("text").distinct().withColumnRenamed("text", "norm").withColumn("text", F.col("norm")), "norm", "text")
    asked = materialise(lexical_vectors(open_names.select("raw", "text").distinct(), "raw", "text"), "name-vectors")
    sims = asked.join(vectors.select("norm", "dim", F.col("value").alias("other")), "dim").groupBy("raw", "norm").agg(F.sum(F.col("value") * F.col("other")).alias("s"))
    best = sims.where(F.col("s") >= threshold - 1e-9).join(lib.withColumnRenamed("text", "norm"), "norm").groupBy("raw", "skill_id").agg(F.round(F.max("s"), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("raw").orderBy(F.desc("score"), "skill_id"))
    return best.withColumn("place", place).where(F.col("place") <= k)


def cascade(names: DataFrame, labels: DataFrame, name: str = "raw", verdict: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """raw, normalized, skill_id, method (alias, embedding or verdict) and score of every name.

    `verdict` (of the raw name and the list of its candidates, structs of skill_id and score) gives the chosen skill_id or
    '' to refuse all of them; null leaves the decision to the best candidate. It is asked below CERTAIN only.
    """
    index = materialise(alias_index(labels), "aliases")
    near = candidates(unmatched(names, index, name), labels).groupBy("raw").agg(F.array_sort(F.collect_list(F.struct("place", "skill_id", "score"))).alias("near"))
    rows = names.select(F.col(name).alias("raw"), normalized(F.col(name)).alias("normalized")).join(index.withColumnRenamed("skill_id", "known"), F.col("normalized") == F.col("alias"), "left").join(near, "raw", "left")
    top = F.get("near", F.lit(0))
    asked = F.when(top.score < CERTAIN, verdict(F.col("raw"), F.col("near"))) if verdict else F.lit(None).cast("string")
    rows = rows.withColumn("said", asked)
    chosen = F.coalesce(F.get(F.filter("near", lambda x: x.skill_id == F.col("said")), F.lit(0)), top)
    refused = F.coalesce(F.col("said") == "", F.lit(False))
    is_alias = F.col("known").isNotNull()
    return rows.select(
        "raw",
        F.coalesce("normalized", F.lit("")).alias("normalized"),
        F.when(is_alias, F.col("known")).when(~refused, chosen.skill_id).alias("skill_id"),
        F.when(is_alias, "alias").when(refused | top.isNull(), None).when(F.col("said").isNotNull(), "verdict").otherwise("embedding").alias("method"),
        F.when(is_alias, 1.0).when(~refused, chosen.score).alias("score"),
    )


def summary(mapped: DataFrame) -> DataFrame:
    """kind, name, n and share of a mapping: a row for all names (total) and for those with a skill (matched), one for each
    skill, and one for each name without (unmatched). share is of all names, half-even to four places."""
    total = mapped.agg(F.count("*").alias("all"), F.count("skill_id").alias("found"))
    both = total.select("all", F.inline(F.array(F.struct(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("name"), F.col("all").alias("n")), F.struct(F.lit("matched").alias("kind"), F.lit(None).cast("string").alias("name"), F.col("found").alias("n")))))
    kind = F.when(F.col("skill_id").isNull(), "unmatched").otherwise("skill")
    each = mapped.groupBy(kind.alias("kind"), F.coalesce("skill_id", "raw").alias("name")).agg(F.count("*").alias("n"))
    # One row is joined to all.
    rows = both.select("kind", "name", "n").unionAll(each.select("kind", "name", "n")).join(F.broadcast(total.select("all")))
    return rows.select("kind", "name", "n", F.when(F.col("all") > 0, F.bround(F.col("n") / F.col("all"), 4)).otherwise(0.0).alias("share"))
