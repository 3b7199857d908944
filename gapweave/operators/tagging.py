"""Tagging of texts from a table of aliases of any size.

A text has a name if it holds one of the name's aliases, in any case and anywhere. Every alias is found by its anchor: the
GRAM characters of it that the fewest texts hold (aliases shorter than that: all their characters). Texts meet aliases by an
equi-join on anchors, and each meeting is checked once at its place; only meetings are shuffled, texts are joined with what
they met once. A dictionary whose runs of characters are few, which is counted first, is broadcast instead: every text is
then read twice where it lies, once to count the runs and once to look its anchors up, and no run becomes a row.

Null and empty aliases are left out, repeated ones count once; null texts have no names. Rows of equal keys are texts of
their own. Names come in the order of their first place in the text, then by themselves. Other columns of `texts` are kept.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapweave.sources.scratch import materialise

GRAM = 3
#: Anchors are broadcast up to so many bytes, at so many for each.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 200
#: Bytes of texts that a task counts at once, about.
BATCH_BYTES = 8 << 20


def grams(text: Column, size: int = GRAM) -> Column:
    """The distinct runs of `size` characters."""
    # The characters are cut out once: a place in a text is found by counting from its begin.
    runs = F.transform(F.array(F.split(text, "")), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - size), lambda i: F.concat(*[F.get(c, i + k) for k in range(size)])))
    return F.when(F.char_length(text) >= size, F.array_distinct(F.get(runs, F.lit(0)))).otherwise(F.array().cast("array<string>"))


def own_grams(alias: Column) -> Column:
    return F.when(F.char_length(alias) <= GRAM, F.array(alias)).otherwise(grams(alias))


def text_grams(text: Column, sizes: list[int]) -> Column:
    return F.concat(*[grams(text, n) for n in sizes])


def runs_of(text: str, sizes: list[int]) -> set[str]:
    return {text[i : i + n] for n in sizes for i in range(len(text) - n + 1)}


def counted(texts: DataFrame, lower: Column, sizes: list[int], wanted: DataFrame) -> DataFrame:
    """gram and the number of texts that hold it, of wanted grams that any holds; these are broadcast."""
    conf, key = texts.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(key).lower().rstrip("b")) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    few = texts.sparkSession.sparkContext.broadcast(frozenset(r.gram for r in wanted.collect()))

    def count(batches):
        n = Counter()
        for batch in batches:
            for text in batch.column(0):
                n.update(few.value & runs_of(text.as_py(), sizes))
        yield pa.record_batch([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["gram", "texts"])

    return texts.select(lower.alias("text")).mapInArrow(count, "gram string, texts long").groupBy("gram").agg(F.sum("texts").alias("texts"))


def looked_up(lower: Column, sizes: list[int], anchors: DataFrame, known: DataFrame) -> Column:
    """The names of texts, by broadcast anchors (gram, alias) and aliases (alias, name)."""
    of: dict[str, list[tuple[str, list[str]]]] = {}
    for r in anchors.join(known.groupBy("alias").agg(F.collect_list("name").alias("names")), "alias").collect():
        of.setdefault(r.gram, []).append((r.alias, r.names))
    held = anchors.sparkSession.sparkContext.broadcast(of)

    def names(text):
        places: dict[str, int] = {}
        for gram in held.value.keys() & runs_of(text, sizes):
            for alias, own in held.value[gram]:
                if (at := text.find(alias)) >= 0:
                    for name in own:
                        places[name] = min(at, places.get(name, at))
        return sorted(places, key=lambda name: (places[name], name))

    return F.udf(names, "array<string>")(lower)


def tagged(texts: DataFrame, text: str, dictionary: DataFrame, name: str = "names") -> DataFrame:
    """The rows of `texts` with an array of the names that `dictionary` (alias, name) gives them."""
    known = materialise(dictionary.select(F.lower("alias").alias("alias"), "name").where("alias <> '' AND name IS NOT NULL").distinct(), "dictionary")
    pieces = materialise(known.select("alias").distinct().select("alias", F.explode(own_grams(F.col("alias"))).alias("gram")), "alias-grams")
    sizes = sorted(r["n"] for r in pieces.select(F.char_length("gram").alias("n")).distinct().collect()) or [GRAM]  # GRAM values at most
    wanted = pieces.select("gram").distinct()
    small = max(wanted.count(), known.count()) * ROW_BYTES <= BROADCAST_BYTES
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    if small:
        held = counted(texts, lower, sizes, wanted)
    else:
        held = texts.select(F.explode(text_grams(lower, sizes)).alias("gram")).join(wanted, "gram").groupBy("gram").agg(F.count("*").alias("texts"))
    rarest = Window.partitionBy("alias").orderBy("texts", "gram")
    anchors = pieces.join(held, "gram", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    anchors = materialise(anchors.withColumn("n", F.row_number().over(rarest)).where("n = 1 AND texts > 0").select("gram", "alias"), "anchors")
    if small:
        return texts.select("*", looked_up(lower, sizes, anchors, known).alias(name))
    few = anchors.count() * ROW_BYTES <= BROADCAST_BYTES
    # A text's digest stands for it until its meetings are known; equal texts meet the same aliases.
    print_ = F.sha2(lower, 256)
    met = texts.select(print_.alias("gw_print"), F.explode(text_grams(lower, sizes)).alias("gram")).join(F.broadcast(anchors) if few else anchors, "gram")
    met = met.select("gw_print", "alias").distinct().join(known, "alias").groupBy("gw_print").agg(F.collect_list(F.struct("alias", "name")).alias("gw_met"))
    both = texts.withColumn("gw_print", print_).join(met, "gw_print", "left")
    places = F.filter(F.transform("gw_met", lambda m: F.struct(F.position(m["alias"], lower).alias("place"), m["name"].alias("name"))), lambda p: p.place > 0)
    names = F.array_distinct(F.transform(F.array_sort(places), lambda p: p["name"]))
    return both.select(*[texts[c] for c in texts.columns], F.coalesce(names, F.array().cast("array<string>")).alias(name))
