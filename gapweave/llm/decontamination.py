"""Benchmark decontamination: short test items found inside long documents by MinHash containment search.

Texts are sets of runs of five words; an item of one to four words is one run of all its words. An item is contained in a
document that has a share of at least `threshold` of the item's shingles. Items are partitioned in classes of size, each
twice as large as the one before. The MinHash sketch of an item of n shingles is its smallest hashes: of n shingles at most
n - ceil(threshold * n) may be missing, and the sketch has HITS more than may be missing. The largest hash in any sketch of
a class bounds the class, and a document's sketch for the class is all its hashes up to that bound, so the two sketches
estimate the containment: the share of the item's sketch that the document's has. A pair goes on if the sketch misses no
more than may be missing; no pair at the threshold is lost, and one shared passing phrase is not enough. A document's
sketches are nested, so the widest is searched and holds the others. Only documents that are candidates are read again, and
each candidate pair is verified by counting all shared shingles. (Banded signatures of whole documents lose such pairs: the
Jaccard similarity of 30 shingles and a document of 10,000 is 0.003, for which even 256 bands of one value miss half.)

Everything is DataFrame functions. Shingles are compared by 64-bit hashes of the hashes of their words. Documents are
never shuffled as long as sketches and candidates are few enough to broadcast, which is counted first; beyond that Spark
joins by hash.

Null and empty texts have no shingles: such items are never found, such documents contain nothing. Rows of equal doc_id
are one document with the shingles of all; rows of equal item_id likewise (their sizes are added up). Null ids match as
one id. Empty tables give no rows. Other columns, whatever their names, are not read by contained() and come through
drop_contaminated() untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapweave.llm.common import SHINGLE_WORDS, SIMILARITY, fresh, materialise, words

#: Sketches, candidates and ids of documents to drop are broadcast up to so many bytes, at ROW_BYTES each.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 64
#: Hashes that a sketch has beyond those that may be missing, and so the least number that a candidate shares.
HITS = 2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs_of(hashes: Column, size: int) -> Column:
    """The hashes of all runs of `size` of an array's word hashes; none if it has fewer."""
    run = F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))
    return F.when(F.size(hashes) >= size, run).otherwise(F.array().cast("array<bigint>"))


def shingles(text: Column, sizes: list[int]) -> Column:
    """The distinct hashes of all runs of so many words, of each of the sizes."""
    return let(F.transform(words(text), lambda x: F.xxhash64(x)), lambda w: F.array_distinct(F.concat(*[runs_of(w, n) for n in sizes])))


def item_shingles(items: DataFrame, item_id: str, text: str, threshold: float) -> DataFrame:
    """item_id, h, n (shingles of the item), words (its length in words), size_class, in_sketch and hits (how many of its sketch a candidate needs)."""
    hashes = F.transform(words(F.col(text)), lambda x: F.xxhash64(x))
    each = items.select(F.col(item_id).alias("item_id"), F.explode(F.array(hashes)).alias("w")).where(F.size("w") > 0)
    by_size = F.coalesce(*[F.when(F.size("w") == n, runs_of(F.col("w"), n)) for n in range(1, SHINGLE_WORDS)], runs_of(F.col("w"), SHINGLE_WORDS))
    each = each.select("item_id", F.least(F.size("w"), F.lit(SHINGLE_WORDS)).alias("words"), F.explode(by_size).alias("h")).distinct()
    of_item = Window.partitionBy("item_id")
    sized = each.withColumn("n", F.count("*").over(of_item)).withColumn("k", F.row_number().over(of_item.orderBy("h", "words")))
    missing = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9)
    length = F.least(F.col("n"), missing + HITS)
    return sized.withColumns({"size_class": F.floor(F.log2("n")).cast("int"), "in_sketch": F.col("k") <= length, "hits": length - missing}).drop("k")


def bounds(wanted: DataFrame) -> dict[int, int]:
    """The largest sketched hash of each class of size: one entry for each power of two, 63 at most."""
    return {r["size_class"]: r["bound"] for r in wanted.where("in_sketch").groupBy("size_class").agg(F.max("h").alias("bound")).collect()}


def small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its rows are few."""
    return F.broadcast(df) if df.count() * ROW_BYTES <= BROADCAST_BYTES else df


def contained(docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, shared, shingles and containment of every document and the items that it contains."""
    wanted = materialise(item_shingles(items, item_id, item_text, threshold), "item-shingles")
    sizes = sorted(r["words"] for r in wanted.select("words").distinct().collect()) or [SHINGLE_WORDS]  # five values at most
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"))
    sketches = small(wanted.where("in_sketch").select("item_id", "h", "hits"))
    widest = max(bounds(wanted).values(), default=0)
    sketched = docs.select("doc_id", F.explode(F.filter(shingles(F.col("text"), sizes), lambda h: h <= widest)).alias("h"))
    shares = sketched.join(sketches, "h").groupBy("doc_id", "item_id").agg(F.count("*").alias("both"), F.first("hits").alias("hits"))
    pairs = materialise(shares.where("both >= hits").select("doc_id", "item_id"), "contamination-candidates")
    whole = wanted.groupBy("item_id").agg(F.first("n").alias("n"), F.collect_list("h").alias("item"))
    asked = pairs.join(whole, pairs["item_id"].eqNullSafe(whole["item_id"])).select(pairs["doc_id"].alias("asked_id"), pairs["item_id"], "n", "item")
    ids = small(materialise(pairs.select(F.col("doc_id").alias("asked_id")).distinct(), "contamination-documents"))
    again = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("asked_id")), "left_semi").select("doc_id", shingles(F.col("text"), sizes).alias("own"))
    found = again.join(asked, F.col("doc_id").eqNullSafe(F.col("asked_id"))).select("doc_id", "item_id", "n", F.array_intersect("own", "item").alias("hits"))
    # One row of a document usually decides; rows of equal doc_id put theirs together.
    shared = found.groupBy("doc_id", "item_id").agg(F.max("n").alias("shingles"), F.size(F.array_distinct(F.flatten(F.collect_set("hits")))).cast("long").alias("shared"))
    verified = shared.withColumn("containment", F.col("shared") / F.col("shingles")).where(F.col("containment") >= threshold)
    return verified.select("doc_id", "item_id", "shared", "shingles", "containment")


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that contain no item; rows with a null id are compared like others."""
    name = fresh(docs, "gw_found")
    found = small(materialise(contained(docs, items, threshold, doc_id, text).select(F.col("doc_id").alias(name)).distinct(), "contaminated"))
    return docs.join(found, docs[doc_id].eqNullSafe(found[name]), "left_anti")


def shingle_sql(table: str, key: str, sizes: str) -> str:
    """DuckDB SQL for the distinct shingles of a table as columns of key, size and g; `sizes` is SQL for a list of run lengths."""
    w = rf"[x FOR x IN string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+') IF x <> '']"
    return f"""SELECT DISTINCT {key}, size, unnest([w[i : i + size - 1] FOR i IN range(1, len(w) - size + 2)]) AS g FROM (SELECT {key}, w, unnest({sizes}) AS size FROM (SELECT {key}, {w} AS w FROM {table})) WHERE len(w) >= size"""


SQL = f"""
WITH i AS ({shingle_sql("benchmark", "item_id", "[greatest(1, least(5, len(w)))]")}),
l AS (SELECT list(DISTINCT size) AS ls FROM i),
d AS ({shingle_sql("documents", "doc_id", "(SELECT ls FROM l)")}),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
s AS (SELECT doc_id, item_id, count(*) AS shared FROM i JOIN d USING (size, g) GROUP BY ALL)
SELECT doc_id, item_id, shared, n AS shingles, shared / n AS containment FROM s JOIN n USING (item_id) WHERE shared / n >= {SIMILARITY}
"""
