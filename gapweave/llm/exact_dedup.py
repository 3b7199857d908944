"""Exact deduplication by content-defined chunk recipes.

A text's bytes are cut where a rolling hash of the last 32 bytes says so, so that equal texts are cut alike. A text's
recipe is the ordered list of the 128-bit identifiers of its chunks. Before recipes are compared, identifiers are
verified: for every identifier, the smallest and the largest of its chunks must be the same bytes, which is one
aggregation with partial results in each task, so a chunk of a third of all texts leaves each task once. Should an
identifier stand for two different chunks, all recipes are made anew with another seed. After that only recipes are
compared and joined; long texts don't move again.

A text whose 64-bit print is unique equals no other, so its chunks need no verification. The prints that occur twice are
broadcast if they are few, which is counted first; beyond that all chunks are verified. Prints are part of the compared
key, hence an unverified recipe never meets another. Groups of over a thousandth of all rows (a thousand at most) are
joined by broadcast, all others by their key.

Null counts as the empty text, whose recipe is empty. Texts of any length are cut in slabs of bounded size. Of rows that
repeat doc_id and text one is kept. A null doc_id is smaller than all others; a group of null ids has keep_id null. An
empty table gives no rows. Other columns, whatever their names, are not read by assigned() and come through keep_last()
untouched.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.llm.common import binary_view, bounded_batches, fresh, materialise, release

#: Bytes of a chunk: at least (more than the rolling window), on average besides, at most.
LEAST, SPARE_BITS, MOST = 1_024, 12, 16_384
#: Bytes whose rolling hash is worked out together.
SLAB = 1 << 20
#: Prints are broadcast up to so many bytes, at ROW_BYTES each.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 32
#: Seeds that are tried before giving up: with 128 bits the second is never needed.
SEEDS = 4

_GEAR = np.random.default_rng(20031).integers(0, 1 << 32, 256, dtype=np.uint32)


def candidates(data: np.ndarray) -> np.ndarray:
    """The places behind which the rolling hash of the last 32 bytes allows a cut."""
    found = []
    for a in range(0, len(data), SLAB):
        first = max(0, a - 31)
        h = _GEAR[data[first : a + SLAB]]
        for width in (1, 2, 4, 8, 16):  # the hash of 2 * width bytes from two hashes of width bytes
            wider = h.copy()
            wider[width:] += h[:-width] << np.uint32(width)
            h = wider
        at = np.flatnonzero(h >> np.uint32(32 - SPARE_BITS) == 0) + first + 1
        found.append(at[at > a])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def cuts(data: np.ndarray, begins: np.ndarray, least: int = LEAST, most: int = MOST) -> list[list[int]]:
    """For each text data[begins[k]:begins[k + 1]] the ends of its chunks, which depend on its own bytes only."""
    places = candidates(data).tolist()
    out = []
    for at, end in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        ends = []
        while at < end:
            k = bisect_left(places, at + least)
            at = min(places[k] if k < len(places) else end, at + most, end)
            ends.append(at)
        out.append(ends)
    return out


def chunks(texts: pa.Array):
    """For each text (binary, without nulls) the list of its chunks."""
    data, begins = binary_view(texts, np.uint8)
    raw = memoryview(data)
    for begin, ends in zip(begins[:-1].tolist(), cuts(data, begins), strict=True):
        yield [raw[a:b] for a, b in zip([begin, *ends][: len(ends)], ends, strict=True)]


def identifier(chunk: memoryview, seed: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk, seed)


def text_print(text: Column) -> Column:
    """Equal for equal texts; only spares verification to texts that have it for themselves."""
    return F.xxhash64(text)


def recipes(texts: DataFrame, seed: int, name: Callable[[memoryview, int], bytes]) -> DataFrame:
    """doc_id, text_sha256, print and recipe (16 bytes a chunk) of every row of doc_id and text."""

    def cook(batches):
        for batch in batches:
            listed = [b"".join(name(c, seed) for c in own) for own in chunks(batch.column(3))]
            yield pa.record_batch([*batch.columns[:3], pa.array(listed, pa.binary())], names=["doc_id", "text_sha256", "print", "recipe"])
        release()

    read = texts.select("doc_id", F.sha2("text", 256).alias("text_sha256"), text_print(F.col("text")).alias("print"), F.col("text").cast("binary").alias("text"))
    return bounded_batches(read).mapInArrow(cook, "doc_id long, text_sha256 string, print long, recipe binary")


def clashes(texts: DataFrame, prints: DataFrame | None, seed: int, name: Callable[[memoryview, int], bytes]) -> DataFrame:
    """The identifiers that stand for more than one chunk of the texts with one of the prints (None: of all texts)."""

    def store(batches):
        for batch in batches:
            seen: dict[bytes, list[memoryview]] = {}
            for own in chunks(batch.column(0)):
                for chunk in own:
                    known = seen.setdefault(name(chunk, seed), [])
                    if chunk not in known:
                        known.append(chunk)
            pairs = [(i, c) for i, known in seen.items() for c in known]
            yield pa.record_batch([pa.array([i for i, _ in pairs], pa.binary()), pa.array([c for _, c in pairs], pa.binary())], names=["id", "chunk"])
        release()

    if prints is not None:
        texts = texts.join(F.broadcast(prints), text_print(F.col("text")) == F.col("print"), "left_semi")
    stored = bounded_batches(texts).select(F.col("text").cast("binary").alias("text")).mapInArrow(store, "id binary, chunk binary")
    return stored.groupBy("id").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a <> b").select("id")


def verified(texts: DataFrame, name: Callable[[memoryview, int], bytes]) -> DataFrame:
    """Recipes in which equal identifiers are equal chunks, wherever a print occurs twice."""
    for seed in range(SEEDS):
        made = materialise(recipes(texts, seed, name), "recipes")
        twice = materialise(made.groupBy("print").count().where("count > 1").select("print"), "repeated-prints")
        few = twice.count() * ROW_BYTES <= BROADCAST_BYTES
        if clashes(texts, twice if few else None, seed, name).isEmpty():
            return made
    raise ValueError(f"chunks share identifiers with each of {SEEDS} seeds")


def assigned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", name: Callable[[memoryview, int], bytes] = identifier) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row: of equal texts the largest doc_id stays."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    made = verified(texts, name)
    key = ["print", "recipe"]
    each = materialise(made.groupBy("doc_id", *key).agg(F.count("*").alias("n"), F.first("text_sha256").alias("text_sha256")), "recipe-rows")
    groups = materialise(each.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")).where("group_size > 1"), "recipe-groups")
    n = each.agg(F.sum("n")).first()[0] or 0
    # At most 1,000 groups, whose recipes take a thousand average recipes together at most.
    hot = F.col("group_size") * 1_000 > n
    marked = each.join(F.broadcast(groups.where(hot)), key, "left")
    cold = marked.where("group_size IS NULL").drop("keep_id", "group_size").join(groups.where(~hot), key, "left")
    both = marked.where("group_size IS NOT NULL").unionByName(cold)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    both = both.withColumn("keep_id", keep).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    rows = both.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("k") == 1)).alias("kept"), "text_sha256")


def keep_last(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay. Only ids and digests are joined; texts move only if what goes is too much to broadcast."""
    rows = materialise(assigned(docs, doc_id, text).where("group_size > 1"), "equal-texts")
    gone, sha, stays = fresh(docs, "gw_gone"), fresh(docs, "gw_sha"), fresh(docs, "gw_stays")
    count = rows.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    count = materialise(count.where("NOT kept OR n > 1").select(F.col("doc_id").alias(gone), F.col("text_sha256").alias(sha), F.col("kept").alias(stays)), "equal-texts-gone")
    count = F.broadcast(count) if count.count() * 4 * ROW_BYTES <= BROADCAST_BYTES else count
    same = docs[doc_id].cast("long").eqNullSafe(F.col(gone)) & (F.sha2(F.coalesce(docs[text].cast("string"), F.lit("")), 256) == F.col(sha))
    once = docs.join(count.where(F.col(stays)), same).dropDuplicates([gone, sha]).select(*[docs[c] for c in docs.columns])
    return docs.join(count, same, "left_anti").unionByName(once)


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW g AS (PARTITION BY t)
"""
