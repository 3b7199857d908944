"""Markdown and plain texts as sections with heading paths, and sections as chunks with citations.

The first heading of a document is its title; further ones open sections. Lines within code fences are never headings; a
fence ends with the sign that it began with. What stands before the second heading is a section without heading, left out
if it is empty. A heading's path holds the headings above it of lower level. Chunks never span sections: paragraphs are
packed up to a number of characters, a longer paragraph is cut behind sentence ends, a longer sentence anywhere.

Null and empty texts are documents without title that have one empty section and no chunk. Repeated rows and ids are
documents of their own. Empty tables give empty results. Other columns are not read. Texts are worked on one by one in
the tasks that read them, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.functions.batches import BATCH_ROWS, bounded_batches

#: Characters of a chunk, at most.
MAX_CHARS = 800
#: Characters of texts whose rows go in one batch, about.
BATCH_CHARS = 1 << 20
#: Headings, fences, blank lines between paragraphs and sentence ends (fixed values).
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*\s*$")
FENCES = ("```", "~~~")
BLANK_LINES = re.compile(r"\n\s*\n+")
SENTENCE_END = re.compile(r"(?<=[。!?！？;；])")


def outline(text: str) -> tuple[str | None, list[tuple[str | None, int, str]]]:
    """The title of a text and heading, level and text of its sections."""
    title, fence = None, None
    parts: list[tuple[str | None, int, list[str]]] = [(None, 0, [])]
    for line in text.splitlines():
        sign = line.strip()[:3]
        if sign in FENCES:
            fence = sign if fence is None else None if fence == sign else fence
        elif fence is None and (found := HEADING.match(line)):
            if title is None:
                title = found[2].strip()
                parts.append((None, 0, []))
            else:
                parts.append((found[2].strip(), len(found[1]), []))
            continue
        parts[-1][2].append(line)
    sections = [(heading, level, "\n".join(lines).strip()) for heading, level, lines in parts]
    return title, [s for s in sections if s[0] is not None or s[2]] or sections[:1]


def paths(sections: list[tuple[str | None, int, str]]) -> Iterator[list[str]]:
    """The heading path of each section."""
    open_: list[tuple[int, str]] = []
    for heading, level, _ in sections:
        open_ = [] if heading is None else [*(x for x in open_ if x[0] < level), (level, heading)]
        yield [h for _, h in open_]


def packed(units: list[str], most: int, between: str) -> Iterator[str]:
    """Units of up to `most` characters joined greedily."""
    held = ""
    for unit in units:
        if held and len(held) + len(between) + len(unit) > most:
            yield held
            held = ""
        held = held + between + unit if held else unit
    if held:
        yield held


def pieces(text: str, most: int) -> Iterator[str]:
    """The chunks of a section's text."""
    short: list[str] = []
    for paragraph in (" ".join(p.split()) for p in BLANK_LINES.split(text)):
        if len(paragraph) <= most:
            short += [paragraph] if paragraph else []
            continue
        yield from packed(short, most, "\n")
        short, sentences = [], []
        for sentence in SENTENCE_END.split(paragraph):
            if len(sentence) <= most:
                sentences.append(sentence)
                continue
            yield from packed(sentences, most, "")
            sentences = []
            yield from (sentence[k : k + most] for k in range(0, len(sentence), most))
        yield from packed(sentences, most, "")
    yield from packed(short, most, "\n")


def exploded(docs: DataFrame, key: str, text: str, schema: str, rows_of: Callable[[object, str], list[tuple]]) -> DataFrame:
    """The rows that `rows_of` (key, text) gives, text by text, in batches of bounded size."""
    names, kinds = zip(*[part.split(" ") for part in schema.split(", ")], strict=True)
    types = [pa.int64() if k == "long" else pa.string() for k in kinds]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for k, t in zip(*batch.columns, strict=True):
                k, t = k.as_py(), t.as_py() or ""
                rows += rows_of(k, t)
                size += len(t)
                if len(rows) >= BATCH_ROWS or size >= BATCH_CHARS:
                    if rows:
                        yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return bounded_batches(docs).select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key (as text), title, section (from 0), level, heading, path (headings with > between) and text."""

    def rows(k, t):
        title, found = outline(t)
        return [(k, title, n, level, heading, " > ".join(path), body) for n, ((heading, level, body), path) in enumerate(zip(found, paths(found), strict=True))]

    return exploded(docs, key, text, "key string, title string, section long, level long, heading string, path string, text string", rows)


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", max_chars: int = MAX_CHARS) -> DataFrame:
    """doc_id (as text), title, chunk_index, path and content; documents without a title have their id as one."""
    if max_chars < 1:
        raise ValueError(f"max_chars must be at least 1: {max_chars}")

    def rows(k, t):
        title, found = outline(t)
        each = [(" > ".join(path), piece) for (_, _, body), path in zip(found, paths(found), strict=True) for piece in pieces(body, max_chars)]
        return [(k, title or k, n, path, piece) for n, (path, piece) in enumerate(each)]

    return exploded(docs, key, text, "doc_id string, title string, chunk_index long, path string, content string", rows)


def chunk_id(doc_id: Column, index: Column) -> Column:
    return F.format_string("%s:%04d", doc_id, index)


def citation(title: Column, path: Column) -> Column:
    """《title》 and the heading path."""
    return F.concat(F.lit("《"), title, F.lit("》"), F.when(path != "", F.concat(F.lit(" "), path)).otherwise(""))


def embed_text(title: Column, path: Column, content: Column) -> Column:
    """What is encoded of a chunk: title, heading path and content, a line each."""
    return F.concat_ws("\n", title, F.nullif(path, F.lit("")), content)


def without_chunks(docs: DataFrame, chunks_: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents that have no chunk, as errors."""
    known = chunks_.select(F.col("doc_id").alias("known")).distinct()
    return docs.select(F.col(key).cast("string").alias("doc_id")).join(known, F.col("doc_id") == F.col("known"), "left_anti").withColumn("error", F.lit("nothing to chunk"))


def context(hits: DataFrame, query: str, place: str) -> DataFrame:
    """One text for each query: its hits in order, each with citation, source, scores and content.

    Columns of `hits`: query, place, citation, source, score, vector_score, lexical, content. A query has few hits.
    """
    head = F.concat(F.format_string("[%d] ", F.col(place)), F.col("citation"))
    about = F.format_string("    source: %s | score %.2f (vector %.2f / words %.2f)", "source", "score", "vector_score", "lexical")
    lines = hits.select(query, F.col(place).alias("place"), F.concat_ws("\n", head, about, F.col("content")).alias("block"))
    blocks = lines.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("place", "block"))).alias("all"))
    return blocks.select(query, F.concat_ws("\n\n", F.lit("Related passages, best first:"), F.concat_ws("\n\n", F.col("all.block"))).alias("context"))
