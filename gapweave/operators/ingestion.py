"""Incremental ingestion: only new and changed documents are cut again, and documents that went lose their chunks.

Two tables with commits hold what there is: a manifest (doc_id, digest of the text) and the chunks. A refresh compares the
documents of a folder (or any table of doc_id and text) with the manifest, cuts what differs and replaces it, chunks first: a
refresh that stops in between is done again by the next one, since the manifest still has the old digests. Null texts count
as empty, documents without a chunk stand in the manifest only. Of rows with one doc_id the one with the largest text counts; a null doc_id is no
document. No documents at all empty both tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gapweave.operators import documents
from gapweave.operators.commits import Table
from gapweave.sources.scratch import materialise

MANIFEST = "doc_id string, digest string"
#: Texts are written several times, so they are packed closely.
COMPRESSION = "zstd"
CHUNKS = "doc_id string, chunk_index int, title string, content string"


def tables_at(spark: SparkSession, path: str, buckets: int = 16) -> dict[str, Table]:
    kinds = {"manifest": (MANIFEST, ["doc_id"]), "chunks": (CHUNKS, ["doc_id", "chunk_index"])}
    return {k: Table.create(spark, f"{path}/{k}", StructType.fromDDL(schema), key, buckets) for k, (schema, key) in kinds.items()}


def refresh(kept: dict[str, Table], docs: DataFrame, max_chars: int = documents.MAX_CHARS) -> DataFrame:
    """Brings both tables up to date with `docs` (doc_id, text); returns doc_id and state (new, changed, gone) of what differed."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    now = rows.groupBy("doc_id").agg(F.max("text").alias("text")).select("doc_id", "text", F.sha2("text", 256).alias("digest"))
    now = materialise(now, "documents-now", compression=COMPRESSION)
    before = kept["manifest"].read().select("doc_id", F.col("digest").alias("old"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("digest").isNull(), "gone").when(F.col("old") != F.col("digest"), "changed")
    differs = now.select("doc_id", "digest").join(before, "doc_id", "full").withColumn("state", state).where("state IS NOT NULL")
    differs = materialise(differs.select("doc_id", "digest", "state"), "documents-that-differ")
    if differs.isEmpty():
        return differs.select("doc_id", "state")
    fresh = now.join(differs.where("state <> 'gone'").select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    cut = materialise(documents.chunks(fresh, "doc_id", "text", max_chars).select("doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), "title", "content"), "fresh-chunks", compression=COMPRESSION)
    kept["chunks"].replace(cut, differs, "doc_id")
    kept["manifest"].replace(differs.where("state <> 'gone'").select("doc_id", "digest"), differs, "doc_id")
    return differs.select("doc_id", "state")
