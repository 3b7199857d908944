"""Token counts of documents from flat token files, by a scan for separators.

A token file is a plain run of token ids without any index: documents one after another, each closed by the separator.
It is kept in blocks of a fixed number of ids, cut without regard to documents. One vectorised search finds the
separators of a block; a prefix scan over the (small) block summaries then gives every block the ids and documents
before it and where the document that it begins with has started, which stitches documents across any number of blocks.

The files say nothing of ids of documents; what was written in which order stands in a listing of its own, which only
names the counted documents. A file whose last id is no separator has one more document there.

Null and empty texts are documents of 0 ids. Texts of any length are encoded whole. Equal rows are documents of their own.
An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapweave.llm.byte_bpe import encoder
from gapweave.llm.common import bounded_batches, list_array, materialise
from gapweave.llm.vbyte import id_type

#: One table holds blocks (tokens) and listings (doc_ids from the place `first` in the file on, block null).
FILES = "file int, block int, tokens binary, doc_ids array<long>, first long"
#: Documents of a row of a listing, at most.
LISTED = 100_000


def write_files(docs: DataFrame, tokenizer: str, separator: int, block_ids: int = 1 << 20, listed: int = LISTED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A token file for each partition of `docs`, whose texts never hold the separator: its string is ordinary text."""

    def write(batches):
        enc, file = encoder(tokenizer, special_as_text=True), TaskContext.get().partitionId()
        width = np.dtype(id_type(enc.size))
        order, parts, size, block, first = [], [], 0, 0, 0

        def row(block, tokens, doc_ids=None, first=None):
            return pa.record_batch([pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([tokens], pa.binary()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([first], pa.int64())], names=["file", "block", "tokens", "doc_ids", "first"])

        for batch in batches:
            order += batch.column(0).to_pylist()
            while len(order) >= listed:
                yield row(None, None, order[:listed], first)
                order, first = order[listed:], first + listed
            for text in batch.column(1):
                parts.append(np.append(enc.encode(text.as_py() or ""), np.uint32(separator)).astype(width))
                size += len(parts[-1])
                if size >= block_ids:
                    flat = np.concatenate(parts)
                    for k in range(0, size - block_ids + 1, block_ids):
                        yield row(block, flat[k : k + block_ids].tobytes())
                        block += 1
                    parts = [flat[size - size % block_ids :]]
                    size %= block_ids
        if size:
            yield row(block, np.concatenate(parts).tobytes())
        if order:
            yield row(None, None, order, first)

    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(write, FILES)
    return materialise(rows, "flat-token-files", compression="zstd")


def scan(files: DataFrame, separator: int, width: str = "<u2") -> DataFrame:
    """file, ordinal (of the document within its file), start (ids of all files before it) and n_tokens, without separators."""

    def search(batches):
        for batch in batches:
            for file, block, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(tokens, width)
                ends = np.flatnonzero(ids == separator)
                yield pa.record_batch([pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()), list_array(ends.astype(np.int32), np.array([len(ends)]))], names=["file", "block", "n", "ends"])

    found = bounded_batches(files).where("block IS NOT NULL").select("file", "block", "tokens").mapInArrow(search, "file int, block int, n long, ends array<int>")
    in_order = Window.partitionBy("file").orderBy("block")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    found = materialise(found, "separators")
    begun = found.withColumn("begin", F.sum("n").over(in_order) - F.col("n")).withColumn("ordinal", F.sum(F.size("ends")).over(in_order) - F.size("ends"))
    last = F.when(F.size("ends") > 0, F.col("begin") + F.element_at("ends", -1) + 1)
    begun = begun.withColumn("open", F.coalesce(F.max(last).over(earlier), F.lit(0).cast("long"))).withColumn("is_last", F.lead("block").over(in_order).isNull())
    closed = begun.select("file", "begin", "ordinal", "open", "ends", F.posexplode("ends").alias("k", "end"))
    closed = closed.select(
        "file",
        (F.col("ordinal") + F.col("k")).alias("ordinal"),
        F.when(F.col("k") == 0, F.col("open")).otherwise(F.col("begin") + F.get("ends", F.col("k") - 1) + 1).alias("at"),
        (F.col("begin") + F.col("end")).alias("to"),
    )
    after = F.greatest("open", last)
    rest = begun.where("is_last").select("file", (F.col("ordinal") + F.size("ends")).alias("ordinal"), F.coalesce(after, "open").alias("at"), (F.col("begin") + F.col("n")).alias("to")).where("at < to")
    totals = found.groupBy("file").agg(F.sum("n").alias("n"))
    before = totals.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return closed.unionAll(rest).join(before, "file").select("file", F.col("ordinal").cast("long").alias("ordinal"), (F.col("before") + F.col("at")).alias("start"), (F.col("to") - F.col("at")).alias("n_tokens"))


def named(files: DataFrame, counts: DataFrame) -> DataFrame:
    """The counts with the doc_id that the listing has at their place."""
    listing = files.where("block IS NULL").select("file", "first", F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    return listing.join(counts, ["file", "ordinal"]).select("doc_id", "start", "n_tokens")


def write_and_count(docs: DataFrame, tokenizer: str, separator: int, **sizes: int) -> DataFrame:
    """Writes all documents to token files and returns doc_id, start and n_tokens as found by scanning them."""
    files = write_files(docs, tokenizer, separator, **sizes)
    return named(files, scan(files, separator, id_type(encoder(tokenizer, True).size)))
