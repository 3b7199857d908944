"""Token files of frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Every id is replaced by its rank by frequency over the whole corpus (the commonest is 0; ties: smaller id first), so
that most ids fit in one byte. Four ranks share one control byte, two bits each saying whether a rank takes one, two,
three or four bytes; control bytes and data bytes are kept apart. Decoding looks the lengths of four ranks up in a table
of 256 control bytes and gathers all bytes of a block at once.

A token file is one partition of a Parquet table: documents of one range of doc_id in ascending order, in blocks of a
bounded number of ids. Spark's range partitioning samples a bounded number of doc_ids of each task for the ranges. A row
is a block: `bucket` (number of the range), `block` (number within the range), `start` (ids of the range before the
block), `doc_ids`, `counts` (ids of each document), `control`, `data`. Documents are never cut.

Null and empty texts have the end id only. Null doc_ids come first. Rows of equal doc_id each keep their ids; the one
with fewer ids stands first. Texts of any length are encoded whole; a document is never cut, so a block may be longer than
its bound. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapweave.llm.byte_bpe import encoder
from gapweave.llm.common import bounded_batches, list_array, materialise, release, runs

#: The number of bytes of each of the four ranks of a control byte.
LENGTHS = np.stack([(np.arange(256) >> (2 * k) & 3) + 1 for k in range(4)], axis=1).astype(np.int64)

#: The schema of token files.
BLOCKS = "bucket int, block int, start long, doc_ids array<long>, counts array<int>, control binary, data binary"


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of non-negative ranks below 2**32; the last control byte is filled up with zero bits."""
    ranks = ranks.astype("<u4", copy=False)
    lengths = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = lengths - 1
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    kept = np.arange(4) < lengths[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def decode_ranks(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """The ranks of documents of so many ids each, every document beginning with a control byte of its own."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()
    room = -(-counts // 4) * 4
    lengths = lengths[runs(np.cumsum(room) - room, counts)]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)))
    ranks = raw[starts].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        ranks[more] |= raw[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def tokenise(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian unsigned 16- or 32-bit integers) of every document, with the end id."""

    def ids(batches):
        enc = encoder(tokenizer)
        width = id_type(enc.size)
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                coded = [np.append(enc.encode(t.as_py() or ""), np.uint32(end_id)).astype(width).tobytes() for t in part.column(1)]
                yield pa.record_batch([part.column(0), pa.array(coded, pa.binary())], names=["doc_id", "ids"])
        release()

    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(ids, "doc_id long, ids binary")


def id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def frequencies(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """id and n: how often each id of the vocabulary occurs in all documents."""

    def count(batches):
        size = encoder(tokenizer).size
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_py(), id_type(size)), minlength=size)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_files(tokens: DataFrame, tokenizer: str, file_ids: int = 8_000_000, block_ids: int = 500_000) -> tuple[DataFrame, np.ndarray]:
    """Token files of `tokens` and the id of each rank.

    Only the ranking (at most one entry for each id of the vocabulary) and Spark's sample for the ranges of doc_id pass
    through the driver.
    """
    seen = [r["id"] for r in frequencies(tokens, tokenizer).orderBy(F.desc("n"), "id").collect()]
    id_of = np.array(seen, np.int64)
    rank_of = np.zeros(max(seen, default=0) + 1, np.uint32)
    rank_of[id_of] = np.arange(len(seen), dtype=np.uint32)
    size = tokens.agg(F.sum(F.octet_length("ids")).alias("n")).first()["n"] or 0
    width = id_type(encoder(tokenizer).size)
    files = max(1, math.ceil(size / np.dtype(width).itemsize / file_ids))

    def pack(batches):
        bucket, block, start, docs, size = None, 0, 0, [], 0

        def row():
            return pa.record_batch(
                [pa.array([bucket], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([[d for d, *_ in docs]], pa.list_(pa.int64())), pa.array([[n for _, n, *_ in docs]], pa.list_(pa.int32())), pa.array([b"".join(c for _, _, c, _ in docs)], pa.binary()), pa.array([b"".join(d for *_, d in docs)], pa.binary())],
                names=["bucket", "block", "start", "doc_ids", "counts", "control", "data"],
            )

        for batch in batches:
            for b, doc, raw in zip(*batch.columns, strict=True):
                b, doc, ids = b.as_py(), doc.as_py(), np.frombuffer(raw.as_buffer(), width)
                n = len(ids)
                if docs and (b != bucket or size + n > block_ids):
                    yield row()
                    block, start = block + 1, start + size
                    docs, size = [], 0
                if b != bucket:
                    bucket, block, start = b, 0, 0
                docs.append((doc, n, *encode_ranks(rank_of[ids])))
                size += n
        if docs:
            yield row()

    dealt = tokens.repartitionByRange(files, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.octet_length("ids"), "ids")
    dealt = bounded_batches(dealt).select(F.spark_partition_id().alias("bucket"), "doc_id", "ids")
    return materialise(dealt.mapInArrow(pack, BLOCKS), "token-files"), id_of


def offsets(blocks: DataFrame) -> DataFrame:
    """bucket and before: the ids of all earlier files. One row for each file, so the running sum stays small."""
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
    totals = blocks.select("bucket", size.alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"))
    return totals.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))


def read_files(blocks: DataFrame, id_of: np.ndarray) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document of token files."""

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["counts"], np.int64)
                ids = id_of[decode_ranks(row["control"], row["data"], counts)].astype("<u4")
                raw, ends = memoryview(ids.tobytes()), np.cumsum(counts)
                starts = ends - counts
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch(
                    [pa.array([row["bucket"]] * len(counts), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["start"]), pa.array(counts), pa.array(crc, pa.int64())],
                    names=["bucket", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    docs = blocks.mapInArrow(decode, "bucket int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(offsets(blocks), "bucket").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(blocks: DataFrame, id_of: np.ndarray) -> DataFrame:
    """doc_id and ids of every document of token files."""

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["counts"], np.int64)
                ids = id_of[decode_ranks(row["control"], row["data"], counts)].astype(np.int32)
                yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), list_array(ids, counts)], names=["doc_id", "ids"])

    return blocks.mapInArrow(decode, "doc_id long, ids array<int>")


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int = 0, **sizes: int) -> DataFrame:
    """Writes the token files of all documents and returns what read_files() finds in them."""
    tokens = materialise(tokenise(docs, tokenizer, end_id), "token-ids", compression="zstd")
    blocks, id_of = write_files(tokens, tokenizer, **sizes)
    return read_files(blocks, id_of)
