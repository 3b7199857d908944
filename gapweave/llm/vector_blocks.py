"""Vectors in packed blocks, and blocks of queries against blocks of vectors.

A stated query set meets all rows block by block: a packed block is one row with an Arrow table of a bounded number of
vectors, so a pair of blocks is one row of a join and one unit of work of bounded size. Blocks of vectors are shuffled
once; copies of the (fewer) query blocks go to them.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.llm.common import bounded_batches, materialise, release


def bytes_of(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def table_of(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks()


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def dealt(rows: DataFrame, most: int) -> Column:
    """A block number by a hash of vec_id, so that blocks have about `most` rows."""
    return F.pmod(F.xxhash64("vec_id"), F.lit(max(1, ceil(rows.count() / most)))).cast("int")


def packed(rows: DataFrame, name: str, most: int, block: Column, *order: Column) -> DataFrame:
    """block, part and data: `rows` by their number `block`, in `order`; a block of over twice `most` rows is cut in parts."""
    names = rows.columns
    numbered = rows.withColumn("block", block)
    m = (numbered.agg(F.max("block")).first()[0] or 0) + 1

    def pack(batches):
        block, part, parts, n = None, 0, [], 0

        def row():
            return pa.record_batch([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([bytes_of(pa.Table.from_batches(parts))], pa.binary())], names=["block", "part", "data"])

        for batch in batches:
            own = batch.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            data = pa.record_batch(batch.columns[1:], names=names)
            for a, b in zip(cut, cut[1:], strict=False):
                for k in range(a, b, most):
                    some = data.slice(k, min(most, b - k))
                    if n and (own[k] != block or n + len(some) > 2 * most):
                        yield row()
                        part, parts, n = part + 1 if own[k] == block else 0, [], 0
                    block = int(own[k])
                    parts.append(some)
                    n += len(some)
        if n:
            yield row()
        release()

    shuffled = numbered.repartition(m, "block").sortWithinPartitions("block", *order)
    return materialise(bounded_batches(shuffled).select("block", *names).mapInArrow(pack, "block int, part int, data binary"), name)


def paired(asked: DataFrame, stored: DataFrame, run: Callable, schema: str, prepare: Callable[[pa.Table], object] = lambda table: table) -> DataFrame:
    """`run(queries, prepare(vectors))` of every block of `asked` with every block of `stored` (both from packed()).

    All query blocks that meet a block of vectors do so in one task, one after another, so that `prepare` runs once for it.
    """
    m = (stored.agg(F.max("block")).first()[0] or 0) + 1

    def each(batches):
        last, ready = None, None
        for batch in batches:
            for number, a, b in zip(*batch.columns, strict=True):
                if number.as_py() != last:
                    ready = None  # frees the block before
                    last, ready = number.as_py(), prepare(table_of(b))
                yield from run(table_of(a), ready).to_batches()
        release()

    # Keys are few, so more partitions than keys keep two of them from meeting often. A block number may have two parts.
    copies = asked.select(F.col("data").alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("block")).repartition(4 * m, "block")
    both = copies.join(stored.select("block", "part", "data").repartition(4 * m, "block").hint("merge"), "block")
    number = (F.col("block").cast("long") * (1 << 32) + F.col("part")).alias("number")
    return bounded_batches(both.select(number, "asked", "data").sortWithinPartitions("number")).mapInArrow(each, schema)
