"""Limits of the Arrow batches that tasks exchange with Python."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows and bytes of a batch, at most; a longer row is a batch by itself.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """`df`, after lowering its session's limits of Arrow batches to BATCH_ROWS and BATCH_BYTES; lower ones stay.

    Whole partitions in one batch would take their size several times over, in the executor and in Python. The limits are
    read when a result runs, so they stay in the session.
    """
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(name).lower().rstrip("b")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df
