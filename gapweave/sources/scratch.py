"""Intermediate tables in the folder that a cluster's machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task after a shuffle, about, while spread() holds.
TASK_ROWS = 500_000

#: The folders of local sessions that name none, by application.
_own: dict[str, str] = {}


def base(spark: SparkSession) -> str:
    """The application's own folder below the one that the session names in spark.checkpoint.dir.

    Only a local session, whose executors share the driver's disk, gets a folder of its own when none is named.
    """
    named, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _own:
            _own[app] = f"file://{tempfile.mkdtemp(prefix='gapweave-')}"
        named = _own[app]
    return f"{named.rstrip('/')}/gapweave-{app}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a table of this application."""
    return f"{base(spark)}/{name}-{uuid.uuid4().hex}"


def purge(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application. Results must be saved before: they are read from these tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: cuts the lineage, gives Spark its true size."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def spread(spark: SparkSession, rows: int) -> Iterator[int]:
    """While it holds, shuffles go to as many partitions as so many rows ask for (no fewer than the session's), so that what a
    task sorts or groups does not grow with the input. What is to be spread must be written within."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    n = max(int(before), -(-rows // TASK_ROWS))
    spark.conf.set(name, str(n))
    try:
        yield n
    finally:
        spark.conf.set(name, before)
