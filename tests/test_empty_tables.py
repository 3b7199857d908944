"""Every domain query over empty tables of the driver's schemas: no crash, and no rows but those of totals."""

import pytest

from gapweave import plans  # noqa: F401
from gapweave.plans import skills
from gapweave.sources.scratch import scratch

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Reports that have rows of totals without any input.
TOTALS = {"normalise_summary", "training_totals", "chunk_counts"}


@pytest.fixture(scope="module")
def nothing(spark):
    path = scratch(spark, "empty-tables")
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return path


@pytest.mark.parametrize("name", sorted(skills.QUERIES))
def test_empty(spark, nothing, name):
    rows = skills.QUERIES[name](spark, nothing).collect()
    assert not rows or name in TOTALS or len(rows) <= 10, rows
