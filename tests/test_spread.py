"""Shuffles that go to as many partitions as rows ask for."""

import pytest

from gapweave.operators import graph
from gapweave.plans import skills
from gapweave.sources import scratch, views

NAME = "spark.sql.shuffle.partitions"


def test_spread_follows_rows_and_ends(spark, monkeypatch):
    monkeypatch.setattr(scratch, "TASK_ROWS", 10)
    before = spark.conf.get(NAME)
    with scratch.spread(spark, 95):
        assert spark.conf.get(NAME) == "10"
    with pytest.raises(ZeroDivisionError), scratch.spread(spark, 1000):
        1 / 0
    with scratch.spread(spark, 1):
        assert spark.conf.get(NAME) == before
    assert spark.conf.get(NAME) == before


def test_joins_of_large_tables_are_spread(spark, monkeypatch):
    """profile_sync and dag_check write what they join while more partitions than the session's are set."""
    monkeypatch.setattr(scratch, "TASK_ROWS", 100)
    seen, write = {}, scratch.materialise

    def noted(df, name, **options):
        seen[name] = max(seen.get(name, 0), int(spark.conf.get(NAME)))
        return write(df, name, **options)

    from gapweave.plans import sources

    for module in (graph, sources, views):
        monkeypatch.setattr(module, "materialise", noted)
    sf = "/root/testdata/sf0.001"
    assert skills.QUERIES["profile_sync"](spark, sf).count() > 0
    ring = spark.createDataFrame([(k, (k + 1) % 300) for k in range(300)] + [(5, 5), (900, 900), (900, 0)], "course_id long, prerequisite_id long")
    assert sorted(r.course_id for r in graph.on_cycles(ring).collect()) == [*range(300), 900]
    assert all(seen[x] > 4 for x in ("has_skill", "touched", "synced", "walks", "jumps")), seen
