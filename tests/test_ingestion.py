"""Incremental ingestion against ingestion of everything."""

from gapweave.operators import documents, ingestion
from gapweave.sources.scratch import scratch


def test_refresh(spark):
    kept = ingestion.tables_at(spark, scratch(spark, "ingestion"), buckets=3)
    make = lambda rows: spark.createDataFrame(rows, "doc_id string, text string")
    one = [("a", "# A\n\nfirst text"), ("b", "second text"), ("c", None), ("d", "to go"), (None, "nobody"), ("b", "a copy")]
    two = [("a", "# A\n\nfirst text"), ("b", "second text, changed\n\n" + "long. " * 400), ("c", None), ("e", "new")]

    def state():
        return sorted(tuple(r) for r in kept["chunks"].read().select("doc_id", "chunk_index", "title", "content").collect())

    def whole(rows):
        last = {k: max(t or "" for x, t in rows if x == k) for k, _ in rows if k is not None}
        return sorted(tuple(r) for r in documents.chunks(make(sorted(last.items()))).select("doc_id", "chunk_index", "title", "content").collect())

    assert sorted(map(tuple, ingestion.refresh(kept, make(one)).collect())) == [(k, "new") for k in "abcd"] and state() == whole(one)
    versions = {k: t.manifest()["version"] for k, t in kept.items()}
    assert ingestion.refresh(kept, make(one)).count() == 0 and {k: t.manifest()["version"] for k, t in kept.items()} == versions
    assert sorted(map(tuple, ingestion.refresh(kept, make(two)).collect())) == [("b", "changed"), ("d", "gone"), ("e", "new")] and state() == whole(two)
    # A refresh that stopped after the chunks is done again.
    kept["manifest"].delete(make([("b", "")]), "doc_id")
    assert sorted(map(tuple, ingestion.refresh(kept, make(two)).collect())) == [("b", "new")] and state() == whole(two)
    assert ingestion.refresh(kept, make([])).count() == 4 and state() == [] and kept["manifest"].read().count() == 0
