"""Tags from a table of aliases beside a plain search."""

import random

import pytest

from gapweave.operators import tagging


def plain(text, dictionary):
    places = {}
    for alias, name in dictionary:
        if alias and name and text is not None and alias.lower() in text.lower():
            at = text.lower().index(alias.lower())
            places[name] = min(places.get(name, at), at)
    return [n for _, n in sorted((p, n) for n, p in places.items())]


@pytest.mark.parametrize("few", [True, False])
def test_tags(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(tagging, "BROADCAST_BYTES", 0)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé日") for _ in range(rng.randint(1, 5)))
    dictionary = [(word(), f"n{rng.randrange(40)}") for _ in range(120)] + [("Two Words", "two"), (None, "x"), ("", "y"), ("zz", None), ("two words", "two")]
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(40)] + [None, "", "TWO WORDS two", "ab" * 40_000 + "two words"]
    rows = list(enumerate(texts)) + [(3, texts[4])]
    df = spark.createDataFrame(rows, "id int, t string").selectExpr("*", "1 AS name", "2 AS gram", "3 AS alias")
    got = tagging.tagged(df, "t", spark.createDataFrame(dictionary, "alias string, name string"))
    assert got.columns == [*df.columns, "names"]
    assert sorted((r.id, r.t or "", r.names) for r in got.collect()) == sorted((k, t or "", plain(t, dictionary)) for k, t in rows)
    assert tagging.tagged(df.limit(0), "t", spark.createDataFrame(dictionary, "alias string, name string")).count() == 0
    assert tagging.tagged(df, "t", spark.createDataFrame([], "alias string, name string")).where("size(names) > 0").count() == 0


def test_runs_of_texts_become_no_rows(spark):
    texts = spark.createDataFrame([("abc " * 50 + "Zebra 😀x",), ("no",), (None,)], "t string")
    got = tagging.tagged(texts, "t", spark.createDataFrame([("zebra", "z"), ("😀X", "smile"), ("c a", "c"), ("o", "o")], "alias string, name string"))
    assert sorted((r.names for r in got.collect()), key=len) == [[], ["o"], ["c", "z", "smile"]]
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
