"""Courses on cycles, beside plain searches."""

import random

from gapweave.operators import graph


def reached(edges, start):
    seen, todo = set(), [start]
    while todo:
        for b in edges.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_cycles_without_all_pairs(spark, monkeypatch):
    walks = graph.walks
    monkeypatch.setattr(graph, "walks", None)  # pairs of everything that is connected are not made
    rng = random.Random(3)
    # Rings of ways between each other, and what lies between them.
    pairs = [(9 * k + j, 9 * k + (j + 1) % 3) for k in range(12) for j in range(3)] + [(9 * k + rng.randrange(9), 9 * rng.randrange(k) + rng.randrange(9)) for k in range(1, 12) for _ in range(12)]
    pairs += [(9 * k + j, 9 * k + j - 1) for k in range(12) for j in range(4, 9)] + [(200, 200)]
    edges = {}
    for a, b in pairs:
        edges.setdefault(a, set()).add(b)
    want = sorted(a for a in edges if a in reached(edges, a))
    df = spark.createDataFrame([*pairs, (None, 3), (3, None)], "course_id long, prerequisite_id long")
    assert sorted(r.course_id for r in graph.on_cycles(df).collect()) == want and 36 < len(want) < 108
    monkeypatch.setattr(graph, "walks", walks)
    monkeypatch.setattr(graph, "MOST_ROUNDS", 1)  # ways too long for single steps
    assert sorted(r.course_id for r in graph.on_cycles(df).collect()) == want
