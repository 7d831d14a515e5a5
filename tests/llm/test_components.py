"""Components of graphs whose hubs hold most edges."""

import random

import pytest

from cartolake.llm.components import components


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_hubs(spark, hot_rows):
    rng = random.Random(2)
    edges = [(i, 5000) for i in range(300)] + [(7000 + i, 7000) for i in range(200)] + [(i, i + 1) for i in range(8000, 8060)]
    edges += [(rng.randrange(9000, 9040), rng.randrange(9000, 9040)) for _ in range(30)] + [(3, 3), (9999, 9999), (7, 5000)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    linked = {x for u, v in edges if u != v for x in (u, v)}
    got = components(spark.createDataFrame(edges, "u long, v long").repartition(3), hot_rows).collect()
    assert sorted((r.id, r.component) for r in got) == sorted((x, find(x)) for x in linked)
