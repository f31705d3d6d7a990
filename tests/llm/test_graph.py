import random

import pytest

from perigon.llm import graph


@pytest.mark.parametrize("few,held", [(graph.FEW, graph.HELD), (0, 7)])
def test_components(spark, monkeypatch, few, held):
    monkeypatch.setattr(graph, "FEW", few)
    monkeypatch.setattr(graph, "HELD", held)
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)] + [(7, 2000 + k) for k in range(90)] + [(2000 + k, 5000 - k) for k in range(0, 90, 2)]
    of = {}

    def find(x):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for a, b in edges:
        of[max(find(a), find(b))] = min(find(a), find(b))
    touched = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.id: r.root for r in graph.components(spark, spark.createDataFrame(edges, "id bigint, root bigint")).collect()}
    assert got == {x: find(x) for x in touched}
    assert graph.components(spark, spark.createDataFrame([], "id bigint, root bigint")).count() == 0
