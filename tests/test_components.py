import random

import pytest

from sievelake.operators.components import connected_components


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("limit", [10**6, 0])
@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_equals_union_find(spark, limit, kind):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (900, 900)]
    if kind == "string":
        edges = [(f"é{a}", f"é{b}") for a, b in edges]
    df = spark.createDataFrame([*edges, (None, edges[0][0])], f"a {kind}, b {kind}")
    got = {r.node: r.component for r in connected_components(df, one_task_edges=limit).collect()}
    assert got == union_find(edges)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_no_edges(spark, limit):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), one_task_edges=limit).collect() == []
