import random

import pytest

from koine.operators.components import components, on_driver


@pytest.mark.parametrize("file_edges", [100_000, 10])
def test_components(spark, monkeypatch, file_edges):
    monkeypatch.setattr("koine.operators.components.FILE_EDGES", file_edges)
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 130)] + [(200, k) for k in range(201, 230)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(30)] + [(7, 7), (7, 7)]
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 3), (3, None)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert dict(on_driver(edges)) == {x: find(x) for e in edges for x in e}


def test_no_edges_and_strings(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    got = components(spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string")).collect()
    assert {(r["node"], r["root"]) for r in got} == {("a", "a"), ("b", "a"), ("c", "a")}


def test_many_minima_are_not_broadcast(spark):
    """Small files of many ids: Spark alone would send them to the driver."""
    from koine.operators.components import _large_star, _small_star
    from koine.operators.rebuild import BROADCAST_ROWS, replaced

    edges = spark.range(1000).selectExpr("id + 1 as a", "id as b")
    moved = edges.selectExpr("a as term_id", "b as root")
    for df in (_large_star(edges, True), _small_star(edges, True), replaced(edges, "a", moved, BROADCAST_ROWS + 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
