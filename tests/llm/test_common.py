import random

import pytest

from scatterlake.llm import common


@pytest.mark.parametrize("local", [True, False])
def test_components_equal_union_find(spark, monkeypatch, local):
    if not local:
        monkeypatch.setattr(common, "LOCAL_EDGES", 0)
    rng = random.Random(6)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(45)]
    pairs += [(5, 5), (None, 3), (7, 6), (7, 6)]
    parent = {i: i for i in range(300)}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        if a is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(edges, spark.range(300).withColumnRenamed("id", "node")).collect()}
    assert got == {i: root(i) for i in range(300)}
