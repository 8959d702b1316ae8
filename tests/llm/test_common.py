import random

from reportloom.llm.common import components


def test_components_against_union_find(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 230)] + [(300, 300), (None, 1)]
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(edges, "src long, dst long")
    assert {(r.node, r.component) for r in components(frame).collect()} == {(n, root(n)) for n in parent}
    assert components(frame.where("false")).count() == 0
