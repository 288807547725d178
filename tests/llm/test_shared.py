import random

from loomgraph.llm.shared import components


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, r.randrange(501, 900)) for _ in range(200)]
    edges += [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(150)] + [(7, 7), (-5, 3), (3, -5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in root if x != 7}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {tuple(x) for x in components(df).collect()} == want
    assert {tuple(x) for x in components(df, one_task=0).collect()} == want
    assert components(df.limit(0)).count() == 0
