import random

from churnwise.llm.components import components


def test_components_match_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000, 1000 + i) for i in range(1, 60)]
    links += [(i, i + 1) for i in range(2000, 2040)] + [(5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
