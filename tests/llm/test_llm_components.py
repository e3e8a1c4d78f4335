"""Components against union-find."""

import random

import pytest

from gleaner.llm.components import components


def union_find(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def shapes():
    rng = random.Random(4)
    yield [(i, i + 1) for i in range(40)]
    yield [(i + 1, i) for i in range(0, 60, 2)]
    yield [(0, i) for i in range(1, 50)] + [(100, i) for i in range(101, 150)] + [(49, 149)]
    for n in (30, 80):
        yield [(rng.randrange(n), rng.randrange(n)) for _ in range(n)]
    yield [(-5, 3), (3, -5), (3, 3), (9, 8)]


@pytest.mark.parametrize("pairs", list(shapes()))
def test_components(spark, pairs):
    links = spark.createDataFrame([*pairs, (None, 1), (1, None)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == union_find([p for p in pairs if p[0] != p[1]])


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
