"""Connected components against union-find."""

import random

import pytest

from auditframe.llm.components import components


def plain(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up}


CHAIN = [(i, i + 1) for i in range(3000)]
STAR = [(5000, i) for i in range(2000)]
RANDOM = [(random.Random(i).randrange(900), random.Random(-i - 1).randrange(900)) for i in range(700)]


@pytest.mark.parametrize("edges", [CHAIN, STAR, RANDOM, CHAIN + [(b, a) for a, b in STAR] * 2, [(-7, 9), (9, -7), (3, 3)]])
def test_components(spark, edges):
    want = {x: y for x, y in plain([(a, b) for a, b in edges if a != b]).items()}
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(rows) == len(want) and {r.node: r.label for r in rows} == want


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
