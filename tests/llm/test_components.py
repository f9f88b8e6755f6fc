import random

import pytest

from quayside.llm.common import Scratch
from quayside.llm.components import components


def brute(edges):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            p, q = top(a), top(b)
            root[max(p, q)] = min(p, q)
    return {x: top(x) for x in root}


def shuffled(n, seed):
    out = list(range(n))
    random.Random(seed).shuffle(out)
    return out


@pytest.mark.parametrize(
    "edges",
    [
        [],
        [(None, 1), (2, None), (3, 3)],
        [(i, i + 1) for i in range(300)],
        list(zip(shuffled(300, 1)[:-1], shuffled(300, 1)[1:], strict=True)),
        [(9999, i) for i in range(400)] + [(-5, -9)],
        [(random.Random(i).randrange(500), random.Random(-i - 1).randrange(500)) for i in range(350)],
    ],
)
def test_against_union_find(spark, edges):
    scratch = Scratch(spark, "test-components")
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.id: r.component for r in components(df, scratch, "cc").collect()} == brute(edges)
