"""Components by one task and by star rounds, against a walk."""

import random

import pytest

from tessera.functions.graph import components


def walked(links):
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        todo = [start] if start not in out else []
        while todo:
            v = todo.pop()
            if v not in out:
                out[v] = start
                todo += near[v]
    return out


@pytest.mark.parametrize("small", [0, 10**6])
@pytest.mark.parametrize("name", [int, lambda k: f"n{k:05d}"])
def test_both_ways_give_the_same(spark, small, name):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 560)] + [(700, k) for k in range(701, 760)] + [(5, 5), (7, 9), (9, 7)]
    links = [(name(a), name(b)) for a, b in links]
    kind = "long" if name is int else "string"
    got = {r.node: r.root for r in components(spark.createDataFrame(links, f"a {kind}, b {kind}"), small).collect()}
    assert got == walked(links)


@pytest.mark.parametrize("small", [0, 10])
def test_no_links(spark, small):
    assert components(spark.createDataFrame([], "a long, b long"), small).count() == 0
