import random

import pytest

from equiflow.llm import components as C


def brute(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("rows", [10, 200_000])
def test_equals_union_find(spark, monkeypatch, rows):
    monkeypatch.setattr(C, "ROWS_PER_PARTITION", rows)
    r = random.Random(1)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, k) for k in range(5001, 5100)] + [(7, 7)]
    r.shuffle(links)
    got = {x.node: x.root for x in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {k: v for k, v in brute([x for x in links if x[0] != x[1]]).items() if k != v}
    assert got == want


def test_no_links(spark):
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0
