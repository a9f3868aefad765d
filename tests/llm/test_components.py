"""Connected components against union-find."""

import numpy as np
import pytest

from claimspark.llm.components import components


def union_find(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root if find(x) != x}


@pytest.mark.parametrize("name", ["random", "path", "star", "two hubs", "repeats"])
def test_matches_union_find(spark, name):
    rng = np.random.default_rng(4)
    order = rng.permutation(300).tolist()
    links = {
        "random": [tuple(int(x) for x in rng.integers(-200, 200, 2)) for _ in range(180)],
        "path": list(zip(order, order[1:])),
        "star": [(500, i) for i in range(400)],
        "two hubs": [(900, i) for i in range(100)] + [(901, i) for i in range(99, 200)],
        "repeats": [(1, 2), (2, 1), (1, 2), (3, 3), (2, 4)],
    }[name]
    got = components(spark.createDataFrame(links, "u bigint, v bigint")).collect()
    want = union_find([x for x in links if x[0] != x[1]])
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []
