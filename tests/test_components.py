"""Connected components against a plain union of sets."""

import numpy as np

from claimloom.operators.components import components


def test_long_paths_and_stars(spark):
    rng = np.random.default_rng(0)
    order = rng.permutation(400).tolist()
    edges = [(order[i], order[i + 1]) for i in range(299)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5000, 5000), (6001, 6000), (6001, 6002)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
