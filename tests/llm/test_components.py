import random

import numpy as np

from bitcurve.llm.bitmap import bitmap_of, marked
from bitcurve.llm.components import connected_components, local_components


def brute(n, edges):
    root = list(range(n))
    for _ in range(n):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components(spark):
    random.seed(3)
    chain = [(i, i + 1) for i in range(40)]
    star = [(60, i) for i in range(61, 90)]
    some = [(random.randrange(100, 160), random.randrange(100, 160)) for _ in range(45)]
    edges = chain + star + some + [(5, 5), (200, 200), (1, 0)]
    random.shuffle(edges)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = brute(201, edges)
    assert got == {i: want[i] for i in {x for e in edges for x in e if e[0] != e[1]}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    a, b = np.array(edges).T
    assert local_components(201, a, b).tolist() == want


def test_bitmap(spark):
    values = [random.randrange(-(2**63), 2**63) for _ in range(500)] + [-1, 0, 2**63 - 1]
    bits = bitmap_of(spark.createDataFrame([(v,) for v in values + [None]], "h long"), "h", 20)
    h = np.array(values, np.int64).view(np.uint64)
    assert marked(bits, h).all()
    other = np.random.default_rng(1).integers(0, 2**63, 20000, dtype=np.uint64)
    assert marked(bits, other).mean() < 0.01
