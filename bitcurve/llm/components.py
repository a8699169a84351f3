"""Connected components of a link table by alternating large and small stars.

Every round replaces each node's links by links to the least node it knows, first towards its larger, then
towards its smaller neighbours; the number of rounds grows with the logarithm of the longest path. A star's
least member is found by an aggregate that combines map-side and joined back, so a node linked with a third
of all others is no group of any task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitcurve.session import cut_lineage


def _stars(links: DataFrame, keep: str) -> DataFrame:
    """Link every neighbour u of v for which ``keep`` holds with the least of v and its neighbours."""
    least = links.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
    linked = links.filter(keep).join(least, "v")
    return linked.select(F.greatest("u", "m").alias("v"), F.least("u", "m").alias("u")).filter("u < v")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (long columns u, v): component is the least node that can
    be reached. Loops and repeated edges do no harm; nodes without edges do not appear."""
    links = cut_lineage(
        edges.select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).filter("u < v").distinct()
    )
    before = None
    while True:
        both = links.unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = _stars(both, "u > v").distinct()
        # Towards smaller neighbours: links already point from v down to u.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(least, "v")
        small = joined.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(
            least.select("v", F.col("m").alias("u"))
        )
        links = cut_lineage(small.filter("u < v").distinct())
        now = links.agg(F.count(F.lit(1)), F.expr("sum(pmod(xxhash64(u, v), 4294967296))")).first()
        if now == before:
            break
        before = now
    nodes = links.select(F.col("v").alias("id"), F.col("u").alias("component"))
    return nodes.unionByName(links.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least reachable index for each of ``n`` nodes, of links inside one block."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root
