"""Connected components of a link table, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links between integers to (node, root): root is the smallest node that can be reached. Nodes without links have no row.

    Each round is two joins on the link table, which shrinks to one star a component; rounds grow with the logarithm of
    a component's size. A round's table is written to the shared folder, which ends its lineage.
    """
    e = shared.settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = state
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_lowest(both).select("a", F.least("m", "a").alias("m")), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = _lowest(large)
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e, old = shared.settle(small.distinct(), "stars"), e
        shared.discard(old)
        shared.release(edges.sparkSession)
