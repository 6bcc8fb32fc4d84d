"""Patterns on one large host: a graph whose nodes have more edges than fit in a row or a task.

A node's neighbours are sorted arrays of at most PART ids. A node with more has a power of two of parts, chosen by the low bits of a hash
of the neighbour, so that the parts of two nodes line up whatever their numbers: part j of the one with more meets part j modulo
the number of the other. A triangle is an edge whose ends' neighbour arrays intersect; an edge at a hot node is dealt over its
parts, and no array or group holds more than about PART ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 1024


def adjacency(edges: DataFrame, node: str, other: str, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """(node, parts) and (node, at, others): distinct neighbours in sorted arrays."""
    e = edges.select(F.col(node).alias("node"), F.col(other).alias("other")).filter("node is not null and other is not null").distinct()
    degree = e.groupBy("node").agg(F.count("*").alias("n"))
    doubled = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(float(part)))))
    degree = degree.select("node", F.pow(F.lit(2.0), doubled).cast("long").alias("parts"))
    held = e.join(degree, "node").groupBy("node", F.expr("pmod(xxhash64(other), parts)").alias("at")).agg(F.array_sort(F.collect_list("other")).alias("others"))
    return degree, held


def triangles(ab: DataFrame, bc: DataFrame, ac: DataFrame, part: int = PART) -> DataFrame:
    """(a, b, c) of all triangles: ab, bc and ac are tables of edges between nodes of three types, with these columns; edges that repeat count
    once, and an edge with a null end not at all."""
    own = ab.select("a", "b").filter("a is not null and b is not null").distinct()
    parts_a, held_a = adjacency(ac, "a", "c", part)
    parts_b, held_b = adjacency(bc, "b", "c", part)
    asked = own.join(parts_a.toDF("a", "parts_a"), "a").join(parts_b.toDF("b", "parts_b"), "b")
    asked = asked.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("parts_a", "parts_b") - 1)))
    asked = asked.select("a", "b", F.expr("j % parts_a").alias("at_a"), F.expr("j % parts_b").alias("at_b"))
    met = asked.join(held_a.toDF("a", "at_a", "of_a"), ["a", "at_a"]).join(held_b.toDF("b", "at_b", "of_b"), ["b", "at_b"])
    return met.select("a", "b", F.explode(F.array_intersect("of_a", "of_b")).alias("c"))


def path_counts(ab: DataFrame, bc: DataFrame) -> DataFrame:
    """(b, n): how many paths a - b - c go through each node, without listing them: the product of its degrees on both sides."""
    first = ab.select("a", "b").filter("a is not null and b is not null").distinct().groupBy("b").agg(F.count("*").alias("i"))
    second = bc.select("b", "c").filter("b is not null and c is not null").distinct().groupBy("b").agg(F.count("*").alias("o"))
    return first.join(second, "b").select("b", (F.col("i") * F.col("o")).alias("n"))
