"""Graphs up to isomorphism: classes of all documents' graphs, and colours of graphs that don't fit in a row.

Documents' graphs stand in their rows. Rows whose graphs are written alike are counted first; each distinct writing is put into its
canonical form inside a task, and the digest of that form is the class's key. So nothing is compared in pairs, and a class that
holds a third of all documents is a sum. Graphs of any size are refined by joins: colours travel along edges, a node's edges
are summed up before they meet, and rounds go on until no colour class splits.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import canonical
from .rewrite import kept


def written(nodes: Column | str = "nodes", edges: Column | str = "edges") -> Column:
    """A row's graph in JSON: the types of its nodes in order, and its edges by the places of their ends."""
    nodes, edges = (F.col(c) if isinstance(c, str) else c for c in (nodes, edges))
    ids = F.transform(nodes, lambda n: n["node_id"])

    def place(end):
        return (F.array_position(ids, end) - 1).cast("int")

    ends = F.transform(edges, lambda e: F.struct(place(e["src"]).alias("s"), e["edge_type"].alias("k"), place(e["tgt"]).alias("t")))
    return F.to_json(F.struct(F.transform(nodes, lambda n: n["node_type"]).alias("types"), F.array_sort(ends).alias("edges")))


def canonical_key(graph: Column) -> Column:
    """The key of a graph in JSON: equal for two graphs exactly if they are isomorphic."""

    @F.pandas_udf("string")
    def key(graphs: pd.Series) -> pd.Series:
        return graphs.map(canonical.key)

    return key(graph)


def canonical_keys(graphs: Column) -> Column:
    """The keys of an array of graphs."""

    @F.pandas_udf("array<string>")
    def keys(held: pd.Series) -> pd.Series:
        return held.map(lambda x: [canonical.key(g) for g in x])

    return keys(graphs)


def isomorphism_classes(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(class_key, first, n, n_nodes, n_edges): the classes of the rows' graphs, the smallest key of each and how many rows it has."""
    d = rows.select(F.col(key).alias("k"), written().alias("graph"), F.size("nodes").cast("long").alias("n_nodes"), F.size("edges").cast("long").alias("n_edges"))
    alike = d.groupBy("graph").agg(F.min("k").alias("first"), F.count("*").alias("n"), F.first("n_nodes").alias("n_nodes"), F.first("n_edges").alias("n_edges"))
    keyed = alike.withColumn("class_key", canonical_key(F.col("graph")))
    return keyed.groupBy("class_key").agg(F.min("first").alias("first"), F.sum("n").cast("long").alias("n"), F.first("n_nodes").alias("n_nodes"), F.first("n_edges").alias("n_edges"))


def refine(nodes: DataFrame, edges: DataFrame, most: int = 1000, rounds: int | None = None) -> tuple[DataFrame, list[int]]:
    """Colours of the nodes of one graph of any size, (node_id, colour), and how many colours each round had, from the types on; after so
    many rounds, or until no class splits.

    nodes: (node_id, node_type), edges: (src, tgt, edge_type). Two nodes have one colour if no number of steps along edges tells
    them apart. Colours are 128 bits in two numbers; what meets at a node is a sum over its edges, so that a node with very many is
    added up before it is shuffled. Edges are kept once for both ways, colours of a round go when the next ones stand, and what was shuffled for
    a round goes with them.
    """

    def digest(*of) -> list[Column]:
        return [F.xxhash64(F.lit(k), *of).alias(c) for k, c in ((1, "c1"), (2, "c2"))]

    now = kept(nodes.select("node_id", *digest("node_type")), "colours")
    counts = [now.select("c1", "c2").distinct().count()]
    ends = kept(edges.select("src", "tgt", "edge_type"), "ends")
    for _ in range(most if rounds is None else rounds):
        said = None
        for way, (to, end) in enumerate((("src", "tgt"), ("tgt", "src"))):
            # 4 x 32 bits of each neighbour, which can be added up without end.
            mark = [F.xxhash64(F.lit(k), F.lit(way), "edge_type", "c1", "c2") for k in (3, 4)]
            parts = [x for m in mark for x in (m.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(m, 32))]
            heard = ends.join(now.withColumnRenamed("node_id", end), end).select(F.col(to).alias("node_id"), *[x.alias(f"s{i}") for i, x in enumerate(parts)])
            said = heard if said is None else said.unionByName(heard)
        around = said.groupBy("node_id").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(4)])
        told = [F.coalesce(f"s{i}", F.lit(-1)) for i in range(4)]
        before, now = now, kept(now.join(around, "node_id", "left").select("node_id", *digest("c1", "c2", *told)), "colours")
        counts.append(now.select("c1", "c2").distinct().count())
        _drop(before)
        if counts[-1] == counts[-2]:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"colours still split after {most} rounds")
    _drop(ends)
    return now.select("node_id", F.concat(F.hex("c1"), F.lit("-"), F.hex("c2")).alias("colour")), counts


def _drop(held: DataFrame) -> None:
    """Deletes a table of kept() that no later step reads, and has the driver collect garbage, upon which Spark's cleaner deletes the shuffle files of
    plans that are done with."""
    spark = held.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in held.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    spark.sparkContext._jvm.System.gc()
