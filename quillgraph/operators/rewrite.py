"""Drives every document to a normal form.

Two lanes. normalise_trace takes exactly one step in each document a round, the first in the order of rules and matches,
and keeps the trace: rounds are as many as the longest cascade. normalise_strata, for certified rule sets, fires all matches
of a rank that don't share a node at once: rounds grow with the number of ranks, and the normal form is the same up to
names. Either way a round is a handful of joins on the document's id, and its tables are written out, which ends their
lineage; documents without a step leave the frontier.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.certify import stratify
from ..plans.matcher import one_step
from ..plans.rules import Rule
from ..session import shared_dir

NODE_COLS, EDGE_COLS = ("node_id", "node_type", "node_ord", "sent_idx"), ("edge_id", "src", "tgt", "edge_type", "edge_ord", "sent_idx")


def kept(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/quillgraph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _apply(rules: list[Rule], steps: DataFrame, nodes: DataFrame, edges: DataFrame, key: str, round_: int) -> tuple[DataFrame, DataFrame]:
    """The graphs after the chosen steps (key, rule_ord, at, used, n: the step's number in its document and round)."""
    gone_n, gone_e, new_n, new_e = [], [], [], []
    for i, r in enumerate(rules):
        own = steps.filter(F.col("rule_ord") == i)
        if r.deleted_nodes:
            gone_n.append(own.select(key, F.explode(F.array(*[F.col("at")[n] for n in r.deleted_nodes])).alias("node_id")))
        if r.deleted_edges:
            gone_e.append(own.select(key, F.explode(F.array(*[F.col("used")[e] for e in r.deleted_edges])).alias("edge_id")))

        def fresh(x):
            return F.concat(F.lit(f"s{round_}_"), F.col("n").cast("string"), F.lit("_" + x))

        def where(n, r=r, fresh=fresh):
            return F.col("at")[n] if n in r.kept_nodes else fresh(n)

        order = (F.lit(1_000_000 * (round_ + 1)) + F.col("n") * 16).cast("int")
        if r.made_nodes:
            new_n.append(own.select(key, F.explode(F.array(*[F.struct(fresh(n).alias("node_id"), F.lit(r.right.nodes[n]).alias("node_type"), (order + k).alias("node_ord"), F.lit(None).cast("int").alias("sent_idx")) for k, n in enumerate(r.made_nodes)])).alias("x")).select(key, "x.*"))
        if r.made_edges:
            made = [F.struct(fresh(e).alias("edge_id"), where(r.right.edges[e][0]).alias("src"), where(r.right.edges[e][1]).alias("tgt"), F.lit(r.right.edges[e][2]).alias("edge_type"), (order + k).alias("edge_ord"), F.lit(None).cast("int").alias("sent_idx")) for k, e in enumerate(r.made_edges)]
            new_e.append(own.select(key, F.explode(F.array(*made)).alias("x")).select(key, "x.*"))
    if gone_n:
        nodes = nodes.join(reduce(DataFrame.unionByName, gone_n), [key, "node_id"], "left_anti").select(key, *NODE_COLS)
    if gone_e:
        edges = edges.join(reduce(DataFrame.unionByName, gone_e), [key, "edge_id"], "left_anti").select(key, *EDGE_COLS)
    return reduce(DataFrame.unionByName, [nodes, *new_n]), reduce(DataFrame.unionByName, [edges, *new_e])


def normalise_trace(rules: list[Rule], nodes: DataFrame, edges: DataFrame, contexts: DataFrame, key: str = "doc_id", most: int = 5000):
    """(nodes, edges, trace): trace is (key, step, rule, at, used, sents), sents being the sentences of the edges that were used."""
    done_n, done_e, traces = [], [], []
    for round_ in range(most):
        every = one_step(rules, nodes, edges, contexts, key)
        first = Window.partitionBy(key).orderBy("rule_ord", "orders")
        steps = every.withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k").withColumn("n", F.lit(0))
        steps = kept(steps, "steps")
        if steps.isEmpty():
            return reduce(DataFrame.unionByName, [nodes, *done_n]), reduce(DataFrame.unionByName, [edges, *done_e]), _trace(traces, nodes, key)
        traces.append(_with_sentences(steps, edges, key).withColumn("step", F.lit(round_)))
        live = steps.select(key)
        done_n.append(nodes.join(live, key, "left_anti"))
        done_e.append(edges.join(live, key, "left_anti"))
        after_n, after_e = _apply(rules, steps, nodes.join(live, key, "left_semi"), edges.join(live, key, "left_semi"), key, round_)
        nodes, edges = kept(after_n, "nodes"), kept(after_e, "edges")
    raise RuntimeError(f"no normal form within {most} rounds")


def _with_sentences(steps: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """The steps with the sentence of each used edge, by the pattern's edge: a map."""
    used = steps.select(key, "rule_ord", "n", F.explode_outer("used").alias("elem", "edge_id"))
    found = used.join(edges.select(key, "edge_id", "sent_idx"), [key, "edge_id"], "left").groupBy(key, "rule_ord", "n").agg(F.map_from_entries(F.filter(F.collect_list(F.struct("elem", "sent_idx")), lambda x: x["elem"].isNotNull())).alias("sents"))
    return steps.join(found, [key, "rule_ord", "n"]).select(key, "rule", "rule_ord", "orders", "at", "used", "sents")


def _trace(traces: list[DataFrame], nodes: DataFrame, key: str) -> DataFrame:
    if traces:
        return reduce(DataFrame.unionByName, traces)
    kind = nodes.schema[key].dataType.simpleString()
    return nodes.sparkSession.createDataFrame([], f"{key} {kind}, rule string, rule_ord int, orders array<int>, at map<string,string>, used map<string,string>, sents map<string,int>, step int")


def normalise_strata(rules: list[Rule], nodes: DataFrame, edges: DataFrame, contexts: DataFrame, key: str = "doc_id", most: int = 1000):
    """(nodes, edges, fired): fired is (key, rule_ord, rule, round). For rules with ranks that are joinable."""
    ranks = stratify(rules).rank
    if any(r is None for r in ranks.values()):
        raise ValueError("a rule has no rank; use normalise_trace")
    fired, round_ = [], 0
    for level in sorted(set(ranks.values()), reverse=False):
        own = [r for i, r in enumerate(rules) if ranks[i] is not None and ranks[i] <= level]
        # A rank may call for lower ones again; rules of higher ranks wait.
        while True:
            every = one_step(own, nodes, edges, contexts, key)
            numbered = every.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("rule_ord", "orders")))
            # A step fires if it comes first at each of its nodes.
            at = numbered.select(key, "n", F.explode(F.map_values("at")).alias("node")).withColumn("first", F.min("n").over(Window.partitionBy(key, "node")))
            losers = at.filter("n <> first").select(key, "n").distinct()
            steps = kept(numbered.join(losers, [key, "n"], "left_anti"), "steps")
            if steps.isEmpty():
                break
            if round_ >= most:
                raise RuntimeError(f"no normal form within {most} rounds")
            fired.append(steps.select(key, "rule", F.lit(round_).alias("round")))
            after_n, after_e = _apply(own, steps, nodes, edges, key, round_)
            nodes, edges = kept(after_n, "nodes"), kept(after_e, "edges")
            round_ += 1
    kind = nodes.schema[key].dataType.simpleString()
    none = nodes.sparkSession.createDataFrame([], f"{key} {kind}, rule string, round int")
    return nodes, edges, reduce(DataFrame.unionByName, fired, none)
