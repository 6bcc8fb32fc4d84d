"""Compiles a rule to a join tree: pattern edges first, negative conditions as anti joins, guards as filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rules import Pattern, Rule


def _apart(columns: list[str], types: dict[str, str], others: dict[str, str] | None = None):
    """Nodes of one type are different nodes."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :] if types[a] == types[b]]
    pairs += [(a, b) for a in columns for b, t in (others or {}).items() if types[a] == t]
    return reduce(lambda x, p: x & (F.col(f"n_{p[0]}") != F.col(f"n_{p[1]}")), pairs, F.lit(True))


def _join(df: DataFrame | None, other: DataFrame, key: str) -> DataFrame:
    if df is None:
        return other
    return df.join(other, [key, *[c for c in other.columns if c.startswith("n_") and c in df.columns]])


def _edges_of(edges: DataFrame, e: str, spec: tuple[str, str, str], rank: int, ids: bool, key: str) -> DataFrame:
    s, t, kind = spec
    found = edges.filter((F.col("edge_type") == kind) & (F.col("parallel") == rank))
    cols = [F.col(key), F.col("src").alias(f"n_{s}")] + ([F.col("tgt").alias(f"n_{t}")] if s != t else [])
    found = found.filter("src = tgt") if s == t else found
    return found.select(*cols, *([F.col("edge_id").alias(f"e_{e}")] if ids else []))


def _with_parallel(edges: DataFrame, key: str) -> DataFrame:
    """Edges numbered among those of equal ends and type, so that the k-th of a pattern takes the k-th of the graph."""
    from pyspark.sql import Window

    w = Window.partitionBy(key, "src", "tgt", "edge_type").orderBy("edge_ord")
    return edges.withColumn("parallel", F.row_number().over(w) - 1)


def find_matches(p: Pattern, nodes: DataFrame, edges: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each match: key, n_<node> and o_<node> (its order), e_<edge>. edges: with the column parallel."""
    df, seen = None, {}
    for e, spec in p.edges.items():
        rank = seen.get(spec, 0)
        seen[spec] = rank + 1
        df = _join(df, _edges_of(edges, e, spec, rank, True, key), key)
    for n, kind in p.nodes.items():
        df = _join(df, nodes.filter(F.col("node_type") == kind).select(key, F.col("node_id").alias(f"n_{n}"), F.col("node_ord").alias(f"o_{n}")), key)
    return df.filter(_apart(list(p.nodes), p.nodes))


def _forbidden(rule: Rule, nac: Pattern, found: DataFrame, nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """The matches around which a negative condition is met."""
    more, names = rule.extra(nac), list(rule.left.nodes)
    df = found.select(key, *[f"n_{n}" for n in names])
    for e, spec in more.edges.items():
        df = _join(df, _edges_of(edges, e, spec, 0, False, key), key)
    for n, kind in more.nodes.items():
        df = _join(df, nodes.filter(F.col("node_type") == kind).select(key, F.col("node_id").alias(f"n_{n}")), key)
    return df.filter(_apart(list(more.nodes), more.nodes, rule.left.nodes)).select(key, *[f"n_{n}" for n in names])


def applicable_matches(rule: Rule, nodes: DataFrame, edges: DataFrame, contexts: DataFrame, key: str = "doc_id", guarded: bool = True) -> DataFrame:
    """Matches of a rule where its guard holds, no negative condition is met and no edge would dangle.

    contexts: (key, age, jurisdiction).
    """
    edges = edges if "parallel" in edges.columns else _with_parallel(edges, key)
    found = find_matches(rule.left, nodes, edges, key)
    if guarded:
        found = found.join(contexts.filter(rule.guard.column()).select(key), key, "left_semi")
    names = [f"n_{n}" for n in rule.left.nodes]
    for nac in rule.nacs:
        met = _forbidden(rule, nac, found, nodes, edges, key).distinct()
        found = found.join(met, [key, *names], "left_anti")
    for n in rule.deleted_nodes:
        # Edges at a node that goes must all be matched.
        at = edges.select(key, F.col("src").alias(f"n_{n}"), "edge_id").unionByName(edges.filter("src <> tgt").select(key, F.col("tgt").alias(f"n_{n}"), "edge_id"))
        held = F.array(*[F.col(f"e_{e}") for e in rule.left.edges]) if rule.left.edges else F.array().cast("array<string>")
        loose = found.join(at, [key, f"n_{n}"]).filter(~F.array_contains(held, F.col("edge_id"))).select(key, *names).distinct()
        found = found.join(loose, [key, *names], "left_anti")
    return found


def one_step(rules: list[Rule], nodes: DataFrame, edges: DataFrame, contexts: DataFrame, key: str = "doc_id", guarded: bool = True) -> DataFrame:
    """All possible steps of all rules: (key, rule_ord, rule, orders, nodes, edges), where nodes and edges map the pattern's ids."""
    edges = _with_parallel(edges, key)
    out = []
    for i, r in enumerate(rules):
        m = applicable_matches(r, nodes, edges, contexts, key, guarded)

        def mapped(prefix, ids):
            return F.create_map(*[x for n in ids for x in (F.lit(n), F.col(f"{prefix}_{n}"))]) if ids else F.create_map().cast("map<string,string>")

        out.append(m.select(key, F.lit(i).alias("rule_ord"), F.lit(r.name).alias("rule"), F.array(*[F.col(f"o_{n}") for n in r.left.nodes]).alias("orders"), mapped("n", list(r.left.nodes)).alias("at"), mapped("e", list(r.left.edges)).alias("used")))
    return reduce(DataFrame.unionByName, out)
