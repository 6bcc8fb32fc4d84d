"""Rewriting within the row: a document's graph is two arrays, and a rule is an expression over them.

Patterns become nested loops of array functions, negative conditions become exists(), guards are columns. A round is a narrow
stage: no join, no shuffle, whatever the number of documents, so this is the lane for graphs that fit in a row (a document's
own). The joins of quillgraph.plans.matcher are for graphs that don't.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.rules import Pattern, Rule
from . import parse
from .rewrite import kept

STEP = "struct<rule_ord:int,orders:array<int>,ids:array<string>,used:array<string>,sents:array<int>>"
TRACE = "array<struct<step:int,rule:string,rule_ord:int,ids:array<string>,used:array<string>,sents:array<int>>>"


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def graph_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", permits: bool = False) -> DataFrame:
    """The documents with sentences, nodes, edges and an empty trace."""
    p = parse.parsed(docs, id_col, text_col, permits)
    return p.withColumns({"nodes": parse.node_array(permits), "edges": parse.edge_array(permits)}).drop("marks", "backbone").withColumn("trace", F.array().cast(TRACE))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


class Graph(NamedTuple):
    """Where a graph's two arrays stand: columns of the row, or what a lambda is given."""

    nodes: Column | str = "nodes"
    edges: Column | str = "edges"


ROW = Graph()


def _is(node: Column, kind: str, g: Graph = ROW) -> Column:
    return F.exists(g.nodes, lambda n: (n["node_id"] == node) & (n["node_type"] == kind))


def _named(node: Column):
    return lambda n: n["node_id"] == node


def _touched(node: Column, but: list[Column], g: Graph = ROW) -> Column:
    """Whether an edge other than those named ends at the node."""
    return F.exists(g.edges, lambda e: ((e["src"] == node) | (e["tgt"] == node)) & _all([e["edge_id"] != h for h in but]))


def _forbidden(rule: Rule, nac: Pattern, env: dict[str, Column], g: Graph = ROW) -> Column:
    """Whether a negative condition is met around the nodes of env."""
    more = rule.extra(nac)

    def fresh(x: Column, kind: str, env: dict[str, Column]) -> Column:
        kinds = rule.left.nodes | more.nodes
        others = [c for n, c in env.items() if kinds.get(n) == kind]
        return _all([x != c for c in others])

    def edges(left: list, env: dict[str, Column]) -> Column:
        if not left:
            return nodes([n for n in more.nodes if n not in env], env)
        (s, t, kind), rest = left[0], left[1:]

        def one(e):
            on, now = [e["edge_type"] == kind], dict(env)
            for name, end in ((s, e["src"]), (t, e["tgt"])):
                if name in now:
                    on.append(end == now[name])
                else:
                    on += [_is(end, more.nodes[name], g), fresh(end, more.nodes[name], now)]
                    now[name] = end
            return _all(on) & edges(rest, now)

        return F.exists(g.edges, one)

    def nodes(left: list[str], env: dict[str, Column]) -> Column:
        if not left:
            return F.lit(True)
        kind = more.nodes[left[0]]
        return F.exists(g.nodes, lambda n: (n["node_type"] == kind) & fresh(n["node_id"], kind, env) & nodes(left[1:], env | {left[0]: n["node_id"]}))

    return edges(list(more.edges.values()), env)


def steps_of(rule: Rule, ord_: int, guarded: bool = True, g: Graph = ROW, near: Column | None = None) -> Column:
    """All applicable matches of a rule in the row's graph, as an array of steps; near: only those with one of these nodes."""
    names = list(rule.left.nodes)

    def at_hand(ends: list[Column]) -> list[Column]:
        return [] if near is None else [reduce(lambda a, b: a | b, [F.array_contains(near, x) for x in ends])]

    def finish(env, used) -> Column:
        ids = [env[n] for n in names]
        on = at_hand(ids) if ids else []
        on += [_is(env[n], rule.left.nodes[n], g) for n in names]
        on += [env[a] != env[b] for i, a in enumerate(names) for b in names[i + 1 :] if rule.left.nodes[a] == rule.left.nodes[b]]
        on += [~_forbidden(rule, nac, env, g) for nac in rule.nacs]
        held = [e["edge_id"] for e in used.values()]
        for n in rule.deleted_nodes:
            on.append(~_touched(env[n], held, g))
        order = F.array(*[F.element_at(F.transform(F.filter(g.nodes, _named(c)), lambda x: x["node_ord"]), 1) for c in ids])
        step = F.struct(F.lit(ord_).alias("rule_ord"), order.alias("orders"), F.array(*ids).alias("ids"), (F.array(*held) if held else _none("string")).alias("used"), (F.array(*[e["sent_idx"] for e in used.values()]) if used else _none("int")).alias("sents"))
        return F.when(_all(on), F.array(step.cast(STEP))).otherwise(_none(STEP))

    def edges(left: list, env, used) -> Column:
        if not left:
            return nodes([n for n in names if n not in env], env, used)
        (name, (s, t, kind)), rest = left[0], left[1:]

        def fits(e):
            on = [e["edge_type"] == kind] + [e["edge_id"] != u["edge_id"] for u in used.values()]
            on += [end == env[n] for n, end in ((s, e["src"]), (t, e["tgt"])) if n in env]
            if s == t:
                on.append(e["src"] == e["tgt"])
            if len(rule.left.edges) == 1 and len(names) <= 2:
                on += at_hand([e["src"], e["tgt"]])
            # The first of parallel edges that isn't taken yet.
            first = ~F.exists(g.edges, lambda f: (f["edge_ord"] < e["edge_ord"]) & (f["edge_type"] == kind) & (f["src"] == e["src"]) & (f["tgt"] == e["tgt"]) & _all([f["edge_id"] != u["edge_id"] for u in used.values()]))
            return _all(on) & first

        return F.flatten(F.transform(F.filter(g.edges, fits), lambda e: edges(rest, {s: e["src"], t: e["tgt"]} | env, used | {name: e})))

    def nodes(left: list[str], env, used) -> Column:
        if not left:
            return finish(env, used)
        alone = len(names) == 1
        found = F.filter(g.nodes, lambda n: _all([n["node_type"] == rule.left.nodes[left[0]], *(at_hand([n["node_id"]]) if alone else [])]))
        return F.flatten(F.transform(found, lambda n: nodes(left[1:], env | {left[0]: n["node_id"]}, used)))

    found = edges(list(rule.left.edges.items()), {}, {})
    return F.when(rule.guard.column(), found).otherwise(_none(STEP)) if guarded else found


def all_steps(rules: list[Rule], guarded: bool = True) -> Column:
    """In the order of rules and matches."""
    return F.array_sort(F.concat(*[steps_of(r, i, guarded) for i, r in enumerate(rules)]))


def _apart(steps: Column) -> Column:
    """Greedily, the steps that share no node with one before them."""
    start = F.struct(_none("string").alias("ids"), _none(STEP).alias("chosen"))

    def add(acc, m):
        return F.when(F.arrays_overlap(acc["ids"], m["ids"]), acc).otherwise(F.struct(F.concat(acc["ids"], m["ids"]).alias("ids"), F.array_append(acc["chosen"], m).alias("chosen")))

    return F.aggregate(steps, start, add, lambda acc: acc["chosen"])


def _per_rule(rules: list[Rule], make, kind: str) -> Column:
    """The arrays that make(rule, step, number) gives, of all chosen steps."""

    def of(m, j):
        out = _none(kind)
        for i, r in enumerate(rules):
            items = make(r, m, j)
            if items:
                out = F.when(m["rule_ord"] == i, F.array(*[x.cast(kind) for x in items])).otherwise(out)
        return out

    return F.flatten(F.transform("chosen", of))


_NODE = "struct<node_id:string,node_type:string,node_ord:int,sent_idx:int>"
_EDGE = "struct<edge_id:string,src:string,tgt:string,edge_type:string,edge_ord:int,sent_idx:int>"


def _apply(df: DataFrame, rules: list[Rule], round_: int) -> DataFrame:
    def at(r, m, n, j):
        return m["ids"][list(r.left.nodes).index(n)] if n in r.kept_nodes else fresh(j, n)

    def fresh(j, name):
        return F.concat(F.lit(f"s{round_}_"), j.cast("string"), F.lit("_" + name))

    def order(j, k):
        return F.lit(1_000_000 * (round_ + 1) + k) + j * 16

    gone_n = _per_rule(rules, lambda r, m, j: [m["ids"][list(r.left.nodes).index(n)] for n in r.deleted_nodes], "string")
    gone_e = _per_rule(rules, lambda r, m, j: [m["used"][list(r.left.edges).index(e)] for e in r.deleted_edges], "string")
    new_n = _per_rule(rules, lambda r, m, j: [F.struct(fresh(j, n), F.lit(r.right.nodes[n]), order(j, k), F.lit(None).cast("int")) for k, n in enumerate(r.made_nodes)], _NODE)
    new_e = _per_rule(rules, lambda r, m, j: [F.struct(fresh(j, e), at(r, m, r.right.edges[e][0], j), at(r, m, r.right.edges[e][1], j), F.lit(r.right.edges[e][2]), order(j, k), F.lit(None).cast("int")) for k, e in enumerate(r.made_edges)], _EDGE)
    names = F.array(*[F.lit(r.name) for r in rules])
    more = F.transform("chosen", lambda m: F.struct(F.lit(round_).alias("step"), F.element_at(names, m["rule_ord"] + 1).alias("rule"), m["rule_ord"].alias("rule_ord"), m["ids"].alias("ids"), m["used"].alias("used"), m["sents"].alias("sents")))
    d = df.withColumns({"gone_n": gone_n, "gone_e": gone_e, "new_n": new_n, "new_e": new_e})
    nodes = F.concat(F.filter("nodes", lambda n: ~F.array_contains(F.col("gone_n"), n["node_id"])).cast(f"array<{_NODE}>"), "new_n")
    edges = F.concat(F.filter("edges", lambda e: ~F.array_contains(F.col("gone_e"), e["edge_id"])).cast(f"array<{_EDGE}>"), "new_e")
    return d.withColumns({"nodes": nodes, "edges": edges, "trace": F.concat("trace", more.cast(TRACE))}).drop("chosen", "gone_n", "gone_e", "new_n", "new_e")


def normalise(rules: list[Rule], rows: DataFrame, every: bool = False, most: int = 5000) -> DataFrame:
    """The rows in normal form, with their traces. rows: of graph_rows, with age and jurisdiction.

    every: fire all steps of a document that share no node at once, for certified sets, whose normal form doesn't depend on
    the order; else the first step only. Rows without a step leave the frontier.
    """
    done, live = [], rows.withColumns({"nodes": F.col("nodes").cast(f"array<{_NODE}>"), "edges": F.col("edges").cast(f"array<{_EDGE}>")})
    for round_ in range(most):
        steps = all_steps(rules)
        chosen = _apart(F.col("found")) if every else F.slice("found", 1, 1)
        t = kept(live.withColumn("found", steps).withColumn("chosen", chosen).drop("found"), "round")
        done.append(t.filter("size(chosen) = 0").drop("chosen"))
        after = t.filter("size(chosen) > 0")
        if after.isEmpty():
            return reduce(DataFrame.unionByName, done)
        live = _apply(after, rules, round_)
    raise RuntimeError(f"no normal form within {most} rounds")


def trace_table(rows: DataFrame, rules: list[Rule], key: str = "doc_id") -> DataFrame:
    """(key, step, rule, sents) of all steps, sents mapping the rule's edges to sentences: what realize() takes."""
    t = rows.select(key, F.explode("trace").alias("t")).select(key, "t.*")
    sents = F.create_map().cast("map<string,int>")
    for r in rules:
        if r.left.edges:
            sents = F.when(F.col("rule") == r.name, F.map_from_arrays(F.array(*[F.lit(e) for e in r.left.edges]), F.col("sents"))).otherwise(sents)
    return t.select(key, "step", "rule", "rule_ord", sents.alias("sents"))


def component_count() -> Column:
    """The connected components of the row's graph: labels of its nodes, merged edge by edge."""
    ids = F.transform("nodes", lambda n: n["node_id"])
    ends = F.transform("edges", lambda e: F.struct((F.array_position(ids, e["src"]) - 1).cast("int").alias("s"), (F.array_position(ids, e["tgt"]) - 1).cast("int").alias("t")))
    start = F.when(F.size("nodes") > 0, F.sequence(F.lit(0), F.size("nodes") - 1)).otherwise(_none("int"))

    def merge(labels, e):
        a, b = F.get(labels, e["s"]), F.get(labels, e["t"])
        return F.when(a == b, labels).otherwise(F.transform(labels, lambda x: F.when(x == F.greatest(a, b), F.least(a, b)).otherwise(x)))

    return F.size(F.array_distinct(F.aggregate(ends, start, merge)))


def coverage(rules: list[Rule], rows: DataFrame) -> DataFrame:
    """(hosts, covered, structurally, host_rule): documents that a rule matches with its guard, or whatever the context, and pairs."""
    def found(guarded: bool) -> Column:
        return F.array_distinct(F.transform(all_steps(rules, guarded), lambda m: m["rule_ord"]))

    d = rows.select(F.size(found(True)).alias("k"), F.size(found(False)).alias("s"))
    return d.agg(F.count("*").alias("hosts"), F.count_if(F.col("k") > 0).alias("covered"), F.count_if(F.col("s") > 0).alias("structurally"), F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("host_rule"))


def coverage_by_rule(rules: list[Rule], rows: DataFrame) -> DataFrame:
    """(rule, guarded, structural): documents that each rule matches with its guard, and whatever the context."""
    names = F.array(*[F.lit(r.name) for r in rules])

    def found(guarded: bool) -> Column:
        return F.transform(F.array_distinct(F.transform(all_steps(rules, guarded), lambda m: m["rule_ord"])), lambda o: F.struct(F.element_at(names, o + 1).alias("rule"), F.lit(int(guarded)).alias("g")))

    parts = [found(True), found(False)]
    hits = rows.select(F.explode(F.concat(*parts)).alias("h")).groupBy("h.rule").agg(F.sum("h.g").cast("long").alias("guarded"), F.sum(1 - F.col("h.g")).cast("long").alias("structural"))
    every = rows.sparkSession.createDataFrame([(r.name,) for r in rules], "rule string")
    return every.join(hits, "rule", "left").select("rule", F.coalesce("guarded", F.lit(0)).cast("long").alias("guarded"), F.coalesce("structural", F.lit(0)).cast("long").alias("structural"))
