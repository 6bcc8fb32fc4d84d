"""Semi-naive rewriting within the row: one step at a time, many steps in one stage.

A row's state is its graph, the steps that are possible in it by rule, and its trace. After a step only rules whose types the step
has changed are matched again, and only around the nodes that it touched: steps elsewhere are carried along. The loop over steps is
an aggregate() over the row's state, so that a stage takes up to STEPS steps of every document without a join, shuffle, write or
job in between; only documents that aren't done after that go on in a further stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.rules import Rule
from .isomorphism import canonical_keys, written
from .local import _EDGE, _NODE, STEP, TRACE, Graph, _none, steps_of
from .rewrite import kept

#: Steps of a stage, and the place in the order from which made nodes and edges are numbered.
STEPS, MADE = 32, 1 << 30
_STATE = f"struct<nodes:array<{_NODE}>,edges:array<{_EDGE}>,found:array<array<{STEP}>>,trace:{TRACE},n:int,graphs:array<string>>"


def _types(rule: Rule) -> tuple[set[str], set[str]]:
    """The types of nodes and of edges that a step of the rule makes or takes away."""
    nodes = {rule.left.nodes[n] for n in rule.deleted_nodes} | {rule.right.nodes[n] for n in rule.made_nodes}
    return nodes, {rule.left.edges[e][2] for e in rule.deleted_edges} | {rule.right.edges[e][2] for e in rule.made_edges}


def affects(fired: Rule, rule: Rule) -> bool:
    """Whether a step of one rule can change which steps of another are possible."""
    nodes, edges = _types(fired)
    watched_n, watched_e = set(rule.left.node_types), set(rule.left.edge_types)
    for nac in rule.nacs:
        watched_n |= rule.extra(nac).node_types
        watched_e |= rule.extra(nac).edge_types
    return bool(nodes & watched_n or edges & watched_e or (rule.deleted_nodes and edges))


def stays_near(rule: Rule) -> bool:
    """Whether a match can only change by what happens at its own nodes: each condition's edges touch the left side."""
    for nac in rule.nacs:
        more = rule.extra(nac)
        ends = {x for s, t, _ in more.edges.values() for x in (s, t)}
        if not set(more.nodes) <= ends or any(s not in rule.left.nodes and t not in rule.left.nodes for s, t, _ in more.edges.values()):
            return False
    return True


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _made(rule: Rule, m: Column, n: Column) -> tuple[Column, Column, Column, Column]:
    """What a step of the rule takes and makes: ids of nodes and edges, new nodes and edges."""

    def fresh(name):
        return F.concat(F.lit("s"), n.cast("string"), F.lit("_0_" + name))

    def at(name):
        return F.get(m["ids"], list(rule.left.nodes).index(name)) if name in rule.kept_nodes else fresh(name)

    def order(k):
        return (F.lit(MADE + k) + n * 16).cast("int")

    nothing = F.lit(None).cast("int")
    gone_n = [F.get(m["ids"], list(rule.left.nodes).index(x)) for x in rule.deleted_nodes]
    gone_e = [F.get(m["used"], list(rule.left.edges).index(x)) for x in rule.deleted_edges]
    new_n = [F.struct(fresh(x).alias("node_id"), F.lit(rule.right.nodes[x]).alias("node_type"), order(k).alias("node_ord"), nothing.alias("sent_idx")) for k, x in enumerate(rule.made_nodes)]
    new_e = [F.struct(fresh(x).alias("edge_id"), at(rule.right.edges[x][0]).alias("src"), at(rule.right.edges[x][1]).alias("tgt"), F.lit(rule.right.edges[x][2]).alias("edge_type"), order(k).alias("edge_ord"), nothing.alias("sent_idx")) for k, x in enumerate(rule.made_edges)]
    kinds = ("string", "string", _NODE, _EDGE)
    return tuple(F.array(*x).cast(f"array<{k}>") if x else _none(k) for x, k in zip((gone_n, gone_e, new_n, new_e), kinds, strict=True))


def _after(rules: list[Rule], s: Column, m: Column, graphs: bool) -> Column:
    """The state after a step."""
    names = F.array(*[F.lit(r.name) for r in rules])
    changes = F.lit(None).cast(f"struct<gone_n:array<string>,gone_e:array<string>,new_n:array<{_NODE}>,new_e:array<{_EDGE}>>")
    for i, r in enumerate(rules):
        gone_n, gone_e, new_n, new_e = _made(r, m, s["n"])
        changes = F.when(m["rule_ord"] == i, F.struct(gone_n.alias("gone_n"), gone_e.alias("gone_e"), new_n.alias("new_n"), new_e.alias("new_e"))).otherwise(changes)

    def graph(c):
        nodes = F.concat(F.filter(s["nodes"], lambda n: ~F.array_contains(c["gone_n"], n["node_id"])), c["new_n"])
        edges = F.concat(F.filter(s["edges"], lambda e: ~F.array_contains(c["gone_e"], e["edge_id"])), c["new_e"])
        touched = F.concat(m["ids"], F.transform(c["new_n"], lambda n: n["node_id"]))
        return F.struct(nodes.alias("nodes"), edges.alias("edges"), touched.alias("touched"))

    def state(g):
        found = []
        for i, r in enumerate(rules):
            before = F.get(s["found"], i)
            by = [k for k, q in enumerate(rules) if affects(q, r)]
            if not by:
                found.append(before)
            elif stays_near(r):
                away = F.filter(before, lambda f: ~F.arrays_overlap(f["ids"], g["touched"]))
                found.append(F.when(m["rule_ord"].isin(by), F.concat(away, steps_of(r, i, True, Graph(g["nodes"], g["edges"]), g["touched"]))).otherwise(before))
            else:
                found.append(F.when(m["rule_ord"].isin(by), steps_of(r, i, True, Graph(g["nodes"], g["edges"]))).otherwise(before))
        step = F.struct(s["n"].alias("step"), F.get(names, m["rule_ord"]).alias("rule"), m["rule_ord"].alias("rule_ord"), m["ids"].alias("ids"), m["used"].alias("used"), m["sents"].alias("sents"))
        seen = F.array_append(s["graphs"], written(g["nodes"], g["edges"])) if graphs else s["graphs"]
        return F.struct(g["nodes"].alias("nodes"), g["edges"].alias("edges"), F.array(*found).alias("found"), F.concat(s["trace"], F.array(step).cast(TRACE)).alias("trace"), (s["n"] + 1).alias("n"), seen.alias("graphs")).cast(_STATE)

    return _let(_let(changes, graph), state)


def _start(rules: list[Rule], graphs: bool) -> Column:
    found = F.array(*[steps_of(r, i) for i, r in enumerate(rules)]) if rules else _none(f"array<{STEP}>")
    first = F.array(written()) if graphs else _none("string")
    return F.struct(F.col("nodes"), F.col("edges"), found.alias("found"), F.col("trace"), F.size("trace").alias("n"), first.alias("graphs")).cast(_STATE)


def _open(state: Column) -> Column:
    return F.exists(state["found"], lambda f: F.size(f) > 0)


def _steps(rules: list[Rule], steps: int, graphs: bool) -> Column:
    """The state after at most so many steps, the first in the order of rules and matches each time."""

    def step(s, _):
        return F.when(_open(s), _let(F.array_min(F.flatten(s["found"])), lambda m: _after(rules, s, m, graphs))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("state"), step)


def _unpacked(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"nodes": F.col("state.nodes"), "edges": F.col("state.edges"), "trace": F.col("state.trace")}).drop("state")


def normalise(rules: list[Rule], rows: DataFrame, steps: int = STEPS, most: int = 10_000) -> DataFrame:
    """The rows in normal form, with their traces: one step at a time. rows: of graph_rows, with age and jurisdiction.

    The same normal forms and traces as local.normalise; a document that takes more than most steps is an error.
    """
    done, live, further = [], rows.withColumn("state", _start(rules, False)), _steps(rules, steps, False)
    for _ in range(0, most, steps):
        t = kept(live.withColumn("state", further), "stage")
        done.append(_unpacked(t.filter(~_open(F.col("state")))))
        live = t.filter(_open(F.col("state")))
        if live.isEmpty():
            return reduce(DataFrame.unionByName, done)
    raise RuntimeError(f"no normal form within {most} steps")


def run_hosts(rules: list[Rule], rows: DataFrame, steps: int = 16, most: int = 10_000) -> DataFrame:
    """Each row run one step at a time until no step is possible (success), a graph comes again up to isomorphism (nonterm), or
    most steps are taken (inconclusive): status, and steps, those taken until then.

    The graphs of a stage are brought into canonical form after it, and the keys of all graphs so far stay with the row.
    """
    live = rows.withColumn("state", _start(rules, True)).withColumn("seen", _none("string"))
    done, keep = [], [c for c in rows.columns if c not in ("nodes", "edges", "trace")]
    taken, further, keys = 0, _steps(rules, steps, True), canonical_keys(F.col("state.graphs"))
    while True:
        last = taken + steps >= most
        t = live.withColumn("state", _steps(rules, most - taken, True) if last else further)
        taken += min(steps, most - taken)
        t = kept(t.withColumn("keys", keys), "runs")
        t = t.withColumn("seen", F.concat("seen", "keys")).drop("keys")
        # The first graph that is among those before it.
        again = F.filter(F.transform("seen", lambda k, i: F.struct((F.array_position(F.col("seen"), k) - 1).alias("first"), i.alias("i"))), lambda x: x["first"] < x["i"])
        t = t.withColumn("again", F.get(again, 0)["i"])
        status = F.when(F.col("again").isNotNull(), "nonterm").when(~_open(F.col("state")), "success")
        status = status.otherwise(F.lit("inconclusive")) if last else status
        t = t.withColumn("status", status)
        done.append(t.filter("status is not null").select(*keep, "status", F.coalesce("again", F.size("state.trace")).cast("long").alias("steps"), F.col("state.trace").alias("trace")))
        live = t.filter("status is null").drop("again", "status").withColumn("state", F.col("state").withField("graphs", _none("string")))
        if last or live.isEmpty():
            return reduce(DataFrame.unionByName, done)
