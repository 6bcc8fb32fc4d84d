"""Alignment of typed graphs: the greatest number of matched nodes and edges, exactly, in Arrow batches.

Nodes are matched within their types, one to one. Edges between matched nodes count if they have one label; with k and m parallel
ones, the smaller number. Images are searched for nodes that hold an end of each edge, hubs first, the image that allows the most
edges first; the search turns back where the edges that are still undecided, counted by the types and label of their ends, can't lead
beyond the best so far, and images that may be exchanged for each other, or stand in parts of one shape that nothing was mapped
to yet, are tried once. What is left are nodes whose edges all lead to decided ones: an assignment for each type, solved by
augmenting paths. The first way that reaches the bound, the common case, ends the search.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import canonical


class _Side:
    def __init__(self, nodes: list[str], edges: list[tuple[int, str, int]]):
        self.nodes, self.edges = nodes, Counter(map(tuple, edges))
        self.at: list[list[tuple[int, str, int]]] = [[] for _ in nodes]
        for e in self.edges:
            for n in {e[0], e[2]}:
                self.at[n].append(e)

    def kind(self, e: tuple[int, str, int]) -> tuple[str, str, str]:
        return self.nodes[e[0]], e[1], self.nodes[e[2]]

    def parts(self) -> tuple[list[int], list[str]]:
        """Each node's connected part by number, and the shape of each part."""
        part, shapes = [-1] * len(self.nodes), []
        for start in range(len(self.nodes)):
            if part[start] < 0:
                part[start], work = len(shapes), [start]
                while work:
                    for s, _, t in self.at[work.pop()]:
                        for n in (s, t):
                            if part[n] < 0:
                                part[n] = len(shapes)
                                work.append(n)
                shapes.append("")
        for k in range(len(shapes)):
            own = [n for n in range(len(self.nodes)) if part[n] == k]
            place = {n: i for i, n in enumerate(own)}
            edges = [(place[s], label, place[t]) for n in own for s, label, t in self.at[n] if s == n for _ in range(self.edges[(s, label, t)])]
            shapes[k] = canonical.form([self.nodes[n] for n in own], edges)
        return part, shapes


def _cover(a: _Side, useful: set) -> list[int]:
    """Nodes that hold an end of each edge that may be matched, those with the most edges first."""
    left, out = set(useful), []
    while left:
        ends = Counter(n for e in left for n in {e[0], e[2]})
        loops = [e[0] for e in left if e[0] == e[2]]
        out.append(loops[0] if loops else max(ends, key=lambda n: (ends[n], -n)))
        left = {e for e in left if out[-1] not in (e[0], e[2])}
    return out


def assignment(gain: list[list[int]]) -> int:
    """The greatest total gain of a one-to-one choice of columns for rows, by shortest augmenting paths. Not more rows than columns."""
    n, m = len(gain), len(gain[0]) if gain else 0
    row_price, column_price, owner = [0] * (n + 1), [0] * (m + 1), [0] * (m + 1)
    for row in range(1, n + 1):
        owner[0], column = row, 0
        slack, back, seen = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while owner[column]:
            seen[column] = True
            now, step, following = owner[column], float("inf"), 0
            for c in range(1, m + 1):
                if not seen[c]:
                    cost = -gain[now - 1][c - 1] - row_price[now] - column_price[c]
                    if cost < slack[c]:
                        slack[c], back[c] = cost, column
                    if slack[c] < step:
                        step, following = slack[c], c
            for c in range(m + 1):
                if seen[c]:
                    row_price[owner[c]] += step
                    column_price[c] -= step
                else:
                    slack[c] -= step
            column = following
        while column:
            owner[column] = owner[back[column]]
            column = back[column]
    return sum(gain[owner[c] - 1][c - 1] for c in range(1, m + 1) if owner[c])


def best_alignment(nodes_a: list[str], edges_a: list[tuple[int, str, int]], nodes_b: list[str], edges_b: list[tuple[int, str, int]]) -> tuple[int, int]:
    """(nodes, edges) matched by the best one-to-one map between nodes of equal types."""
    have_b = Counter(nodes_b)
    matched = sum(min(n, have_b[t]) for t, n in Counter(nodes_a).items())
    a, b = _Side(nodes_a, edges_a), _Side(nodes_b, edges_b)
    goals = Counter()
    for e, n in b.edges.items():
        goals[b.kind(e)] += n
    useful = {e for e in a.edges if goals[a.kind(e)]}
    cover = _cover(a, useful)
    part, shapes = b.parts()
    best, where, used, busy = -1, {}, set(), Counter()

    def hits(e) -> int:
        return min(a.edges[e], b.edges[(where[e[0]], e[1], where[e[2]])]) if None not in (where[e[0]], where[e[2]]) else 0

    def around(side: _Side, n: int, edges) -> Counter:
        """Edges at a node by direction, label and type of the other end."""
        out = Counter()
        for e in edges:
            out[(e[0] == n, e[1], side.nodes[e[2] if e[0] == n else e[0]])] += side.edges[e]
        return out

    def within(n: int, m: int | None) -> int:
        """How many of a node's edges to nodes that aren't decided can be matched at an image."""
        if m is None:
            return 0
        there = around(b, m, [e for e in b.at[m] if e[0] not in used or e[2] not in used])
        return sum(min(k, there[x]) for x, k in around(a, n, [e for e in a.at[n] if e in useful and (e[0] not in where or e[2] not in where)]).items())

    def bound() -> int:
        free = Counter()
        for e in useful:
            if e[0] not in where and e[2] not in where:
                free[a.kind(e)] += a.edges[e]
        decided = sum(hits(e) for e in useful if e[0] in where and e[2] in where)
        return decided + sum(within(n, m) for n, m in where.items()) + sum(min(k, goals[x]) for x, k in free.items())

    def images(n: int) -> list[int | None]:
        """Images of a node, those that allow the most first; at last none. Of images that lead to the same only one."""
        found: dict = {}
        for m in range(len(nodes_b)):
            if m not in used and nodes_b[m] == nodes_a[n]:
                if busy[part[m]]:
                    alike = tuple(sorted((s if s != m else -1, k, t if t != m else -1, b.edges[(s, k, t)]) for s, k, t in b.at[m]))
                else:
                    alike = (shapes[part[m]], _rank(b, part, m))
                found.setdefault(alike, m)
        scored = []
        for m in found.values():
            where[n] = m
            used.add(m)
            scored.append((-sum(hits(e) for e in a.at[n] if e in useful and e[0] in where and e[2] in where) - within(n, m), m))
            used.discard(m)
            del where[n]
        return [m for _, m in sorted(scored)] + [None]

    def rest() -> int:
        """The best for the nodes outside the cover, whose edges all lead into it: an assignment for each type."""
        total, kinds = sum(hits(e) for e in useful if e[0] in where and e[2] in where), {}
        for n in sorted({x for e in useful for x in (e[0], e[2])} - where.keys()):
            kinds.setdefault(nodes_a[n], []).append(n)
        for kind, rows in kinds.items():
            columns = [m for m in range(len(nodes_b)) if nodes_b[m] == kind and m not in used]
            gain = []
            for n in rows:
                own = [e for e in a.at[n] if e in useful]
                gain.append([sum(min(a.edges[e], b.edges[(m if e[0] == n else where[e[0]], e[1], m if e[2] == n else where[e[2]])]) for e in own) for m in columns])
            if columns and len(rows) > len(columns):
                gain = [list(column) for column in zip(*gain, strict=True)]
            total += assignment(gain) if columns else 0
        return total

    def search(i: int) -> bool:
        """Whether the bound of all has been reached."""
        nonlocal best
        if bound() <= best:
            return False
        if i == len(cover):
            best = max(best, rest())
            return best == most
        n = cover[i]
        for m in images(n):
            where[n] = m
            if m is not None:
                used.add(m)
                busy[part[m]] += 1
            done = search(i + 1)
            if m is not None:
                used.discard(m)
                busy[part[m]] -= 1
            del where[n]
            if done:
                return True
        return False

    most = bound()
    search(0)
    return matched, max(best, 0)


def _rank(b: _Side, part: list[int], m: int) -> str:
    """The place of a node in its part's shape: the shape with the node marked."""
    if not hasattr(b, "ranks"):
        b.ranks = {}
    if m not in b.ranks:
        own = [n for n in range(len(b.nodes)) if part[n] == part[m]]
        place = {n: i for i, n in enumerate(own)}
        edges = [(place[s], k, place[t]) for n in own for s, k, t in b.at[n] if s == n for _ in range(b.edges[(s, k, t)])]
        b.ranks[m] = canonical.form([b.nodes[n] + ("*" if n == m else "") for n in own], edges)
    return b.ranks[m]


def align(pairs: DataFrame) -> DataFrame:
    """pairs: (id, p_nodes, p_edges, g_nodes, g_edges), edges as arrays of `source label target`; adds the matches and sizes."""
    cols = ["p_nodes", "p_edges", "g_nodes", "g_edges"]

    @F.arrow_udf("struct<m_nodes:int,m_edges:int>")
    def run(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        def split(edges):
            return [(int(s), t, int(o)) for s, t, o in (e.split(" ") for e in edges)]

        out = [best_alignment(w, split(x), y, split(z)) for w, x, y, z in zip(*(k.to_pylist() for k in (a, b, c, d)), strict=True)]
        return pa.array([{"m_nodes": n, "m_edges": e} for n, e in out], pa.struct([("m_nodes", pa.int32()), ("m_edges", pa.int32())]))

    return pairs.withColumn("m", run(*map(F.col, cols))).select("id", F.size("p_nodes").alias("pred_nodes"), F.size("p_edges").alias("pred_edges"), F.size("g_nodes").alias("gold_nodes"), F.size("g_edges").alias("gold_edges"), "m.m_nodes", "m.m_edges")


def listed(nodes: Column | str = "nodes", edges: Column | str = "edges") -> tuple[Column, Column]:
    """A row's graph as align() takes it: its nodes' types, and edges as `source label target` by place."""
    nodes, edges = (F.col(c) if isinstance(c, str) else c for c in (nodes, edges))
    ids = F.transform(nodes, lambda n: n["node_id"])

    def place(end):
        return (F.array_position(ids, end) - 1).cast("string")

    return F.transform(nodes, lambda n: n["node_type"]), F.transform(edges, lambda e: F.concat_ws(" ", place(e["src"]), e["edge_type"], place(e["tgt"])))
