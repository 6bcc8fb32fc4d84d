"""Canonical forms of small typed graphs: equal exactly for isomorphic graphs.

A graph is its connected components, each put into its own canonical form, sorted. Within a component colours are refined
until they don't split any more (a node's colour is that of its type, its edges and what they lead to); if some nodes still
share a colour, each node of the first such class in turn gets a colour of its own, and the least form that this leads to is
the component's. Nodes that may be exchanged with one tried before lead to the same form and are passed over, and a class of which
all may be exchanged is numbered in any order, so that a hub of equal leaves takes one way only. This runs inside tasks, on one graph of a row at a time.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from functools import lru_cache

#: A component is (types, edges): the types of its nodes, and its edges as (source, type, target) by place, sorted.
Component = tuple[tuple[str, ...], tuple[tuple[int, str, int], ...]]
#: Forms of components that a task remembers.
REMEMBERED = 1 << 14


def refined(component: Component, colours: list[int]) -> list[int]:
    """The coarsest colours, as ranks, that split the given ones and tell nodes apart by the colours around them."""
    types, edges = component
    count = len(set(colours))
    while True:
        around: list[list] = [[] for _ in types]
        for s, k, t in edges:
            around[s].append((0, k, colours[t]))
            around[t].append((1, k, colours[s]))
        said = [(c, tuple(sorted(a))) for c, a in zip(colours, around, strict=True)]
        rank = {x: i for i, x in enumerate(sorted(set(said)))}
        colours = [rank[x] for x in said]
        if len(rank) == count:
            return colours
        count = len(rank)


def _exchangeable(component: Component, a: int, b: int, edges: Counter) -> bool:
    """Whether the graph stays the same when two nodes of one type change places."""
    other = {a: b, b: a}
    return all(edges[(other.get(s, s), k, other.get(t, t))] == n for (s, k, t), n in edges.items() if s in other or t in other)


def _least(component: Component, colours: list[int], edges: Counter) -> tuple:
    colours = refined(component, colours)
    by: dict[int, list[int]] = {}
    for n, c in enumerate(colours):
        by.setdefault(c, []).append(n)
    shared = next((by[c] for c in sorted(by) if len(by[c]) > 1), None)
    if shared is None:
        types, found = component
        order = sorted(range(len(types)), key=colours.__getitem__)
        return tuple(types[n] for n in order), tuple(sorted((colours[s], k, colours[t]) for s, k, t in found))
    if all(_exchangeable(component, shared[0], n, edges) for n in shared[1:]):
        place = {n: i for i, n in enumerate(shared)}
        return _least(component, [c * len(shared) + place.get(n, 0) for n, c in enumerate(colours)], edges)
    best, tried = None, []
    for n in shared:
        if any(_exchangeable(component, n, m, edges) for m in tried):
            continue
        tried.append(n)
        form = _least(component, [2 * c - (m == n) for m, c in enumerate(colours)], edges)
        best = form if best is None or form < best else best
    return best


@lru_cache(REMEMBERED)
def component_form(component: Component) -> str:
    types, edges = component
    rank = {t: i for i, t in enumerate(sorted(set(types)))}
    return json.dumps(_least(component, [rank[t] for t in types], Counter(edges)))


def components(types: list[str], edges: list[tuple[int, str, int]]) -> list[Component]:
    """The connected components, each with its nodes in the order in which they came."""
    root = list(range(len(types)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for s, _, t in edges:
        root[find(s)] = find(t)
    own: dict[int, list[int]] = {}
    for n in range(len(types)):
        own.setdefault(find(n), []).append(n)
    held: dict[int, list] = {}
    for e in edges:
        held.setdefault(find(e[0]), []).append(e)
    out = []
    for r, nodes in own.items():
        place = {n: i for i, n in enumerate(nodes)}
        out.append((tuple(types[n] for n in nodes), tuple(sorted((place[s], k, place[t]) for s, k, t in held.get(r, [])))))
    return out


def form(types: list[str], edges: list[tuple[int, str, int]]) -> str:
    """The canonical form: equal for two graphs exactly if they are isomorphic, with types and parallel edges."""
    return "\n".join(sorted(component_form(c) for c in components(types, edges)))


def key(graph: str) -> str:
    """The digest of the canonical form of a graph in JSON: {types: [type], edges: [{s, k, t}]}, ends by place from 0."""
    g = json.loads(graph)
    return hashlib.sha256(form(g["types"], [(e["s"], e["k"], e["t"]) for e in g["edges"]]).encode()).hexdigest()
