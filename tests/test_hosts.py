"""Firings told to rules by their guards, and patterns on one large host, by brute force."""

import random
from collections import Counter
from itertools import product

import pytest

from quillgraph.operators import census, large
from quillgraph.plans.rules import AGES, JURISDICTIONS, Guard, Rule, pattern
from quillgraph.spaces import VARIANTS


def rule(name, source, guard):
    return Rule(name, pattern("a:A;"), pattern(";"), (), guard, None, None, source)


RULES = [rule("x", str(i), g) for i, g in enumerate([Guard("<", 13, frozenset({"EU", "UK"})), Guard(">=", 16), Guard("==", 14, frozenset({"US"})), Guard(None, None, frozenset({"EU"})), Guard(">", 100), Guard(None, 5, frozenset({"UK"})), Guard("<=", 3)])] + [rule("y", "only", Guard())] + [rule("z", "nowhere", Guard("<", 0))]


def test_firings_by_content(spark):
    contexts = [(n, a, j) for n, a, j in product("xyzw", [*AGES][::3] + [13, 14, 16, 120], [*JURISDICTIONS, "XX"])]
    rows = [(i, *c) for i, c in enumerate(contexts)] + [(1, "x", 14, "US"), (2, "x", None, "EU"), (3, "x", 9, None), (4, None, 9, "EU")]
    firings = spark.createDataFrame(rows, "doc_id bigint, rule string, age int, jurisdiction string").repartition(3)
    got = Counter((r["doc_id"], r["rule"], r["age"], r["jurisdiction"], r["status"], r["source"]) for r in census.resolved(firings, RULES).collect())

    def told(i, name, age, place):
        fits = [r.source for r in RULES if r.name == name and age is not None and place is not None and r.guard.holds(age, place)]
        if place is None and age is not None:  # a place that isn't known is in no guard but those for any
            fits = [r.source for r in RULES if r.name == name and r.guard.places is None and r.guard.holds(age, "")]
        return i, name, age, place, "resolved" if len(fits) == 1 else "ambiguous" if fits else "unresolved", fits[0] if len(fits) == 1 else None

    assert got == Counter(told(*r) for r in rows)
    counted = census.census(firings, RULES).collect()
    assert sum(r["n"] for r in counted) == len(rows)
    assert {(r["rule"], r["source"]) for r in counted if r["status"] == "never"} == {("z", "nowhere")} | {(r.name, r.source) for r in RULES} - {(k[1], k[5]) for k in got} - {("z", "nowhere")}
    assert {r["status"] for r in census.census(firings.limit(0), RULES).collect()} == {"never"}
    assert len({r.content_hash for r in VARIANTS}) == len(VARIANTS)


@pytest.mark.parametrize("part", [2, 8, 1024])
def test_triangles(spark, part):
    rng = random.Random(part)
    nodes = [None, *range(12)]
    hot = [(0, i) for i in range(60)]
    tables = []
    for more in (hot, [(b, a) for a, b in hot], hot):
        own = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(90)] + more
        tables.append(own + own[:20])  # repeated edges
    ab, bc, ac = tables
    made = [spark.createDataFrame(t, f"{c[0]} bigint, {c[1]} bigint") for t, c in zip(tables, ("ab", "bc", "ac"), strict=True)]
    got = [tuple(r) for r in large.triangles(*made, part=part).collect()]
    want = {(a, b, c) for a, b in set(ab) for x, c in set(bc) if x == b and (a, c) in set(ac) and None not in (a, b, c)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    _, held = large.adjacency(made[2], "a", "c", part)
    whole = {n: {o for x, o in ac if x == n} - {None} for n in range(12)}
    assert all(sorted(r["others"]) == r["others"] for r in held.collect())
    assert Counter(r["node"] for r in held.collect())[0] > (1 if part == 2 else 0)
    assert {n: o for n, o in whole.items() if o} == {n: {o for r in held.collect() if r["node"] == n for o in r["others"]} for n in {r["node"] for r in held.collect()}}
    paths = {r["b"]: r["n"] for r in large.path_counts(made[0], made[1]).collect()}
    every = Counter(b for a, b in set(ab) for x, c in set(bc) if b == x and None not in (a, b, c))
    assert paths == dict(every)
    assert large.triangles(made[0].limit(0), made[1], made[2]).count() == 0
