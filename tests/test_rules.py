"""Certification of rules: golden tables, unit rules, invariants."""

import itertools
import random

import pytest

from quillgraph.plans import certify, kernel
from quillgraph.plans.rules import LIBRARY, PROBES, RULES, Guard, Pattern, Rule, pattern
from quillgraph.sources import fixtures


def test_content_hashes_order_the_library():
    assert [RULES[n].content_hash[:12] for n in ("r_SALE", "r_WD", "r_RET", "r_PC")] == ["1b817d0ff2b7", "a648260c943d", "c087c5dc608e", "c7e1d006348e"]
    assert RULES["r_FLIP1"].content_hash[:12] == "0aa329be9719" and RULES["r_FLIP2"].content_hash[:12] == "4e9087029aef"


@pytest.mark.parametrize("mechanisms, rejected, unsound", [(certify.CREATION, [1, 1, 0, 0], [0, 2, 1, 3]), (certify.MECHANISMS, [2, 2, 0, 0], [0, 1, 1, 3])])
def test_ablation_grid(mechanisms, rejected, unsound):
    rows = certify.ablation(LIBRARY + PROBES, fixtures.host_graphs(), mechanisms)
    assert [r["strat_reject"] for r in rows] == rejected
    assert [r["unsound"] for r in rows] == unsound
    assert [r["nonterm"] for r in rows] == [0, 0, 0, 1]
    assert [round(r["repair_ok"], 2) for r in rows] == [1.0, 1.0, 1.0, 0.93]
    assert [r["median_cascade"] for r in rows] == [1, 1, None, None]


def test_steps_on_every_host():
    log = certify.admit(LIBRARY + PROBES)
    ran = certify.repair(certify.certified(log), fixtures.host_graphs())["hosts"]
    for name, _, _, _, steps in fixtures.HOSTS:
        assert len(ran[name][1]) == steps, name


def test_first_matches_on_hosts():
    for name, context, graph, expected, _ in fixtures.HOSTS[:10]:
        found = {r.name for r, _, _ in kernel.steps(list(LIBRARY), graph, context)}
        assert found == expected, name


def test_admission_does_not_depend_on_the_order():
    names = ["r_PC", "r_WD", "r_SALE", "r_RET", "r_BAD"]
    for order in itertools.islice(itertools.permutations(names), 0, None, 11):
        log = certify.admit([RULES[n] for n in order])
        assert [r.name for r in certify.certified(log)] == ["r_SALE", "r_WD", "r_RET", "r_PC"]
        assert [d.rule.name for d in log if d.status == "reject:non-joinable-CP"] == ["r_BAD"]


def test_unit_rules():
    foo = Rule("foo", pattern("a:Foo;"), pattern("a:Foo b:Bar;"), (pattern("a:Foo b2:Bar;"),), confidence=0.5)
    bar = Rule("bar", pattern("x:Bar;"), pattern(";"), confidence=0.4)
    assert certify.depends(foo, bar) and not certify.depends(bar, bar, certify.CREATION)
    assert certify.depends(bar, foo)  # takes the witness of foo's condition away
    apart = Rule("apart", pattern("x:Bar;"), pattern(";"), (), Guard(None, None, frozenset({"UK"})))
    here = Rule("here", pattern("a:Foo;"), pattern("a:Foo b:Bar;"), (), Guard(None, None, frozenset({"EU"})))
    assert not certify.depends(here, apart)
    vacuous = Rule("vacuous", pattern("a:Foo;"), pattern(";"), (Pattern(),))
    assert [d.status for d in certify.admit([vacuous])] == ["reject:vacuous-nac"]
    idle = Rule("idle", pattern("a:Foo;"), pattern("a:Foo b:Bar;"))
    assert certify.admit([idle])[0].detail["reason"] == "r1"
    log = certify.admit([RULES["r_FLIP1"], RULES["r_FLIP2"]])
    assert sum(d.status == "reject:no-measure" for d in log) == 1 and [d.detail for d in log if d.detail][0]["reason"] == "cycle"


def test_empty_graphs_are_falsy_by_convention():
    assert kernel.isomorphism(Pattern(), Pattern()) == {}
    assert not kernel.same(Pattern(), Pattern())


def test_context_cells():
    cells = certify.context_cells(list(LIBRARY))
    assert [(c[0], c[1], c[2], len(c[3])) for c in cells] == [("US", 0, 15, 1), ("US", 16, 120, 0), ("EU", 0, 15, 5), ("EU", 16, 120, 3), ("UK", 0, 120, 0), ("US-CA", 0, 120, 0)]
    assert certify.representatives(list(LIBRARY)) == [(0, "US"), (0, "EU"), (16, "EU")]


def test_normal_forms_have_no_step():
    rng = random.Random(1)
    rules = certify.certified(certify.admit(LIBRARY))
    for _ in range(20):
        parts = rng.sample(["DS:DataSubject", "CP:ConsentProcess", "OP:Operator", "TP:ThirdParty", "RC:RetentionClause", "DI:DurationIndefinite"], 5)
        ids = {p.split(":")[0] for p in parts}
        edges = [e for e in ("a:DS>CP:subjectOf", "b:OP>TP:sellsTo", "c:RC>DI:hasDuration") if set(e.split(":")[1].split(">")) <= ids]
        graph = pattern(" ".join(parts) + "; " + " ".join(edges))
        for form, _ in kernel.normal_forms(rules, graph):
            assert not list(kernel.steps(rules, form))


def test_instances_within_types_of_new_elements():
    """On the library, by brute force over the patterns' parts."""
    every = list(LIBRARY + PROBES)
    for r in every:
        for q in every:
            offered = {r.right.nodes[n]: certify._ends(r.right, n) for n in r.made_nodes}
            by_node = any(t in offered and certify._ends(q.left, n) <= offered[t] for n, t in q.left.nodes.items())
            new = {t for _, _, t in r.right.edges.values()} - {t for _, _, t in r.left.edges.values()}
            by_edge = any(t in new and q.left.nodes[s] in r.right.nodes.values() and q.left.nodes[o] in r.right.nodes.values() for s, o, t in q.left.edges.values())
            assert certify.completes(r, q) == (by_node or by_edge)
    loop = certify._ends(pattern("a:A; e:a>a:x"), "a")
    assert loop == {("out", "x", "A")}


def test_cycles_are_broken_by_rules_that_never_fired():
    flips = [r for r in PROBES if r.name.startswith("r_FLIP")]
    assert certify.break_cycles(flips, set()) in (["r_FLIP1"], ["r_FLIP2"])
    assert certify.break_cycles(flips, {"r_FLIP1"}) == ["r_FLIP2"]
    assert certify.break_cycles(flips, {"r_FLIP1", "r_FLIP2"}) is None
    assert certify.break_cycles(list(LIBRARY), set()) == []


def test_feedback_set_against_every_subset():
    rng = random.Random(5)
    for _ in range(60):
        nodes = list(range(5))
        after = {n: [m for m in nodes if m != n and rng.random() < 0.3] for n in nodes}
        allowed = {n for n in nodes if rng.random() < 0.7}

        def free(gone, after=after):
            left = [n for n in nodes if n not in gone]
            walks = {n: set(after[n]) & set(left) for n in left}
            for _ in left:
                walks = {n: w | {x for m in w for x in walks[m]} for n, w in walks.items()}
            return all(n not in w for n, w in walks.items())

        sizes = [bin(k).count("1") for k in range(32) if free({n for n in nodes if k >> n & 1}) and {n for n in nodes if k >> n & 1} <= allowed]
        got = certify.feedback_set(nodes, after, allowed)
        assert (got is None) == (not sizes) and (got is None or free(set(got)) and set(got) <= allowed and len(got) == min(sizes))


def test_cost_trace_looks_at_pairs():
    log = certify.admit(LIBRARY + PROBES)
    assert any(d.pairs for d in log) and all(d.pairs == 0 for d in log if d.status == "reject:no-measure")
