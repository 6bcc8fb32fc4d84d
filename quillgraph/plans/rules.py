"""Rewrite rules as declarative plans: patterns, guards, and the built-in library."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The closed vocabulary, the admissible connections, the approved equivalences, and the context domain.
NODE_TYPES = ("DataSubject", "ConsentProcess", "DataProcessing", "ParentalConsent", "Withdrawal", "Operator", "ThirdParty", "RetentionClause", "DurationIndefinite", "DurationBounded")
EDGE_TYPES = ("subjectOf", "grants", "requires", "permits", "sellsTo", "hasDuration")
ATTACH = (
    ("DataSubject", "subjectOf", "ConsentProcess"),
    ("ConsentProcess", "grants", "DataProcessing"),
    ("ConsentProcess", "permits", "Withdrawal"),
    ("ConsentProcess", "requires", "ParentalConsent"),
    ("RetentionClause", "hasDuration", "DurationBounded"),
    ("RetentionClause", "hasDuration", "DurationIndefinite"),
    ("Operator", "sellsTo", "ThirdParty"),
)
EQUIVALENCES = (
    (("DataProcessing", "subjectOf", "DataSubject"), ("DataSubject", "subjectOf", "DataProcessing")),
    (("ConsentProcess", "permits", "DataProcessing"), ("ConsentProcess", "grants", "DataProcessing")),
)
JURISDICTIONS = ("US", "EU", "UK", "US-CA")
AGES = range(121)
GRID = tuple((a, j) for a in (9, 15, 21) for j in ("US", "EU", "UK"))


@dataclass(frozen=True)
class Pattern:
    nodes: dict[str, str] = field(default_factory=dict)  # id -> type
    edges: dict[str, tuple[str, str, str]] = field(default_factory=dict)  # id -> source, target, type

    @property
    def edge_types(self) -> set[str]:
        return {t for _, _, t in self.edges.values()}

    @property
    def node_types(self) -> set[str]:
        return set(self.nodes.values())

    def signature(self):
        triples = ((self.nodes.get(s), t, self.nodes.get(o)) for s, o, t in self.edges.values())
        return tuple(sorted(self.nodes.values())), tuple(sorted(triples))


def pattern(text: str) -> Pattern:
    """`a:Type b:Type; e:a>b:edgeType` to a pattern."""
    nodes, _, edges = text.partition(";")
    found = (re.fullmatch(r"(\w+):(\w+)>(\w+):(\w+)", e) for e in edges.split())
    return Pattern(dict(n.split(":") for n in nodes.split()), {m[1]: (m[2], m[3], m[4]) for m in found})


@dataclass(frozen=True)
class Guard:
    """A condition on (age, jurisdiction); None: any."""

    op: str | None = None
    age: int | None = None
    places: frozenset[str] | None = None

    def holds(self, age: int, place: str) -> bool:
        if self.places is not None and place not in self.places:
            return False
        if self.op is None or self.age is None:
            return True
        return {"<": age < self.age, "<=": age <= self.age, ">": age > self.age, ">=": age >= self.age, "==": age == self.age}[self.op]

    def column(self, age="age", place="jurisdiction"):
        out = F.lit(True)
        if self.places is not None:
            out &= F.col(place).isin(sorted(self.places))
        if self.op is not None and self.age is not None:
            a = F.col(age)
            out &= {"<": a < self.age, "<=": a <= self.age, ">": a > self.age, ">=": a >= self.age, "==": a == self.age}[self.op]
        return out

    def overlaps(self, other: Guard) -> bool:
        return any(self.holds(a, j) and other.holds(a, j) for j in JURISDICTIONS for a in AGES)


@dataclass(frozen=True)
class Rule:
    """What both sides share by id is kept; the rest of the left side is deleted, the rest of the right side is made."""

    name: str
    left: Pattern
    right: Pattern
    nacs: tuple[Pattern, ...] = ()
    guard: Guard = Guard()
    template: str | None = None
    confidence: float | None = None
    source: str | None = None

    @property
    def kept_nodes(self) -> set[str]:
        return self.left.nodes.keys() & self.right.nodes.keys()

    @property
    def kept_edges(self) -> set[str]:
        return self.left.edges.keys() & self.right.edges.keys()

    @property
    def deleted_nodes(self) -> list[str]:
        return [n for n in self.left.nodes if n not in self.kept_nodes]

    @property
    def deleted_edges(self) -> list[str]:
        return [e for e in self.left.edges if e not in self.kept_edges]

    @property
    def made_nodes(self) -> list[str]:
        return [n for n in self.right.nodes if n not in self.kept_nodes]

    @property
    def made_edges(self) -> list[str]:
        return [e for e in self.right.edges if e not in self.kept_edges]

    @property
    def modality(self) -> str:
        gone, made = self.deleted_nodes or self.deleted_edges, self.made_nodes or self.made_edges
        return "substitutive" if gone and made else "subtractive" if gone else "additive"

    def extra(self, nac: Pattern) -> Pattern:
        """What a negative condition asks for beyond the left side, by id."""
        return Pattern({n: t for n, t in nac.nodes.items() if n not in self.left.nodes}, {e: x for e, x in nac.edges.items() if e not in self.left.edges})

    @property
    def content_hash(self) -> str:
        parts = (self.left.signature(), self.right.signature(), len(self.kept_nodes), len(self.kept_edges), len(self.nacs), self.name, self.source)
        return hashlib.sha256(repr(parts).encode()).hexdigest()

    @property
    def vacuous(self) -> bool:
        return any(not nac.nodes and not nac.edges for nac in self.nacs)

    @property
    def discharges(self) -> bool:
        """Firing the rule removes the match that it fired on."""
        return bool(self.deleted_nodes or self.deleted_edges) or any(self.extra(nac).edge_types & self.right.edge_types for nac in self.nacs)


_EU, _YOUNG_EU, _EU_UK = Guard(None, None, frozenset({"EU"})), Guard("<", 16, frozenset({"EU"})), Guard(None, None, frozenset({"EU", "UK"}))
_BACKBONE = "DS:DataSubject CP:ConsentProcess; e1:DS>CP:subjectOf"

#: The library's patterns, guards, confidences and template sentences.
LIBRARY = (
    Rule("r_PC", pattern(_BACKBONE), pattern("DS:DataSubject CP:ConsentProcess PC:ParentalConsent; e1:DS>CP:subjectOf e2:CP>PC:requires"), (pattern("DS:DataSubject CP:ConsentProcess PCn:ParentalConsent; e1:DS>CP:subjectOf na:CP>PCn:requires"),), _YOUNG_EU, "Because you are under 16, this consent must be given or authorised by the holder of parental responsibility (GDPR Art. 8).", 1.0),
    Rule("r_WD", pattern("CP:ConsentProcess;"), pattern("CP:ConsentProcess W:Withdrawal; e2:CP>W:permits"), (pattern("CP:ConsentProcess Wn:Withdrawal; na:CP>Wn:permits"),), _EU, "You may withdraw your consent at any time (GDPR Art. 7(3)).", 1.0),
    Rule("r_SALE", pattern("OP:Operator TP:ThirdParty; e1:OP>TP:sellsTo"), pattern("OP:Operator TP:ThirdParty;"), (), Guard("<", 16, frozenset({"EU", "US"})), "We do not sell or share your personal information with third parties for their own marketing purposes.", 1.0),
    Rule("r_RET", pattern("RC:RetentionClause DI:DurationIndefinite; e1:RC>DI:hasDuration"), pattern("RC:RetentionClause DB:DurationBounded; e2:RC>DB:hasDuration"), (pattern("RC:RetentionClause DBn:DurationBounded; na:RC>DBn:hasDuration"),), _EU, "We retain it for no longer than 24 months, after which it is erased (GDPR Art. 5(1)(e)).", 1.0),
    Rule("r_NOTIFY", pattern("RC:RetentionClause DB:DurationBounded; e1:RC>DB:hasDuration"), pattern("RC:RetentionClause DB:DurationBounded N:Notification; e1:RC>DB:hasDuration e2:RC>N:notifies"), (pattern("RC:RetentionClause DB:DurationBounded Nn:Notification; e1:RC>DB:hasDuration na:RC>Nn:notifies"),), _EU, "We will notify you that your data's retention period is now bounded to 24 months.", 1.0),
)
PROBES = (
    Rule("r_BAD", pattern(_BACKBONE), pattern("DS:DataSubject;"), (), _YOUNG_EU, None, 0.0),
    Rule("r_RET_BAD", pattern("RC:RetentionClause DI:DurationIndefinite; e1:RC>DI:hasDuration"), pattern("RC:RetentionClause;"), (), _EU_UK, None, 0.0),
    Rule("r_FLIP1", pattern("A:TagA;"), pattern("B:TagB;")),
    Rule("r_FLIP2", pattern("B:TagB;"), pattern("A:TagA;")),
)
RULES = {r.name: r for r in LIBRARY + PROBES}


def rule_tables(spark: SparkSession, rules=LIBRARY + PROBES) -> dict[str, DataFrame]:
    """The rules as tables: rule, rule_node and rule_edge (part: L, R, NAC#k), and contexts (rule active at age, jurisdiction)."""
    rule, node, edge = [], [], []
    for i, r in enumerate(rules):
        rule.append((i, r.name, r.content_hash, r.guard.op, r.guard.age, sorted(r.guard.places) if r.guard.places is not None else None, r.template, r.source, r.confidence, r.modality))
        for part, p in [("L", r.left), ("R", r.right), *((f"NAC#{k}", n) for k, n in enumerate(r.nacs))]:
            node += [(i, part, n, t, k) for k, (n, t) in enumerate(p.nodes.items())]
            edge += [(i, part, e, s, o, t, k) for k, (e, (s, o, t)) in enumerate(p.edges.items())]
    return {
        "rule": spark.createDataFrame(rule, "rule_id int, name string, content_hash string, age_op string, age int, jurisdictions array<string>, template string, source string, confidence double, modality string"),
        "rule_node": spark.createDataFrame(node, "rule_id int, part string, elem_id string, node_type string, ord int"),
        "rule_edge": spark.createDataFrame(edge, "rule_id int, part string, elem_id string, src string, tgt string, edge_type string, ord int"),
    }
