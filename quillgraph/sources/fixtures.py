"""Small hand-labelled inputs: gold parses of short texts, and host graphs for repair."""

from __future__ import annotations

from ..plans.rules import Pattern

#: Id, text, types of the nodes, edges (source, label, target, by place).
GOLD = [
    (
        "g00",
        "We collect your email address to send you updates. By signing up, you consent to this processing.",
        ["DataSubject", "ConsentProcess", "DataProcessing"],
        [(0, "subjectOf", 1), (1, "grants", 2)],
    ),
    (
        "g01",
        "Where the child is below the age of sixteen, processing is lawful only with consent given by the holder of parental responsibility.",
        ["DataSubject", "ConsentProcess", "DataProcessing", "ParentalConsent"],
        [(0, "subjectOf", 1), (1, "grants", 2), (1, "requires", 3)],
    ),
    (
        "g02",
        "The operator must obtain verifiable parental consent before collecting personal information from a child. Consent may be withdrawn at any time.",
        ["DataSubject", "ConsentProcess", "DataProcessing", "ParentalConsent", "Withdrawal"],
        [(0, "subjectOf", 1), (1, "grants", 2), (1, "requires", 3), (1, "permits", 4)],
    ),
    (
        "g03",
        "We may sell your personal information to selected third-party advertising partners for their own marketing purposes.",
        ["Operator", "ThirdParty"],
        [(0, "sellsTo", 1)],
    ),
    (
        "g04",
        "We collect your email to send updates and we may sell your personal information to advertising partners.",
        ["DataSubject", "ConsentProcess", "DataProcessing", "Operator", "ThirdParty"],
        [(0, "subjectOf", 1), (1, "grants", 2), (3, "sellsTo", 4)],
    ),
    (
        "g05",
        "Your data will be stored securely. We retain it indefinitely.",
        ["RetentionClause", "DurationIndefinite"],
        [(0, "hasDuration", 1)],
    ),
    (
        "g06",
        "Personal information is retained for 12 months and then deleted.",
        ["RetentionClause", "DurationBounded"],
        [(0, "hasDuration", 1)],
    ),
    (
        "g07",
        "By signing up you consent to processing, and you may withdraw your consent at any time.",
        ["DataSubject", "ConsentProcess", "DataProcessing", "Withdrawal"],
        [(0, "subjectOf", 1), (1, "grants", 2), (1, "permits", 3)],
    ),
    (
        "g08",
        "Where the user is under the age of 13, the holder of parental responsibility must consent, data is retained indefinitely, and the operator may sell personal information to partners.",
        ["DataSubject", "ConsentProcess", "DataProcessing", "ParentalConsent", "RetentionClause", "DurationIndefinite", "Operator", "ThirdParty"],
        [(0, "subjectOf", 1), (1, "grants", 2), (1, "requires", 3), (4, "hasDuration", 5), (6, "sellsTo", 7)],
    ),
    (
        "g09",
        "This notice explains our cookie categories and how to manage browser preferences.",
        [],
        [],
    ),
    (
        "g10",
        "We collect personal information to provide the service. You consent to this processing when you create an account. We do not sell your personal information.",
        ["DataSubject", "ConsentProcess", "DataProcessing"],
        [(0, "subjectOf", 1), (1, "grants", 2)],
    ),
    (
        "g11",
        "Consent from the parent is required, data is kept for 24 months, and consent can be withdrawn.",
        ["DataSubject", "ConsentProcess", "DataProcessing", "ParentalConsent", "Withdrawal", "RetentionClause", "DurationBounded"],
        [(0, "subjectOf", 1), (1, "grants", 2), (1, "requires", 3), (1, "permits", 4), (5, "hasDuration", 6)],
    ),
]

#: Id, context, nodes, edges (source, target, type), the rules that match at first, and how many the full pipeline fires.
HOSTS: list[tuple[str, tuple[int, str], Pattern, set[str], int]] = [
    ("h001", (9, "EU"), Pattern({"DS": "DataSubject", "CP": "ConsentProcess"}, {"a": ("DS", "CP", "subjectOf")}), {"r_PC", "r_WD"}, 2),
    ("h002", (15, "EU"), Pattern({"DS": "DataSubject", "CP": "ConsentProcess"}, {"a": ("DS", "CP", "subjectOf")}), {"r_PC", "r_WD"}, 2),
    ("h003", (21, "EU"), Pattern({"CP": "ConsentProcess"}, {}), {"r_WD"}, 1),
    ("h004", (21, "EU"), Pattern({"RC": "RetentionClause", "DI": "DurationIndefinite"}, {"a": ("RC", "DI", "hasDuration")}), {"r_RET"}, 2),
    ("h005", (9, "EU"), Pattern({"DS": "DataSubject", "CP": "ConsentProcess", "OP": "Operator", "TP": "ThirdParty"}, {"a": ("DS", "CP", "subjectOf"), "b": ("OP", "TP", "sellsTo")}), {"r_PC", "r_SALE", "r_WD"}, 3),
    ("h006", (9, "US"), Pattern({"OP": "Operator", "TP": "ThirdParty"}, {"a": ("OP", "TP", "sellsTo")}), {"r_SALE"}, 1),
    ("h007", (15, "EU"), Pattern({"DS": "DataSubject", "CP": "ConsentProcess", "RC": "RetentionClause", "DI": "DurationIndefinite"}, {"a": ("DS", "CP", "subjectOf"), "b": ("RC", "DI", "hasDuration")}), {"r_PC", "r_RET", "r_WD"}, 4),
    ("h008", (15, "US"), Pattern({"OP": "Operator", "TP": "ThirdParty"}, {"a": ("OP", "TP", "sellsTo")}), {"r_SALE"}, 1),
    ("h009", (9, "EU"), Pattern({"DS": "DataSubject", "CP": "ConsentProcess", "PC": "ParentalConsent"}, {"a": ("DS", "CP", "subjectOf"), "b": ("CP", "PC", "requires")}), {"r_WD"}, 1),
    ("h010", (15, "EU"), Pattern({"DS": "DataSubject", "CP": "ConsentProcess", "PC": "ParentalConsent", "W": "Withdrawal", "RC": "RetentionClause", "DI": "DurationIndefinite"}, {"a": ("DS", "CP", "subjectOf"), "b": ("CP", "PC", "requires"), "c": ("CP", "W", "permits"), "d": ("RC", "DI", "hasDuration")}), {"r_RET"}, 2),
    ("probe_001", (9, "EU"), Pattern({"A": "TagA"}, {}), {"r_FLIP1"}, 1),
    ("probe_002", (9, "UK"), Pattern({"RC": "RetentionClause", "DI": "DurationIndefinite"}, {"a": ("RC", "DI", "hasDuration")}), {"r_RET_BAD"}, 0),
    ("probe_003", (15, "UK"), Pattern({"RC": "RetentionClause", "DI": "DurationIndefinite"}, {"a": ("RC", "DI", "hasDuration")}), {"r_RET_BAD"}, 0),
    ("probe_004", (18, "UK"), Pattern({"RC": "RetentionClause", "DI": "DurationIndefinite"}, {"a": ("RC", "DI", "hasDuration")}), {"r_RET_BAD"}, 0),
    ("probe_005", (21, "UK"), Pattern({"RC": "RetentionClause", "DI": "DurationIndefinite"}, {"a": ("RC", "DI", "hasDuration")}), {"r_RET_BAD"}, 0),
]


def host_graphs():
    """(id, graph, context) of every host."""
    return [(k, g, c) for k, c, g, _, _ in HOSTS]


def host_tables(spark):
    """The hosts as tables of nodes, edges and contexts, keyed by doc_id (the host's id)."""
    nodes = [(k, n, t, i, None) for k, _, g, _, _ in HOSTS for i, (n, t) in enumerate(g.nodes.items())]
    edges = [(k, e, s, o, t, i, None) for k, _, g, _, _ in HOSTS for i, (e, (s, o, t)) in enumerate(g.edges.items())]
    return (
        spark.createDataFrame(nodes, "doc_id string, node_id string, node_type string, node_ord int, sent_idx int"),
        spark.createDataFrame(edges, "doc_id string, edge_id string, src string, tgt string, edge_type string, edge_ord int, sent_idx int"),
        spark.createDataFrame([(k, *c) for k, c, _, _, _ in HOSTS], "doc_id string, age int, jurisdiction string"),
    )


def gold_table(spark):
    rows = [(k, text, nodes, [f"{s} {label} {t}" for s, label, t in edges]) for k, text, nodes, edges in GOLD]
    return spark.createDataFrame(rows, "id string, text string, g_nodes array<string>, g_edges array<string>")
