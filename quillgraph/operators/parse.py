"""Texts to typed graphs with sentence provenance.

Everything about a text is computed within its row by array expressions, so that parsing is a narrow transformation: one
scan, no shuffle, and only then are nodes and edges exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.rules import ATTACH

NODE = "struct<node_id:string,node_type:string,node_ord:int,sent_idx:int>"
_STEP = 16


#: What a sentence that says anything has in it, in lower case.
SPOKEN = "collect|personal information|consent|sign up|process|parental|withdraw|sell|retain|retention|stored|use your|uses your|using your"


def marks(sentences: Column, spoken: bool = False) -> Column:
    """For each sentence, or only for those that say anything, what its words say. A sentence is lowered once."""

    def mark(x):
        low, i = x["low"], x["i"]
        retain = T.any_of(low, ("retain", "retention", "stored"))
        endless = T.any_of(low, ("indefinit", "as long as", "no expir"))
        parental = T.any_of(low, ("parental", "holder of parental responsibility"))
        withdraw = low.contains("withdraw")
        return F.struct(
            i.alias("i"),
            (T.any_of(low, ("collect", "personal information", "consent", "sign up", "process")) | parental | withdraw).alias("backbone"),
            parental.alias("parental"),
            withdraw.alias("withdraw"),
            (low.contains("sell") & T.any_of(low, ("third part", "advertising", "partners"))).alias("sale"),
            retain.alias("retain"),
            (retain & endless).alias("endless"),
            (retain & ~endless & low.rlike(r"\b\d+\s*(month|year|day)")).alias("bounded"),
            (T.any_of(low, ("we ", "our service", "our app", "the operator", "the company", "this service", "this app")) & T.any_of(low, ("process", "collect", "use your", "uses your", "using your"))).alias("operates"),
        )

    lowered = F.transform(sentences, lambda s, i: F.struct(i.alias("i"), F.lower(s).alias("low")))
    return F.transform(F.filter(lowered, lambda x: x["low"].rlike(SPOKEN)) if spoken else lowered, mark)


def parsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", permits: bool = False) -> DataFrame:
    """The documents with sentences, marks, and backbone: the first sentence that speaks of data or consent, or null."""
    d = docs.withColumn("sentences", T.sentences(F.col(text_col))).withColumn("marks", marks(F.col("sentences"), spoken=True))
    first = F.filter("marks", lambda m: m["backbone"] | (m["operates"] if permits else F.lit(False)))
    return d.withColumn("backbone", F.try_element_at(F.transform(first, lambda m: m["i"]), F.lit(1)))


def _node(kind: str, node_type: str, m: Column, place: int) -> Column:
    return F.struct(F.concat(F.lit(kind), m["i"].cast("string")).alias("node_id"), F.lit(node_type).alias("node_type"), (m["i"] * _STEP + place).cast("int").alias("node_ord"), m["i"].cast("int").alias("sent_idx"))


def _edge(kind: str, edge_type: str, src: Column, tgt: Column, m: Column, place: int) -> Column:
    return F.struct(F.concat(F.lit(kind), m["i"].cast("string")).alias("edge_id"), src.alias("src"), tgt.alias("tgt"), F.lit(edge_type).alias("edge_type"), (m["i"] * _STEP + place).cast("int").alias("edge_ord"), m["i"].cast("int").alias("sent_idx"))


def _some(*pairs) -> Column:
    """The structs whose condition holds."""
    return F.filter(F.array(*[F.when(on, x) for on, x in pairs]), lambda x: x.isNotNull())


def node_array(permits: bool = False) -> Column:
    """A parsed document's nodes (node_id, node_type, node_ord, sent_idx) in the order in which a reader meets them."""

    def of(m):
        at = (F.col("backbone") == m["i"]) & F.col("backbone").isNotNull()
        found = [
            (at, _node("ds", "DataSubject", m, 0)),
            (at, _node("cp", "ConsentProcess", m, 1)),
            (at, _node("dp", "DataProcessing", m, 2)),
            (m["parental"], _node("pc", "ParentalConsent", m, 3)),
            (m["withdraw"], _node("w", "Withdrawal", m, 4)),
            (m["sale"], _node("op", "Operator", m, 5)),
            (m["sale"], _node("tp", "ThirdParty", m, 6)),
            (m["retain"], _node("rc", "RetentionClause", m, 8)),
            (m["endless"], _node("di", "DurationIndefinite", m, 9)),
            (m["bounded"], _node("db", "DurationBounded", m, 10)),
        ]
        if permits:
            found.append((m["operates"], _node("oq", "Operator", m, 7)))
        return _some(*found)

    return F.flatten(F.transform("marks", of))


def edge_array(permits: bool = False) -> Column:
    """Its edges (edge_id, src, tgt, edge_type, edge_ord, sent_idx)."""
    core = F.col("backbone").cast("string")

    def of(m):
        own = m["i"].cast("string")
        at = (F.col("backbone") == m["i"]) & F.col("backbone").isNotNull()

        def name(kind, x=own):
            return F.concat(F.lit(kind), x)

        found = [
            (at, _edge("ea", "subjectOf", name("ds"), name("cp"), m, 0)),
            (at, _edge("eb", "grants", name("cp"), name("dp"), m, 1)),
            (m["parental"], _edge("ec", "requires", name("cp", core), name("pc"), m, 2)),
            (m["withdraw"], _edge("ed", "permits", name("cp", core), name("w"), m, 3)),
            (m["sale"], _edge("ee", "sellsTo", name("op"), name("tp"), m, 4)),
            (m["endless"], _edge("eg", "hasDuration", name("rc"), name("di"), m, 6)),
            (m["bounded"], _edge("eh", "hasDuration", name("rc"), name("db"), m, 7)),
        ]
        if permits:
            found.append((m["operates"], _edge("ef", "permits", name("oq"), name("dp", core), m, 5)))
        return _some(*found)

    return F.flatten(F.transform("marks", of))


#: The types that each kind of edge connects, by the beginning of its id.
ENDS = {"ea": ("DataSubject", "ConsentProcess"), "eb": ("ConsentProcess", "DataProcessing"), "ec": ("ConsentProcess", "ParentalConsent"), "ed": ("ConsentProcess", "Withdrawal"), "ee": ("Operator", "ThirdParty"), "ef": ("Operator", "DataProcessing"), "eg": ("RetentionClause", "DurationIndefinite"), "eh": ("RetentionClause", "DurationBounded")}


def typed_edge_array(permits: bool = False) -> Column:
    """Its edges as (src_type, edge_type, tgt_type, sent_idx)."""

    def typed(e):
        kind, (src, tgt) = F.substring(e["edge_id"], 1, 2), (F.lit(None).cast("string"),) * 2
        for k, (a, b) in ENDS.items():
            src, tgt = F.when(kind == k, a).otherwise(src), F.when(kind == k, b).otherwise(tgt)
        return F.struct(src.alias("src_type"), e["edge_type"].alias("edge_type"), tgt.alias("tgt_type"), e["sent_idx"].alias("sent_idx"))

    return F.transform(edge_array(permits), typed)


def parse_nodes(p: DataFrame, id_col: str = "doc_id", permits: bool = False) -> DataFrame:
    return p.select(id_col, F.explode(node_array(permits)).alias("n")).select(id_col, "n.*")


def parse_edges(p: DataFrame, id_col: str = "doc_id", permits: bool = False) -> DataFrame:
    return p.select(id_col, F.explode(edge_array(permits)).alias("e")).select(id_col, "e.*")


def graph_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", permits: bool = False) -> tuple[DataFrame, DataFrame]:
    p = parsed(docs, id_col, text_col, permits)
    return parse_nodes(p, id_col, permits), parse_edges(p, id_col, permits)


def typed_edges(nodes: DataFrame, edges: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The edges with the types of their ends."""
    s = nodes.select(id_col, F.col("node_id").alias("src"), F.col("node_type").alias("src_type"))
    t = nodes.select(id_col, F.col("node_id").alias("tgt"), F.col("node_type").alias("tgt_type"))
    return edges.join(s, [id_col, "src"]).join(t, [id_col, "tgt"])


def attach_table(spark) -> DataFrame:
    return spark.createDataFrame(ATTACH, "src_type string, edge_type string, tgt_type string")


def topology_violations(typed: DataFrame) -> DataFrame:
    """Edges that connect types in a way that isn't admissible."""
    return typed.join(F.broadcast(attach_table(typed.sparkSession)), ["src_type", "edge_type", "tgt_type"], "left_anti")


def canonical_edges(typed: DataFrame) -> DataFrame:
    """The approved equivalences applied: one turns an edge round, one renames it; neither makes what the other takes."""
    turn = (F.col("src_type") == "DataProcessing") & (F.col("edge_type") == "subjectOf") & (F.col("tgt_type") == "DataSubject")
    rename = (F.col("src_type") == "ConsentProcess") & (F.col("edge_type") == "permits") & (F.col("tgt_type") == "DataProcessing")
    swap = {a: F.when(turn, F.col(b)).otherwise(F.col(a)) for a, b in (("src", "tgt"), ("tgt", "src"), ("src_type", "tgt_type"), ("tgt_type", "src_type"))}
    return typed.withColumns(swap | {"edge_type": F.when(rename, "grants").otherwise(F.col("edge_type"))})


def drop_negated(edges: DataFrame, sentences: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Without edges that their own sentence denies. sentences: (id, sent_idx, sentence)."""
    joined = edges.join(sentences, [id_col, "sent_idx"], "left")
    denied = F.lit(False)
    for kind in T.PREDICATES:
        denied = F.when(F.col("edge_type") == kind, T.negated(F.col("sentence"), kind)).otherwise(denied)
    return joined.filter(~F.coalesce(denied, F.lit(False))).select(*edges.columns)
