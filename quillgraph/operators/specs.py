"""Rule proposals as JSON: typed validation, refinement over rounds, and texts parsed by a completion table.

A completion table holds what a language model answered; nothing here calls one. Answers that don't hold are errors in a
column, never exceptions, so that a batch of proposals is one narrow stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.rules import ATTACH, EDGE_TYPES, NODE_TYPES
from . import parse

_GRAPH = "struct<nodes:array<struct<id:string,type:string>>,edges:array<struct<id:string,src:string,tgt:string,type:string>>>"
SPEC = f"struct<name:string,L:{_GRAPH},R:{_GRAPH},nac:{_GRAPH},age_op:string,age:int,jurisdiction:string,template:string,confidence:string>"
PARSE = "struct<nodes:array<struct<id:int,type:string,sent:int>>,edges:array<struct<src:int,tgt:int,type:string,sent:int>>>"
ROUNDS = 3


def _side_error(spec: Column, side: str) -> Column:
    """The first fault of a side: a type that the schema doesn't have, or an edge to a node that isn't declared."""
    g = spec[side]
    nodes, edges = (F.coalesce(g[k], F.expr(f"cast(array() as array<{t}>)")) for k, t in (("nodes", "struct<id:string,type:string>"), ("edges", "struct<id:string,src:string,tgt:string,type:string>")))
    ids = F.transform(nodes, lambda n: n["id"])
    return (
        F.when(F.exists(nodes, lambda n: n["type"].isNull() | ~n["type"].isin(*NODE_TYPES)), f"{side}: off-schema node type")
        .when(F.exists(edges, lambda e: e["type"].isNull() | ~e["type"].isin(*EDGE_TYPES)), f"{side}: off-schema edge type")
        .when(F.exists(edges, lambda e: ~F.coalesce(F.array_contains(ids, e["src"]) & F.array_contains(ids, e["tgt"]), F.lit(False))), f"{side}: undeclared endpoint")
    )


def validated(answers: DataFrame, response: str = "response") -> DataFrame:
    """The answers with spec, the JSON object in them, and error, null for a rule that holds: what is kept has the same type on both sides."""
    d = answers.withColumn("spec", F.from_json(T.json_object(F.col(response)), SPEC))
    spec = F.col("spec")
    kept = F.exists(spec["L"]["nodes"], lambda a: F.exists(spec["R"]["nodes"], lambda b: (a["id"] == b["id"]) & (a["type"] != b["type"])))
    absent = spec.isNull() | spec["L"].isNull() | spec["R"].isNull()
    error = F.when(absent, "no rule").otherwise(F.coalesce(*[_side_error(spec, s) for s in ("L", "R", "nac")], F.when(kept, "kept node changes type")))
    return d.withColumn("error", error)


def rules_of(cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The proposals (hash, source, name, confidence) of a cache whose specs hold, and (hash, source, error) of the others."""
    d = validated(cache, "spec_json")
    return d.filter("error is null").select("hash", "source", F.col("spec.name").alias("name"), T.confidence(F.col("spec.confidence")).alias("confidence")), d.filter("error is not null").select("hash", "source", "error")


def refined(answers: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """(key, round, error): the first round whose answer holds, or the last one's error. answers: (key, round, response), rounds from 0.

    Each round's prompt would name the error of the one before; with a table of answers that is one pass over all rounds.
    """
    d = validated(answers.filter(F.col("round") < rounds))
    first = F.min(F.when(F.col("error").isNull(), F.col("round")))
    last = F.max_by(F.struct("round", "error"), "round")
    g = d.groupBy(key).agg(first.alias("good"), last.alias("last"))
    return g.select(key, F.coalesce("good", "last.round").alias("round"), F.when(F.col("good").isNull(), F.col("last.error")).alias("error"))


def _read(response: Column) -> Column:
    """The graph in an answer; null where there is none."""
    g = F.from_json(T.json_object(response), PARSE)
    return F.when(g["nodes"].isNotNull() & g["edges"].isNotNull(), g)


def _said_edges(g: Column) -> Column:
    """A model's edges between nodes that it named, of types that the schema has, which their own sentence doesn't deny, with ok: whether they
    connect types in an admissible way. sentences must be a column."""

    def typed(e):
        def end(k):
            return F.try_element_at(F.transform(F.filter(g["nodes"], lambda n: n["id"] == e[k]), lambda n: n["type"]), F.lit(1))

        return F.struct(end("src").alias("src_type"), e["type"].alias("edge_type"), end("tgt").alias("tgt_type"), e["sent"].alias("sent_idx"))

    def denied(e):
        said, out = F.get("sentences", e["sent_idx"]), F.lit(False)
        for kind in T.PREDICATES:
            out = F.when(e["edge_type"] == kind, T.negated(said, kind)).otherwise(out)
        return F.coalesce(out, F.lit(False))

    def known(e):
        return F.coalesce(e["src_type"].isin(*NODE_TYPES) & e["edge_type"].isin(*EDGE_TYPES) & e["tgt_type"].isin(*NODE_TYPES), F.lit(False))

    admissible = F.array(*[F.struct(*map(F.lit, t)) for t in ATTACH])

    def ok(e):
        return F.exists(admissible, lambda a: (a["col1"] == e["src_type"]) & (a["col2"] == e["edge_type"]) & (a["col3"] == e["tgt_type"]))

    own = F.filter(F.transform(g["edges"], typed), lambda e: known(e) & ~denied(e))
    return F.transform(own, lambda e: F.struct(e["src_type"].alias("src_type"), e["edge_type"].alias("edge_type"), e["tgt_type"].alias("tgt_type"), e["sent_idx"].alias("sent_idx"), ok(e).alias("ok")))


def model_parsed(docs: DataFrame, answers: DataFrame, id_col: str = "doc_id", text_col: str = "text", attempts: int = 3, repairs: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(id, fallback, src_type, edge_type, tgt_type, sent_idx) of each document's edges, as a model parsed it. answers: (id, attempt, response).

    The first attempt that is a graph counts; a document without one is parsed by keywords, and that is its fallback. Of a model's
    edges those go whose ends or types aren't in the schema, which their own sentence denies, or which connect types in a way
    that isn't admissible. Keyword edges aren't looked at again.

    repairs: (id, round, response), rounds from 1: answers to being told of inadmissible edges. While a graph has some, the next
    round's answer takes its place, until there is none that is a graph, or rounds are over; then the column rounds says how many
    were asked for.
    """
    d = answers.filter(F.col("attempt") < attempts).withColumn("g", _read(F.col("response"))).filter("g is not null")
    first = d.groupBy(id_col).agg(F.min_by("g", "attempt").alias("g"))
    p = parse.parsed(docs, id_col, text_col).join(first, id_col, "left").withColumn("fallback", F.col("g").isNull())
    keep = [id_col, "fallback"]
    if repairs is None:
        p = p.withColumn("said", _said_edges(F.col("g")))
    else:
        given = repairs.filter(F.col("round").between(1, rounds)).groupBy(id_col, "round").agg(F.max("response").alias("response")).withColumn("g", _read(F.col("response")))
        later = given.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("round", "g"))).alias("later"))
        p = p.join(later, id_col, "left")
        p = p.withColumn("asked", F.lit(0)).withColumn("open", ~F.col("fallback"))
        for r in range(1, rounds + 1):
            # A round is asked for where the graph so far has an inadmissible edge, and counts where it is a graph.
            bad = F.col("open") & F.exists(_said_edges(F.col("g")), lambda e: ~e["ok"])
            p = p.withColumn("bad", bad).withColumn("asked", F.col("asked") + F.col("bad").cast("int"))
            new = F.try_element_at("later", F.lit(r))
            p = p.withColumn("new", F.when(F.col("bad"), new)).withColumn("open", F.col("new").isNotNull()).withColumn("g", F.coalesce("new", "g")).drop("new", "bad")
        p = p.withColumn("said", _said_edges(F.col("g"))).withColumnRenamed("asked", "rounds")
        keep.append("rounds")
    good = F.transform(F.filter("said", lambda e: e["ok"]), lambda e: F.struct(*[e[c].alias(c) for c in ("src_type", "edge_type", "tgt_type", "sent_idx")]))
    return p.select(*keep, F.explode(F.when(F.col("fallback"), parse.typed_edge_array()).otherwise(good)).alias("e")).select(*keep, "e.*")


#: Prompts of the arms that a model answers; {} is the document's request, its age and its place.
PROMPTS = {
    "unconstrained": "Write a privacy notice. Request: {} Reader: age {}, {}.",
    "few_shot": "Here are two notices that keep the law. Write one like them. Request: {} Reader: age {}, {}.",
    "critique": "Write a privacy notice, say what is wrong with it, and end with REVISED: and the notice mended. Request: {} Reader: age {}, {}.",
}


def prompts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with a prompt column for each arm, of a request cut to what a prompt may hold."""
    def fill(x):
        a, b, c, d = x.split("{}")
        return F.concat(F.lit(a), F.substring(text_col, 1, T.PROMPTED), F.lit(b), F.col("age").cast("string"), F.lit(c), F.col("jurisdiction"), F.lit(d))

    return docs.withColumns({f"prompt_{k}": fill(x) for k, x in PROMPTS.items()})


def arms(drafts: DataFrame, repaired: DataFrame, again: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, arm, output) of all arms; an output that isn't on record is null, which isn't the same as an empty one.

    drafts: (key, unconstrained, few_shot, critique), the answers on record; repaired: (key, flagged, scored_text) of the draft's
    repair; again: (key, regenerated), answers to a second request. A draft that nothing flags is its own regeneration.
    """
    d = drafts.join(repaired, key, "left").join(again, key, "left")
    outputs = {
        "unconstrained": F.col("unconstrained"),
        "few_shot": F.col("few_shot"),
        "critique": T.after_marker(F.col("critique")),
        "regenerate": F.when(F.col("flagged"), F.col("regenerated")).otherwise(F.col("unconstrained")),
        "flag_only": F.when(~F.col("flagged"), F.col("unconstrained")),
        "repair": F.col("scored_text"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("arm"), x.alias("output")) for k, x in outputs.items()])
    return d.select(key, F.explode(rows).alias("a")).select(key, "a.*")
