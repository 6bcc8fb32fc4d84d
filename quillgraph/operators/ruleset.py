"""Rule sets as tables: contexts, dependencies, ranks, critical pairs, admission, coverage and audits.

Rules are few and contexts are 484, so these joins are small; what is joined to data is broadcast because it is bounded by
the number of rules.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import certify, kernel
from ..plans.rules import AGES, JURISDICTIONS, LIBRARY, PROBES, rule_tables
from . import align, parse, stats
from .rewrite import kept


def tables(spark: SparkSession, rules=LIBRARY + PROBES) -> dict[str, DataFrame]:
    return rule_tables(spark, rules)


# ---- contexts


def contexts(spark: SparkSession) -> DataFrame:
    places = spark.createDataFrame([(j,) for j in JURISDICTIONS], "jurisdiction string")
    return spark.range(len(AGES)).select(F.col("id").cast("int").alias("age")).crossJoin(F.broadcast(places))


def active(spark: SparkSession, rules) -> DataFrame:
    """(rule_id, rule, age, jurisdiction): where each rule's guard holds."""
    every = contexts(spark)
    return reduce(DataFrame.unionByName, [every.filter(r.guard.column()).select(F.lit(i).alias("rule_id"), F.lit(r.name).alias("rule"), "age", "jurisdiction") for i, r in enumerate(rules)])


def context_cells(spark: SparkSession, rules) -> DataFrame:
    """(jurisdiction, age_lo, age_hi, rules): longest runs of ages with the same rules active."""
    sig = contexts(spark).join(active(spark, rules), ["age", "jurisdiction"], "left").groupBy("age", "jurisdiction").agg(F.array_join(F.array_sort(F.collect_list("rule")), ",").alias("rules"))
    w = Window.partitionBy("jurisdiction").orderBy("age")
    starts = sig.withColumn("s", F.when(F.col("rules").eqNullSafe(F.lag("rules").over(w)), 0).otherwise(1))
    cells = starts.withColumn("cell", F.sum("s").over(w))
    return cells.groupBy("jurisdiction", "cell", "rules").agg(F.min("age").alias("age_lo"), F.max("age").alias("age_hi")).select("jurisdiction", "age_lo", "age_hi", "rules")


def jointly_satisfiable(act: DataFrame) -> DataFrame:
    """(a, b): names of rules that are active together somewhere."""
    x, y = act.select(F.col("rule").alias("a"), "age", "jurisdiction"), act.select(F.col("rule").alias("b"), "age", "jurisdiction")
    return x.join(y, ["age", "jurisdiction"]).select("a", "b").distinct()


# ---- properties of single rules


def modality(t: dict[str, DataFrame]) -> DataFrame:
    """From the parts alone: what the left side has and the right side lacks goes, and the other way round."""
    elems = t["rule_node"].select("rule_id", "part", F.lit("n").alias("k"), "elem_id").unionByName(t["rule_edge"].select("rule_id", "part", F.lit("e").alias("k"), "elem_id"))
    left, right = elems.filter("part = 'L'").drop("part"), elems.filter("part = 'R'").drop("part")
    gone = left.join(right, ["rule_id", "k", "elem_id"], "left_anti").select("rule_id").distinct().withColumn("gone", F.lit(True))
    made = right.join(left, ["rule_id", "k", "elem_id"], "left_anti").select("rule_id").distinct().withColumn("made", F.lit(True))
    kind = F.when(F.col("gone") & F.col("made"), "substitutive").when(F.col("gone"), "subtractive").otherwise("additive")
    return t["rule"].join(gone, "rule_id", "left").join(made, "rule_id", "left").select(F.col("name").alias("rule"), kind.alias("modality"))


def _extra(t: dict[str, DataFrame], what: str, kind: str) -> DataFrame:
    """(rule_id, type) of what negative conditions add, by id."""
    e = t[what]
    return e.filter("part like 'NAC%'").join(e.filter("part = 'L'").select("rule_id", "elem_id"), ["rule_id", "elem_id"], "left_anti").select("rule_id", F.col(kind).alias("type")).distinct()


def _lost(t: dict[str, DataFrame], what: str) -> DataFrame:
    e = t[what]
    return e.filter("part = 'L'").join(e.filter("part = 'R'").select("rule_id", "elem_id"), ["rule_id", "elem_id"], "left_anti")


def discharges(t: dict[str, DataFrame]) -> DataFrame:
    made = t["rule_edge"].filter("part = 'R'").select("rule_id", F.col("edge_type").alias("type")).distinct()
    ok = _lost(t, "rule_node").select("rule_id").unionByName(_lost(t, "rule_edge").select("rule_id")).unionByName(_extra(t, "rule_edge", "edge_type").join(made, ["rule_id", "type"], "left_semi").select("rule_id")).distinct().withColumn("ok", F.lit(True))
    return t["rule"].join(ok, "rule_id", "left").select(F.col("name").alias("rule"), F.coalesce("ok", F.lit(False)).alias("discharges"))


def vacuous(t: dict[str, DataFrame], nacs: DataFrame | None = None) -> DataFrame:
    """Rules with a negative condition that asks for nothing. nacs: (rule_id, part) of all conditions, if some may be empty."""
    there = t["rule_node"].select("rule_id", "part").unionByName(t["rule_edge"].select("rule_id", "part")).filter("part like 'NAC%'").distinct()
    none = (there if nacs is None else nacs).join(there, ["rule_id", "part"], "left_anti").select("rule_id").distinct().withColumn("none", F.lit(True))
    return t["rule"].join(none, "rule_id", "left").select(F.col("name").alias("rule"), F.coalesce("none", F.lit(False)).alias("vacuous"))


# ---- dependencies and ranks


def dependencies(spark: SparkSession, rules, mechanisms=certify.MECHANISMS) -> DataFrame:
    """(rule, enables, mechanism) between different rules whose guards can hold together, by type sets."""
    t = tables(spark, rules)
    n, e = t["rule_node"].withColumnRenamed("node_type", "type"), t["rule_edge"].withColumnRenamed("edge_type", "type")

    def types(part):
        return n.filter(F.col("part") == part).select("rule_id", F.concat(F.lit("n:"), "type").alias("type")).unionByName(e.filter(F.col("part") == part).select("rule_id", F.concat(F.lit("e:"), "type").alias("type"))).distinct()

    left, right = types("L"), types("R")
    lost_n, lost_e = _lost(t, "rule_node").withColumnRenamed("node_type", "type"), _lost(t, "rule_edge").withColumnRenamed("edge_type", "type")
    lost = lost_n.select("rule_id", F.concat(F.lit("n:"), "type").alias("type")).unionByName(lost_e.select("rule_id", F.concat(F.lit("e:"), "type").alias("type"))).distinct()
    more = _extra(t, "rule_node", "node_type").select("rule_id", F.concat(F.lit("n:"), "type").alias("type")).unionByName(_extra(t, "rule_edge", "edge_type").select("rule_id", F.concat(F.lit("e:"), "type").alias("type")))
    kinds = n.filter("part = 'L'").select("rule_id", "elem_id", "type")
    ends = lost_e.select("rule_id", F.explode(F.array("src", "tgt")).alias("elem_id")).join(kinds, ["rule_id", "elem_id"]).select("rule_id", "type").distinct()

    def meet(a, b, name):
        return a.join(b.select(F.col("rule_id").alias("other"), "type"), "type").select("rule_id", "other", F.lit(name).alias("mechanism"))

    found = {"creates": meet(right.join(left, ["rule_id", "type"], "left_anti"), left, "creates"), "frees": meet(lost, more, "frees"), "releases": meet(ends, lost_n.select("rule_id", "type"), "releases")}
    pairs = reduce(DataFrame.unionByName, [found[m] for m in sorted(mechanisms)]).filter("rule_id <> other").distinct()
    act = active(spark, rules)
    together = act.join(act.select(F.col("rule_id").alias("other"), "age", "jurisdiction"), ["age", "jurisdiction"]).select("rule_id", "other").distinct()
    name = t["rule"].select("rule_id", F.col("name").alias("rule"))
    other = t["rule"].select(F.col("rule_id").alias("other"), F.col("name").alias("enables"))
    return pairs.join(together, ["rule_id", "other"], "left_semi").join(name, "rule_id").join(other, "other").select("rule", "enables", "mechanism")


def instance_dependencies(spark: SparkSession, rules) -> DataFrame:
    """(rule, enables): dependencies by created elements that fit into another rule's left side with their edges, a narrower
    reading than the mechanism `creates` (certify.completes says how)."""
    t = tables(spark, rules)
    n, e = t["rule_node"], t["rule_edge"]
    key = ["rule_id", "part", "elem_id"]
    far = n.select("rule_id", "part", F.col("elem_id").alias("far"), F.col("node_type").alias("far_type"))
    sides = e.select("rule_id", "part", F.explode(F.array(F.struct(F.lit("out").alias("way"), F.col("src").alias("elem_id"), F.col("tgt").alias("far")), F.struct(F.lit("in").alias("way"), F.col("tgt").alias("elem_id"), F.col("src").alias("far")))).alias("s"), "edge_type", (F.col("src") == F.col("tgt")).alias("loop"))
    ends = sides.filter("not (loop and s.way = 'in')").select("rule_id", "part", "s.elem_id", "s.far", "s.way", "edge_type").join(far, ["rule_id", "part", "far"], "left")
    has = ends.groupBy(*key).agg(F.collect_set(F.concat_ws(" ", "way", "edge_type", "far_type")).alias("has"))
    full = n.join(has, key, "left").select(*key, "node_type", F.coalesce("has", F.array().cast("array<string>")).alias("has"))
    made = full.filter("part = 'R'").join(n.filter("part = 'L'").select("rule_id", "elem_id"), ["rule_id", "elem_id"], "left_anti").select("rule_id", "node_type", F.col("has").alias("offers"))
    asked = full.filter("part = 'L'").select(F.col("rule_id").alias("other"), "node_type", "has")
    by_node = made.join(asked, "node_type").filter(F.size(F.array_except("has", "offers")) == 0).select("rule_id", "other")
    edges = e.filter("part = 'R'").select("rule_id", "edge_type").distinct()
    fresh = edges.join(e.filter("part = 'L'").select("rule_id", "edge_type"), ["rule_id", "edge_type"], "left_anti")
    kinds = n.filter("part = 'L'").select(F.col("rule_id").alias("other"), "elem_id", "node_type")
    left = e.filter("part = 'L'").select(F.col("rule_id").alias("other"), "src", "tgt", "edge_type")
    for end in ("src", "tgt"):
        left = left.join(kinds.select("other", F.col("elem_id").alias(end), F.col("node_type").alias(f"{end}_type")), ["other", end])
    there = n.filter("part = 'R'").select("rule_id", "node_type").distinct()
    by_edge = fresh.join(left, "edge_type")
    for end in ("src", "tgt"):
        by_edge = by_edge.join(there.withColumnRenamed("node_type", f"{end}_type"), ["rule_id", f"{end}_type"], "left_semi")
    act = active(spark, rules)
    together = act.join(act.select(F.col("rule_id").alias("other"), "age", "jurisdiction"), ["age", "jurisdiction"]).select("rule_id", "other").distinct()
    name = t["rule"].select("rule_id", F.col("name").alias("rule"))
    other = t["rule"].select(F.col("rule_id").alias("other"), F.col("name").alias("enables"))
    found = by_node.unionByName(by_edge.select("rule_id", "other")).filter("rule_id <> other").distinct()
    return found.join(together, ["rule_id", "other"], "left_semi").join(name, "rule_id").join(other, "other").select("rule", "enables")


def ranks(deps: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """(rule, rank) by peeling rules off that depend on none that is left; rules on or behind a cycle have no row."""
    left = t["rule"].select(F.col("name").alias("rule"))
    edges = deps.select("rule", "enables").distinct()
    out, level, n = None, 0, left.count()
    while n:
        blocked = edges.join(left.select(F.col("rule").alias("enables")), "enables", "left_semi").select("rule").distinct()
        ready = kept(left.join(blocked, "rule", "left_anti").withColumn("rank", F.lit(level)), "ranks")
        if ready.isEmpty():
            break
        out = ready if out is None else out.unionByName(ready)
        left, level = kept(left.join(ready, "rule", "left_anti"), "unranked"), level + 1
        n = left.count()
    return out


def per_cell(spark: SparkSession, rules) -> DataFrame:
    """(jurisdiction, age_lo, age_hi, rules, acyclic): each context cell, and whether the rules active there can't enable each other in a circle."""
    cells = kept(context_cells(spark, rules), "cells")
    deps = dependencies(spark, rules).select("rule", "enables").distinct()
    inside = cells.select("jurisdiction", "age_lo", F.split("rules", ",").alias("own")).crossJoin(F.broadcast(deps)).filter(F.array_contains("own", F.col("rule")) & F.array_contains("own", F.col("enables")))
    step = kept(inside.select("jurisdiction", "age_lo", "rule", "enables"), "cell-steps")
    reach, n = step, step.count()
    while True:  # at most as many rounds as a library has rules
        more = reach.join(step.select("jurisdiction", "age_lo", F.col("rule").alias("enables"), F.col("enables").alias("further")), ["jurisdiction", "age_lo", "enables"]).select("jurisdiction", "age_lo", "rule", F.col("further").alias("enables"))
        reach = kept(reach.unionByName(more).distinct(), "cell-reach")
        if (now := reach.count()) == n:
            break
        n = now
    circles = reach.filter("rule = enables").select("jurisdiction", "age_lo").distinct().withColumn("circle", F.lit(True))
    return cells.join(circles, ["jurisdiction", "age_lo"], "left").select("jurisdiction", "age_lo", "age_hi", "rules", F.col("circle").isNull().alias("acyclic"))


def produce_forbid(t: dict[str, DataFrame]) -> DataFrame:
    """(rule, forbids, type): rules whose right side has an edge type that another rule's negative condition forbids."""
    made = t["rule_edge"].filter("part = 'R'").select("rule_id", F.col("edge_type").alias("type")).distinct()
    asked = _extra(t, "rule_edge", "edge_type").select(F.col("rule_id").alias("other"), "type")
    name = t["rule"].select("rule_id", F.col("name").alias("rule"))
    other = t["rule"].select(F.col("rule_id").alias("other"), F.col("name").alias("forbids"))
    return made.join(asked, "type").filter("rule_id <> other").join(name, "rule_id").join(other, "other").select("rule", "forbids", "type").distinct()


def sublibrary(spark: SparkSession, rules) -> DataFrame:
    """(rules, all_discharge, acyclic, depth) of a part of a library, taken by itself."""
    t = tables(spark, rules)
    ranked = ranks(dependencies(spark, rules), t)
    g = discharges(t).agg(F.count("*").alias("rules"), F.bool_and("discharges").alias("all_discharge"))
    return g.crossJoin(ranked.agg(F.count("*").alias("k"), F.max("rank").alias("depth"))).select("rules", "all_discharge", (F.col("k") == F.col("rules")).alias("acyclic"), "depth")


def emittable(typed: DataFrame) -> DataFrame:
    """(src_type, edge_type, tgt_type, admissible, emitted): what the schema admits against what the parser made."""
    cols = ["src_type", "edge_type", "tgt_type"]
    a = parse.attach_table(typed.sparkSession).withColumn("admissible", F.lit(True))
    m = typed.select(*cols).distinct().withColumn("emitted", F.lit(True))
    return a.join(m, cols, "full_outer").select(*cols, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("admissible", "emitted")])


def critical_pairs(spark: SparkSession, rules) -> DataFrame:
    """(a, b, pairs, joinable): of each two rules, one pair a row of a task."""
    rules = list(rules)
    places = [(i, j, rules[i].name, rules[j].name) for i in range(len(rules)) for j in range(i, len(rules))]

    def count(batches):
        for batch in batches:
            rows = []
            for i, j, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = kernel.critical_pairs(rules[i], rules[j])
                both = [rules[i]] if i == j else [rules[i], rules[j]]
                try:
                    good = all(kernel.joinable(p, both) for p in found)
                except kernel.Exhausted:
                    good = False
                rows.append((a, b, len(found), good))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.bool_()), strict=True)], names=["a", "b", "pairs", "joinable"])

    return spark.createDataFrame(places, "i int, j int, a string, b string").repartition(8).mapInArrow(count, "a string, b string, pairs int, joinable boolean")


def admit_log(spark: SparkSession, rules, **options) -> DataFrame:
    """(ord, rule, status, rank, modality, detail)."""
    log = certify.admit(rules, **options)
    rows = [(i, d.rule.name, d.status, d.rank, d.rule.modality if d.status == "admit" else None, (d.detail or {}).get("reason") or (d.detail or {}).get("peer")) for i, d in enumerate(log)]
    return spark.createDataFrame(rows, "ord int, rule string, status string, rank int, modality string, detail string")


def cost_trace(spark: SparkSession, rules, **options) -> DataFrame:
    """(ord, rule, left_edges, status, pairs, seconds): what the check for confluence cost for each rule."""
    log = certify.admit(rules, **options)
    rows = [(i, d.rule.name, len(d.rule.left.edges), d.status, d.pairs, d.seconds) for i, d in enumerate(log)]
    return spark.createDataFrame(rows, "ord int, rule string, left_edges int, status string, pairs int, seconds double")


def rejection_rates(spark: SparkSession, rules) -> DataFrame:
    """(reading, n, rejected): rules without a rank when creation is read by types and by instances."""
    rules = list(rules)
    got = [(name, len(rules), sum(v is None for v in certify.stratify(rules, m).rank.values())) for name, m in (("type", certify.CREATION), ("instance", certify.INSTANCES))]
    return spark.createDataFrame(got, "reading string, n int, rejected int")


def admission_funnel(log: DataFrame) -> DataFrame:
    """log: (source, status). Counts by source, and their TOTAL."""
    s = F.col("status")
    g = log.rollup("source").agg(F.count("*").alias("proposed"), F.count_if(s == "admit").alias("certified"), F.count_if(s == "reject:no-measure").alias("strat_rejected"), F.count_if(s.endswith("CP")).alias("cp_rejected"))
    return g.select(F.coalesce("source", F.lit("TOTAL")).alias("source"), "proposed", "certified", "strat_rejected", "cp_rejected")


# ---- coverage


def codes(spark: SparkSession) -> DataFrame:
    """(code, jurisdiction, age_lt, topic): where a violation code applies."""
    rows = [("PC", "EU", 16, "consent"), ("WD", "EU", None, "withdrawal"), ("SALE", "US", 16, "sale"), ("RET", "EU", None, "retention"), ("AADC", "UK", 18, "design")]
    return spark.createDataFrame(rows, "code string, jurisdiction string, age_lt int, topic string")


#: Words of a rule's template that tell its topic, in order.
TOPICS = (("consent", ("parental",)), ("withdrawal", ("withdraw",)), ("sale", ("sell",)), ("retention", ("no longer than",)))


def topic_of(template) -> F.Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(TOPICS):
        hit = reduce(lambda x, w: x | F.lower(template).contains(w), words, F.lit(False))
        out = F.when(hit, name).otherwise(out)
    return out


def coverage_map(codes_: DataFrame, rules) -> DataFrame:
    """(code, n_rules, rules): rules of the code's topic that are active somewhere the code applies."""
    spark = codes_.sparkSession
    act = active(spark, rules).select("rule", "age", "jurisdiction")
    topics = tables(spark, rules)["rule"].select(F.col("name").alias("rule"), topic_of(F.col("template")).alias("topic"))
    c = codes_.select("code", "age_lt", "topic", "jurisdiction")
    hits = act.join(topics, "rule").join(c, ["topic", "jurisdiction"]).filter("age_lt is null or age < age_lt").select("code", "rule").distinct()
    g = hits.groupBy("code").agg(F.count("*").alias("n_rules"), F.array_join(F.array_sort(F.collect_list("rule")), ",").alias("rules"))
    return codes_.select("code").join(g, "code", "left").select("code", F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"), F.coalesce("rules", F.lit("")).alias("rules"))


# ---- graphs


def components(nodes: DataFrame, edges: DataFrame, key: str = "doc_id", most: int = 1000) -> DataFrame:
    """(key, node_id, component): the least node id that can be reached; labels pass along edges until none changes."""
    both = kept(edges.select(key, F.col("src").alias("node_id"), F.col("tgt").alias("to")).unionByName(edges.select(key, F.col("tgt").alias("node_id"), F.col("src").alias("to"))).distinct(), "both-ways")
    label = nodes.select(key, "node_id", F.col("node_id").alias("component"))
    for _ in range(most):
        sent = both.join(label.select(key, F.col("node_id").alias("to"), F.col("component").alias("c")), [key, "to"]).groupBy(key, "node_id").agg(F.min("c").alias("c"))
        step = kept(label.join(sent, [key, "node_id"], "left").withColumn("changed", F.col("c") < F.col("component")).select(key, "node_id", F.least("component", "c").alias("component"), "changed"), "labels")
        label = step.drop("changed")
        if step.filter("changed").isEmpty():
            return label
    raise RuntimeError(f"components took more than {most} rounds")


def arrangement_conflicts(typed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(a, b, arrangements, listed, n_docs): pairs of types that are connected in more than one way."""
    d = typed.select(F.least("src_type", "tgt_type").alias("a"), F.greatest("src_type", "tgt_type").alias("b"), F.concat_ws(" ", "src_type", "edge_type", "tgt_type").alias("arr"), key)
    # Arrangements are few: types, not documents, are gathered.
    g = d.groupBy("a", "b").agg(F.array_sort(F.collect_set("arr")).alias("ways"), F.count_distinct(key).alias("n_docs"))
    return g.filter(F.size("ways") > 1).select("a", "b", F.size("ways").cast("long").alias("arrangements"), F.array_join("ways", "; ").alias("listed"), "n_docs")


def parser_scores(gold: DataFrame) -> DataFrame:
    """(part, matched, predicted, gold, p, r, f1) of the keyword parser over gold texts, by exact alignment."""
    docs = gold.select(F.col("id").alias("doc_id"), "text")
    nodes, edges = parse.graph_of(docs)
    w = Window.partitionBy("doc_id").orderBy("node_ord")
    placed = nodes.withColumn("pos", F.row_number().over(w) - 1)
    n = placed.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_type"))), lambda x: x["node_type"]).alias("p_nodes"))
    s = placed.select("doc_id", F.col("node_id").alias("src"), F.col("pos").alias("s"))
    t = placed.select("doc_id", F.col("node_id").alias("tgt"), F.col("pos").alias("t"))
    e = edges.join(s, ["doc_id", "src"]).join(t, ["doc_id", "tgt"]).groupBy("doc_id").agg(F.collect_list(F.concat_ws(" ", F.col("s").cast("string"), "edge_type", F.col("t").cast("string"))).alias("p_edges"))
    none = F.array().cast("array<string>")
    pairs = gold.join(n, gold["id"] == n["doc_id"], "left").drop("doc_id").join(e, F.col("id") == e["doc_id"], "left").select("id", F.coalesce("p_nodes", none).alias("p_nodes"), F.coalesce("p_edges", none).alias("p_edges"), "g_nodes", "g_edges")
    m = align.align(pairs).agg(*[F.sum(c).alias(c) for c in ("pred_nodes", "pred_edges", "gold_nodes", "gold_edges", "m_nodes", "m_edges")])
    parts = [("instances", "m_nodes", "pred_nodes", "gold_nodes"), ("relations", "m_edges", "pred_edges", "gold_edges")]
    rows = F.array(*[F.struct(F.lit(k).alias("part"), F.col(a).alias("matched"), F.col(b).alias("predicted"), F.col(c).alias("gold")) for k, a, b, c in parts], F.struct(F.lit("all").alias("part"), (F.col("m_nodes") + F.col("m_edges")).alias("matched"), (F.col("pred_nodes") + F.col("pred_edges")).alias("predicted"), (F.col("gold_nodes") + F.col("gold_edges")).alias("gold")))
    d = m.select(F.explode(rows).alias("x")).select("x.*")
    p, r, f1 = stats.prf(*(F.col(c).cast("double") for c in ("matched", "predicted", "gold")))
    return d.select("part", *[F.col(c).cast("int").alias(c) for c in ("matched", "predicted", "gold")], F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(f1, 6).alias("f1"))


# ---- libraries


def verdict_filter(spark: SparkSession, rules, verdicts: DataFrame, accepted=("yes", "partial")) -> DataFrame:
    """(rule, verdict) of the rules that reviewers accepted."""
    names = spark.createDataFrame([(r.name,) for r in rules], "rule string")
    return names.join(F.broadcast(verdicts.select("rule", "verdict")), "rule", "left").withColumn("verdict", F.coalesce("verdict", F.lit("unrated"))).filter(F.col("verdict").isin(*accepted))


def template_override(spark: SparkSession, rules, instead: DataFrame) -> DataFrame:
    """(rule, template) with corrected templates; an error for a correction of a rule that isn't there."""
    own = spark.createDataFrame([(r.name, r.template) for r in rules], "rule string, template string")
    joined = own.join(F.broadcast(instead), "rule", "full_outer")
    known = F.when(F.col("template").isNull() & F.col("instead").isNotNull(), F.raise_error(F.concat(F.lit("no such rule: "), "rule"))).otherwise(F.coalesce("instead", "template"))
    return joined.select("rule", known.alias("template"))
