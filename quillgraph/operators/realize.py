"""Applies what rules fired to the sentences, and checks the result by parsing it again.

Templates of additive rules are appended once each, in the order in which they first fired. For each edge that a rule
takes away the sentence that it came from is parsed alone: if that yields an edge of the same types, it is the one; else
the first other sentence that does. The sentence is dropped (subtractive rules, which then also append their template) or
replaced by the template (substitutive ones). Edges made by earlier steps have no sentence and change no text. realize() works on
traces of the join lane, realized() within the rows; tests hold them to the same texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rules import Rule
from . import delta, local, parse


def sentence_signatures(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sent_idx, signature): what each sentence alone would parse to, `source edge target`."""
    p = parse.parsed(docs.select(key, F.posexplode(F.col("sentences")).alias("pos", "one")), key, "one")
    solo = p.withColumn("sid", F.concat_ws("/", F.col(key).cast("string"), F.col("pos").cast("string")))
    m = F.get("marks", 0)
    found = [
        (m["backbone"], "DataSubject subjectOf ConsentProcess"),
        (m["backbone"], "ConsentProcess grants DataProcessing"),
        (m["parental"], "ConsentProcess requires ParentalConsent"),
        (m["withdraw"], "ConsentProcess permits Withdrawal"),
        (m["sale"], "Operator sellsTo ThirdParty"),
        (m["endless"], "RetentionClause hasDuration DurationIndefinite"),
        (m["bounded"], "RetentionClause hasDuration DurationBounded"),
    ]
    each = F.filter(F.array(*[F.when(on, F.lit(x)) for on, x in found]), lambda x: x.isNotNull())
    return solo.select(key, F.col("pos").alias("sent_idx"), F.explode(each).alias("signature"))


def realize(rules: list[Rule], docs: DataFrame, trace: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, output): the text after the repairs of the trace. docs: parsed documents."""
    by = {r.name: r for r in rules}
    cut = [(r.name, e, " ".join((r.left.nodes[r.left.edges[e][0]], r.left.edges[e][2], r.left.nodes[r.left.edges[e][1]])), r.modality, r.template) for r in by.values() if r.modality != "additive" for e in r.deleted_edges]
    spark = docs.sparkSession
    plan = spark.createDataFrame(cut, "rule string, elem string, signature string, modality string, template string")
    signs = sentence_signatures(docs, key)
    asked = trace.join(F.broadcast(plan), "rule").withColumn("attributed", F.col("sents")[F.col("elem")]).filter("attributed is not null")
    # The sentence that the edge came from wins if it bears the signature out, else the first that does.
    found = asked.join(signs, [key, "signature"]).withColumn("own", (F.col("sent_idx") != F.col("attributed")).cast("int"))
    w = Window.partitionBy(key, "step", "rule", "elem").orderBy("own", "sent_idx")
    verified = found.withColumn("k", F.row_number().over(w)).filter("k = 1")
    edits = verified.groupBy(key, "sent_idx").agg(F.max(F.when(F.col("modality") == "subtractive", True)).alias("dropped"), F.max_by(F.when(F.col("modality") == "substitutive", F.col("template")), F.when(F.col("modality") == "substitutive", F.col("step"))).alias("instead"))
    templates = spark.createDataFrame([(r.name, r.template, r.modality) for r in by.values() if r.template], "rule string, template string, modality string")
    claims = trace.join(F.broadcast(templates), "rule").filter("modality = 'additive'").select(key, "step", "template").unionByName(verified.filter("modality = 'subtractive' and template is not null").select(key, "step", "template"))
    once = claims.groupBy(key, "template").agg(F.min("step").alias("step"))
    appended = once.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "template"))), lambda x: x["template"]).alias("appended"))
    lines = docs.select(key, F.posexplode("sentences").alias("sent_idx", "sentence")).join(edits, [key, "sent_idx"], "left").filter("dropped is null")
    body = lines.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", F.coalesce("instead", "sentence").alias("s")))), lambda x: x["s"]).alias("body"))
    empty = F.array().cast("array<string>")
    return docs.select(key).join(body, key, "left").join(appended, key, "left").select(key, F.array_join(F.concat(F.coalesce("body", empty), F.coalesce("appended", empty)), " ").alias("output"))


#: What a sentence's marks say of the edges that it would parse to.
_SAYS = {
    "DataSubject subjectOf ConsentProcess": "backbone",
    "ConsentProcess grants DataProcessing": "backbone",
    "ConsentProcess requires ParentalConsent": "parental",
    "ConsentProcess permits Withdrawal": "withdraw",
    "Operator sellsTo ThirdParty": "sale",
    "RetentionClause hasDuration DurationIndefinite": "endless",
    "RetentionClause hasDuration DurationBounded": "bounded",
}


def _field(name: str):
    return lambda x: x[name]


def realized(rules: list[Rule], rows: DataFrame, every: bool = False) -> DataFrame:
    """The rows with output, the text after the repairs of their traces: realize() for graphs that stand in their row, without a join.
    Templates come in the order in which their rules first fired; with every (see local.normalise), which fires rules side by side, in
    the order of rules."""
    cuts = []
    for r in rules:
        for at, e in enumerate(r.left.edges):
            signature = " ".join((r.left.nodes[r.left.edges[e][0]], r.left.edges[e][2], r.left.nodes[r.left.edges[e][1]]))
            if r.modality != "additive" and e in r.deleted_edges and signature in _SAYS:
                cuts.append((r, at, _SAYS[signature]))
    signs = sorted({sign for *_, sign in cuts})
    d = rows.withColumn("says", parse.marks(F.col("sentences"))).withColumns({f"says_{x}": F.transform("says", _field(x)) for x in signs})

    def edit(t, r, at, sign):
        own, first = F.get(t["sents"], F.lit(at)), F.nullif(F.array_position(F.col(f"says_{sign}"), F.lit(True)), F.lit(0).cast("long"))
        where = F.when(F.get(F.col(f"says_{sign}"), own), own).otherwise((first - 1).cast("int"))
        made = F.struct(where.alias("at"), t["step"].alias("step"), t["rule_ord"].alias("rule_ord"), F.lit(r.modality == "subtractive").alias("gone"), F.lit(r.template).cast("string").alias("template"))
        return F.when((t["rule"] == r.name) & own.isNotNull() & where.isNotNull(), made)

    none = F.array().cast("array<struct<at:int,step:int,rule_ord:int,gone:boolean,template:string>>")
    edits = F.flatten(F.transform("trace", lambda t: F.filter(F.array(*[edit(t, *c) for c in cuts]), lambda x: x.isNotNull()))) if cuts else none
    adding = {r.name: r.template for r in rules if r.modality == "additive" and r.template}
    said = F.lit(None).cast("string")
    templates = F.create_map(*[F.lit(x) for pair in adding.items() for x in pair]) if adding else None

    order_by = ("rule_ord", "step") if every else ("step", "rule_ord")

    def claim(t):
        return F.struct(*[t[k].alias(k) for k in order_by], (templates[t["rule"]] if adding else said).alias("template"))

    d = d.withColumn("edits", edits)
    claims = F.concat(F.transform("trace", claim), F.transform(F.filter("edits", lambda e: e["gone"]), lambda e: F.struct(*[e[k].alias(k) for k in order_by], e["template"].alias("template"))))
    appended = F.array_distinct(F.transform(F.array_sort(F.filter(claims, lambda c: c["template"].isNotNull())), lambda c: c["template"]))
    gone = F.transform(F.filter("edits", lambda e: e["gone"]), lambda e: e["at"])
    d = d.withColumns({"appended": appended, "gone": gone, "swaps": F.filter("edits", lambda e: ~e["gone"])})
    order = F.when(F.size("sentences") > 0, F.array_except(F.sequence(F.lit(0), F.size("sentences") - 1), "gone")).otherwise(F.array().cast("array<int>"))

    def line(i):
        last = F.try_element_at(F.filter("swaps", lambda e: e["at"] == i), F.lit(-1))["template"]
        return F.coalesce(last, F.get("sentences", i))

    body = F.when(F.size("edits") == 0, F.col("sentences")).otherwise(F.transform(order, line))
    return d.withColumn("output", F.array_join(F.concat(body, "appended"), " ")).drop("says", "edits", "appended", "gone", "swaps", *[f"says_{x}" for x in signs])


def process_documents(rules: list[Rule], docs: DataFrame, key: str = "doc_id", text_col: str = "text", every: bool = False) -> DataFrame:
    """Parse, detect, normalise, realize, check: (key, age, jurisdiction, flagged, fired, output, compliant, scored_text). docs: with age and
    jurisdiction; every: as in local.normalise, else one step at a time. Each document stays in its row, so that rows that repeat a key are documents of their
    own."""
    rows = local.graph_rows(docs.select(key, text_col, "age", "jurisdiction"), key, text_col)
    rows = local.normalise(rules, rows, True) if every else delta.normalise(rules, rows)
    out = realized(rules, rows, every).select(key, text_col, "age", "jurisdiction", F.array_join(F.transform("trace", lambda t: t["rule"]), ",").alias("fired"), "output")
    again = local.graph_rows(out, key, "output").withColumn("compliant", F.size(local.all_steps(rules)) == 0)
    return again.select(key, "age", "jurisdiction", (F.col("fired") != "").alias("flagged"), "fired", "output", "compliant", F.when(F.col("compliant"), F.col("output")).otherwise(F.col(text_col)).alias("scored_text"))
