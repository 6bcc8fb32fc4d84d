"""The registered queries of the engine and their SQL for comparison. Tables are read whole; every column is named. Queries on
notices read every document's whole text; what is synthetic about notices is said in operators/notices.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import delta, local, parse, realize, rewrite, sampling, stats
from .operators import ruleset as RS
from .operators.notices import SQL, chain, notices, table
from .plans import certify
from .plans.matcher import applicable_matches
from .plans.rules import LIBRARY, PROBES, RULES
from .sources import files, fixtures

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, on_notices: bool = False):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"with {SQL} {sql}" if on_notices else sql
        return f

    return register


def _n(spark: SparkSession, sf: str) -> DataFrame:
    return notices(table(spark, sf, "documents"))


def _graph(spark: SparkSession, sf: str):
    n = _n(spark, sf)
    nodes, edges = parse.graph_of(n)
    return n, nodes, edges


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    """The graphs of the notices, each in its row. Written out, so that what reads them several times doesn't parse again."""
    return rewrite.kept(local.graph_rows(_n(spark, sf)).drop("text", "sentences"), "graphs")


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, rule) of every possible step, found within the rows."""
    rows = _rows(spark, sf)
    names = F.array(*[F.lit(r.name) for r in LIBRARY])
    return rows.select("doc_id", F.explode(F.transform(local.all_steps(list(LIBRARY)), lambda m: F.element_at(names, m["rule_ord"] + 1))).alias("rule"))


def _big(c: str) -> F.Column:
    return F.col(c).cast("long").alias(c)


# ---- text

_SPLIT = r"string_split(regexp_replace(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '([.!?])\s+', '\1' || chr(30), 'g'), chr(30))"


@query("sentence_split_stats", rf"""
select coalesce(lang, '?') as lang, count(*) as n_docs, sum(k)::bigint as n_sentences, max(k)::bigint as most from (
  select lang, len(list_filter({_SPLIT}, lambda x: trim(x) <> '')) as k from documents where text is not null) group by 1""")
def _(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null").select("lang", F.size(T.sentences(F.col("text"))).alias("k"))
    return d.groupBy(F.coalesce("lang", F.lit("?")).alias("lang")).agg(F.count("*").alias("n_docs"), F.sum("k").cast("long").alias("n_sentences"), F.max("k").cast("long").alias("most"))


@query("clause_split_counts", "select len(list_filter(string_split(regexp_replace(s, '(?i);|,|\\band\\b|\\bbut\\b', chr(30), 'g'), chr(30)), lambda x: trim(x) <> ''))::bigint as clauses, count(*) as n from sent group by 1", True)
def _(spark, sf):
    s = _n(spark, sf).select(F.explode(T.sentences(F.col("text"))).alias("s"))
    return s.groupBy(F.size(T.clauses(F.col("s"))).cast("long").alias("clauses")).agg(F.count("*").alias("n"))


def _negated_sql(kind: str) -> str:
    some = " or ".join(f"contains(c, '{w}')" for w in T.PREDICATES[kind])
    none = " or ".join("contains(c, '" + w.replace("'", "''") + "')" for w in T.NEGATIONS)
    return f"select '{kind}' as edge_type, count(*) as n from sent where len(list_filter(string_split(regexp_replace(low, ';|,|\\band\\b|\\bbut\\b', chr(30), 'g'), chr(30)), lambda c: ({some}) and ({none}))) > 0"


@query("negation_hits", " union all ".join(map(_negated_sql, T.PREDICATES)), True)
def _(spark, sf):
    s = _n(spark, sf).select(F.explode(T.sentences(F.col("text"))).alias("s"))
    flags = s.agg(*[F.sum(T.negated(F.col("s"), k).cast("long")).alias(k) for k in T.PREDICATES])
    return flags.unpivot([], list(T.PREDICATES), "edge_type", "n")


@query("markup_strip", r"""
select page_id, md5(t) as digest, length(t)::bigint as n from (
  select page_id, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') as t from pages)""")
def _(spark, sf):
    d = table(spark, sf, "pages").select("page_id", T.strip_markup(F.col("html")).alias("t"))
    return d.select("page_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@query("entity_normalise", """
select page_id, md5(t) as digest from (select page_id, replace(replace(replace(replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), chr(65279), ''), chr(160), ' ') as t from pages)""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.named_entities(F.col("html"))).alias("digest"))


@query("tau_extract", r"""
select doc_id, coalesce(nullif(regexp_extract(hit, '(?i)(?:under|below)\s+the\s+age\s+of\s+(\d{1,2})', 1), ''), nullif(regexp_extract(hit, '(1[0-9])\s+years', 1), ''))::int as tau
from (select doc_id, regexp_extract(text, '(?i)\b(?:under|below)\s+the\s+age\s+of\s+\d{1,2}|\b1[0-9]\s+years', 0) as hit from notices)""", True)
def _(spark, sf):
    return _n(spark, sf).select("doc_id", T.find_tau(F.col("text")).alias("tau"))


@query("segment_generic", r"""
select doc_id, len(p)::bigint as n_segments, coalesce(list_sum(list_transform(p, lambda x: length(x))), 0)::bigint as n_chars from (
  select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\n\s*\n', chr(30), 'g'), chr(30)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 60) as p from documents where text is not null)""")
def _(spark, sf):
    p = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x) >= T.LEAST_SEGMENT)
    d = table(spark, sf, "documents").filter("text is not null").select("doc_id", p.alias("p"))
    return d.select("doc_id", F.size("p").cast("long").alias("n_segments"), F.aggregate("p", F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("n_chars"))


@query("dewrap_paragraphs", r"""
with l as (select doc_id, i, trim(parts[i], ' ' || chr(9) || chr(13)) as s from (select doc_id, string_split(text, chr(10)) as parts from documents where text is not null), unnest(generate_series(1, len(parts))) as t(i)),
k as (select *, regexp_matches(s, '[.!?:]$')::int as e from l where s <> ''),
p as (select *, coalesce(sum(e) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as par from k)
select doc_id, par::bigint as par, md5(string_agg(s, ' ' order by i)) as digest from p group by doc_id, par""")
def _(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null").select("doc_id", F.posexplode(T.dewrap(F.col("text"))).alias("par", "s"))
    return d.select("doc_id", F.col("par").cast("long").alias("par"), F.md5("s").alias("digest"))


@query("long_span_split", r"""
with s as (select doc_id, '(a) ' || replace(text, '. ', '. (b) ') as t from documents where text is not null),
p as (select doc_id, case when length(t) > 5000 then list_filter(list_transform(string_split(regexp_replace(t, '(\(\w{1,3}\)\s)', chr(30) || '\1', 'g'), chr(30)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 20) else [t] end as p from s)
select doc_id, len(p)::bigint as pieces, coalesce(list_max(list_transform(p, lambda x: length(x))), 0)::bigint as longest from p""")
def _(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null").select("doc_id", T.split_long(F.concat(F.lit("(a) "), F.replace("text", F.lit(". "), F.lit(". (b) ")))).alias("p"))
    return d.select("doc_id", F.size("p").cast("long").alias("pieces"), F.coalesce(F.array_max(F.transform("p", F.length)), F.lit(0)).cast("long").alias("longest"))


@query("jurisdiction_case", """
with s as (select source, case source when 'src0' then 'coppa_2013' when 'src1' then 'gdpr8' when 'src2' then 'ccpa' when 'src3' then 'uk_aadc' when 'src4' then 'OHCHR_crc' else source end as name from documents)
select case when contains(name, 'coppa') then 'US' when contains(name, 'gdpr') then 'EU' when contains(name, 'ccpa') then 'US-CA' when contains(name, 'uk_aadc') then 'UK' when contains(name, 'OHCHR') then 'United Nations' else 'UNKNOWN' end as jurisdiction, count(*) as n from s group by 1""")
def _(spark, sf):
    s, name = F.col("source"), F.col("source")
    for k, v in (("src0", "coppa_2013"), ("src1", "gdpr8"), ("src2", "ccpa"), ("src3", "uk_aadc"), ("src4", "OHCHR_crc")):
        name = F.when(s == k, F.lit(v)).otherwise(name)
    return table(spark, sf, "documents").groupBy(T.jurisdiction_of(F.coalesce(name, F.lit(""))).alias("jurisdiction")).agg(F.count("*").alias("n"))


# ---- corpus

@query("corpus_counts_share", "select source, n, round(n / sum(n) over (), 6) as share from (select coalesce(source, 'none') as source, count(*) as n from documents group by 1) union all select 'TOTAL', count(*), 1.0 from documents")
def _(spark, sf):
    return sampling.counts_share(table(spark, sf, "documents"), "source")


@query("corpus_validate", """
with per as (select coalesce(source, 'none') as subject, count(*) as n from documents group by 1)
select 'duplicate_id' as "check", doc_id::varchar as subject, count(*)::double as value from documents group by doc_id having count(*) > 1
union all select 'few_spans', subject, n::double from per where n < 60
union all select 'large_share', subject, round(n / (select sum(n) from per), 6) from per where n / (select sum(n) from per) > 0.1
union all select 'length', doc_id::varchar, length(text)::double from documents where not (length(text) between 20 and 5000)""")
def _(spark, sf):
    return sampling.validate(table(spark, sf, "documents"), "doc_id", "source", "text", 60, 0.1)


_KEY = r"sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' '))"


@query("dedup_first", f"select doc_id, {_KEY} as dedup_key from documents qualify row_number() over (partition by {_KEY} order by doc_id) = 1 and text is not null")
def _(spark, sf):
    return sampling.dedup_first(table(spark, sf, "documents"), "text", "doc_id")


@query("dedup_ratio", f"select count(text) as n, count(distinct {_KEY}) as n_distinct, round(1 - count(distinct {_KEY}) / count(text), 6) as ratio from documents")
def _(spark, sf):
    return sampling.dedup_ratio(table(spark, sf, "documents"), "text")


@query("stratified_sample_hash", """
with d as (select doc_id, source, sha256('42|' || doc_id) as draw from documents), c as (select greatest(1, 100 // count(distinct source)) as per from documents),
r as (select doc_id, source, row_number() over (partition by source order by draw) as rk, per from d, c)
select doc_id, source from r order by greatest(rk - per, 0), source, rk limit 100""")
def _(spark, sf):
    return sampling.stratified_sample(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", "source", 100)


@query("largest_remainder_quota", """
with s as (select lang, source, count(*) as size from documents group by all), q as (select *, floor(size * 500 / sum(size) over ()) as base, round(size * 500 / sum(size) over () - floor(size * 500 / sum(size) over ()), 9) as frac from s),
r as (select *, row_number() over (order by frac desc, lang nulls first, source nulls first) as rk, 500 - sum(base) over () as lft from q)
select lang, source, size, (base + case when rk <= lft then 1 else 0 end)::bigint as quota from r""")
def _(spark, sf):
    return sampling.largest_remainder(table(spark, sf, "documents"), ["lang", "source"], 500)


_CONV = "(select conv_id, turn, conv_id || '-' || turn as item from conversations)"


@query("blind_shuffle", f"select item, row_number() over (order by sha256('2026|' || item))::bigint as blind_ord from {_CONV}")
def _(spark, sf):
    d = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("item"))
    return sampling.blind_order(d, "item", 2026).select("item", _big("blind_ord"))


@query("blind_map_export", f"""
with b as (select conv_id, turn, chr((64 + row_number() over (partition by conv_id order by sha256('7|' || item)))::int) as letter from {_CONV})
select conv_id, string_agg(letter || '=' || turn, ',' order by letter) as map, count(*) as n from b group by conv_id""")
def _(spark, sf):
    d = table(spark, sf, "conversations").withColumn("draw", sampling.draw(7, F.concat_ws("-", "conv_id", "turn")))
    b = d.withColumn("letter", F.char((64 + F.row_number().over(Window.partitionBy("conv_id").orderBy("draw")))))
    return b.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("letter", F.lit("="), F.col("turn").cast("string")))), ",").alias("map"), F.count("*").alias("n"))


_UNIT = r"sha256(rtrim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'), ' '))"


@query("unit_hash", f"select doc_id, {_UNIT} as unit from documents where text is not null")
def _(spark, sf):
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", T.unit_key(F.col("text")).alias("unit"))


@query("inheritance_report", f"with u as (select doc_id, {_UNIT} as unit from documents where text is not null) select doc_id, min(doc_id) over (partition by unit) as source_doc from u qualify doc_id <> min(doc_id) over (partition by unit)")
def _(spark, sf):
    u = table(spark, sf, "documents").filter("text is not null").select("doc_id", T.unit_key(F.col("text")).alias("unit"))
    first = u.groupBy("unit").agg(F.min("doc_id").alias("source_doc"), F.count("*").alias("k")).filter("k > 1").drop("k")
    return u.join(first, "unit").filter("doc_id <> source_doc").select("doc_id", "source_doc")


@query("label_propagation", f"""
with u as (select doc_id, {_UNIT} as unit from documents where text is not null), l as (select unit, max(quality) as quality, max(toxic) as toxic from u join labels using (doc_id) group by unit)
select doc_id, quality, toxic from u join l using (unit)""")
def _(spark, sf):
    u = table(spark, sf, "documents").filter("text is not null").select("doc_id", T.unit_key(F.col("text")).alias("unit"))
    known = u.join(table(spark, sf, "labels"), "doc_id").groupBy("unit").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return u.join(known, "unit").select("doc_id", "quality", "toxic")


# ---- parsing

@query("parse_nodes", "select doc_id, node_type, sent_idx::int as sent_idx from nodes", True)
def _(spark, sf):
    return _graph(spark, sf)[1].select("doc_id", "node_type", "sent_idx")


@query("parse_edges", "select doc_id, src_type, edge_type, tgt_type, sent_idx::int as sent_idx from edges", True)
def _(spark, sf):
    _, nodes, edges = _graph(spark, sf)
    return parse.typed_edges(nodes, edges).select("doc_id", "src_type", "edge_type", "tgt_type", "sent_idx")


@query("parse_edge_signature_freq", "select src_type, edge_type, tgt_type, count(*) as n, count(distinct doc_id) as n_docs from edges group by all", True)
def _(spark, sf):
    _, nodes, edges = _graph(spark, sf)
    return parse.typed_edges(nodes, edges).groupBy("src_type", "edge_type", "tgt_type").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


_ODD_SQL = """, typed as (select doc_id, src_type, edge_type, tgt_type from edges union all select doc_id, 'DataProcessing', 'subjectOf', 'DataSubject' from g where doc_id % 5 = 0
  union all select doc_id, 'ConsentProcess', 'permits', 'DataProcessing' from g where doc_id % 7 = 0 union all select doc_id, 'Operator', 'permits', 'DataProcessing' from g where doc_id % 11 = 0)"""


def _odd(spark, sf) -> DataFrame:
    """Typed edges with some that aren't admissible."""
    n, nodes, edges = _graph(spark, sf)
    typed = parse.typed_edges(nodes, edges).select("doc_id", "src_type", "edge_type", "tgt_type")
    for k, (s, e, t) in ((5, ("DataProcessing", "subjectOf", "DataSubject")), (7, ("ConsentProcess", "permits", "DataProcessing")), (11, ("Operator", "permits", "DataProcessing"))):
        typed = typed.unionByName(n.filter(F.col("doc_id") % k == 0).select("doc_id", F.lit(s).alias("src_type"), F.lit(e).alias("edge_type"), F.lit(t).alias("tgt_type")))
    return typed


_ATTACH_SQL = ", ".join(f"('{s}', '{e}', '{t}')" for s, e, t in parse.ATTACH)


@query("topology_violations", f"{_ODD_SQL} select src_type, edge_type, tgt_type, count(*) as n from typed where (src_type, edge_type, tgt_type) not in ({_ATTACH_SQL}) group by all", True)
def _(spark, sf):
    return parse.topology_violations(_odd(spark, sf)).groupBy("src_type", "edge_type", "tgt_type").agg(F.count("*").alias("n"))


@query("kappa_canonicalise", f"""{_ODD_SQL} select case when turn then tgt_type else src_type end as src_type, case when ren then 'grants' else edge_type end as edge_type, case when turn then src_type else tgt_type end as tgt_type, count(*) as n
from (select *, src_type = 'DataProcessing' and edge_type = 'subjectOf' and tgt_type = 'DataSubject' as turn, src_type = 'ConsentProcess' and edge_type = 'permits' and tgt_type = 'DataProcessing' as ren from typed) group by all""", True)
def _(spark, sf):
    d = parse.canonical_edges(_odd(spark, sf).withColumns({"src": F.lit(""), "tgt": F.lit("")}))
    return d.groupBy("src_type", "edge_type", "tgt_type").agg(F.count("*").alias("n"))


@query("arrangement_conflicts", f"""{_ODD_SQL}, a as (select least(src_type, tgt_type) as a, greatest(src_type, tgt_type) as b, src_type || ' ' || edge_type || ' ' || tgt_type as arr, doc_id from typed)
select a, b, count(distinct arr) as arrangements, string_agg(distinct arr, '; ' order by arr) as listed, count(distinct doc_id) as n_docs from a group by a, b having count(distinct arr) > 1""", True)
def _(spark, sf):
    return RS.arrangement_conflicts(_odd(spark, sf))


@query("edge_conformance", f"{_ODD_SQL} select count(*) as n, sum(((src_type, edge_type, tgt_type) in ({_ATTACH_SQL}))::int)::bigint as ok, round(avg(((src_type, edge_type, tgt_type) in ({_ATTACH_SQL}))::int), 6) as rate from typed", True)
def _(spark, sf):
    good = F.struct("src_type", "edge_type", "tgt_type").isin(*[F.struct(*map(F.lit, t)) for t in parse.ATTACH])
    return _odd(spark, sf).agg(F.count("*").alias("n"), F.sum(good.cast("long")).alias("ok"), F.round(F.avg(good.cast("double")), 6).alias("rate"))


# ---- matching and repair

_MATCH_SQL = {
    "r_PC": "select doc_id, 1::bigint as n from fired where f_pc = 1",
    "r_WD": "select doc_id, 1::bigint as n from fired where f_wd = 1",
    "r_SALE": "select doc_id, f_sale::bigint as n from fired where f_sale > 0",
    "r_RET": "select doc_id, f_ret::bigint as n from fired where f_ret > 0",
    "r_NOTIFY": "select doc_id, bnd::bigint as n from fired where jurisdiction = 'EU' and bnd > 0",
}


def _match_query(name):
    @query(f"match_{name}", _MATCH_SQL[name], True)
    def _(spark, sf):
        n, nodes, edges = _graph(spark, sf)
        return applicable_matches(RULES[name], nodes, edges, n).groupBy("doc_id").agg(F.count("*").alias("n"))


for _name in _MATCH_SQL:
    _match_query(_name)


@query("flag_violations", "select rule, count(*) as n_docs, sum(n)::bigint as n from (" + " union all ".join(f"select '{k}' as rule, * from ({v})" for k, v in _MATCH_SQL.items()) + ") group by rule", True)
def _(spark, sf):
    return _steps(spark, sf).groupBy("rule").agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n"))


@query("nac_only_negation", "select doc_id from g where bb and not wd", True)
def _(spark, sf):
    n, nodes, edges = _graph(spark, sf)
    return applicable_matches(RULES["r_WD"], nodes, edges, n, guarded=False).select("doc_id")


@query("dangling_blocked", "select doc_id from fired where age < 16 and jurisdiction = 'EU' and bb", True)
def _(spark, sf):
    """Where deleting the consent process would leave its grant hanging."""
    from .plans.matcher import _with_parallel, find_matches

    n, nodes, edges = _graph(spark, sf)
    bad = RULES["r_BAD"]
    found = find_matches(bad.left, nodes, _with_parallel(edges, "doc_id")).join(n.filter(bad.guard.column()).select("doc_id"), "doc_id", "left_semi")
    return found.join(applicable_matches(bad, nodes, edges, n).select("doc_id"), "doc_id", "left_anti").select("doc_id")


_TOTALS = "sum(f_pc)::bigint as fired_pc, sum(f_wd)::bigint as fired_wd, sum(f_sale)::bigint as fired_sale, sum(f_ret)::bigint as fired_ret, sum(f_notify)::bigint as fired_notify"


def _normal(spark, sf):
    """The notices in normal form, rewritten within their rows, which leave their texts behind."""
    return delta.normalise(list(LIBRARY), local.graph_rows(_n(spark, sf)).drop("text", "sentences"))


def _by(rule: str):
    return lambda t: t["rule"] == rule


def _fired(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.explode("trace").alias("t")).select("doc_id", "t.rule")


@query("repair_summary", f"select jurisdiction, {_TOTALS} from fired group by jurisdiction", True)
def _(spark, sf):
    names = {"r_PC": "fired_pc", "r_WD": "fired_wd", "r_SALE": "fired_sale", "r_RET": "fired_ret", "r_NOTIFY": "fired_notify"}
    d = _normal(spark, sf)
    return d.groupBy("jurisdiction").agg(*[F.sum(F.size(F.filter("trace", _by(k)))).cast("long").alias(v) for k, v in names.items()])


@query("repair_trace_counts", "select rule, sum(n)::bigint as n, count(*) as n_docs from (select doc_id, unnest(['r_PC', 'r_WD', 'r_SALE', 'r_RET', 'r_NOTIFY']) as rule, unnest([f_pc, f_wd, f_sale, f_ret, f_notify]) as n from fired) where n > 0 group by rule", True)
def _(spark, sf):
    return _fired(_normal(spark, sf)).groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query("normal_form_edges", """
select edge_type, tgt_type, n from (
 select 'subjectOf' as edge_type, 'ConsentProcess' as tgt_type, sum(bb::int)::bigint as n from fired union all select 'grants', 'DataProcessing', sum(bb::int)::bigint from fired
 union all select 'requires', 'ParentalConsent', sum(n_pc + f_pc)::bigint from fired union all select 'permits', 'Withdrawal', sum(n_wd + f_wd)::bigint from fired
 union all select 'sellsTo', 'ThirdParty', sum(sale - f_sale)::bigint from fired union all select 'hasDuration', 'DurationIndefinite', sum(ind - f_ret)::bigint from fired
 union all select 'hasDuration', 'DurationBounded', sum(bnd + f_ret)::bigint from fired union all select 'notifies', 'Notification', sum(f_notify)::bigint from fired) where n > 0""", True)
def _(spark, sf):
    """By the joins for graphs of any size, a rank at a time."""
    n, nodes, edges = _graph(spark, sf)
    nodes, edges, _ = rewrite.normalise_strata(list(LIBRARY), rewrite.kept(nodes, "nodes"), rewrite.kept(edges, "edges"), n)
    return parse.typed_edges(nodes, edges).groupBy("edge_type", "tgt_type").agg(F.count("*").alias("n"))


@query("repair_outcome_metrics", "select count(*) as n_docs, sum((f_pc + f_wd + f_sale + f_ret + f_notify > 0)::int)::bigint as repaired, sum(f_pc + f_wd + f_sale + f_ret + f_notify)::bigint as steps, max(f_pc + f_wd + f_sale + f_ret + f_notify)::bigint as deepest, median(f_pc + f_wd + f_sale + f_ret + f_notify)::double as median_depth from fired", True)
def _(spark, sf):
    per = _normal(spark, sf).select(F.size("trace").cast("long").alias("k"))
    return per.agg(F.count("*").alias("n_docs"), F.sum((F.col("k") > 0).cast("long")).alias("repaired"), F.sum("k").alias("steps"), F.max("k").alias("deepest"), F.median("k").alias("median_depth"))


def _sql(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_REALIZED = f"""
, lines as (select say.doc_id, sent_idx, case when age < 16 and jurisdiction in ('EU', 'US') and sale then null when jurisdiction = 'EU' and endless then {_sql(RULES['r_RET'].template)} else s end as s from say),
body as (select doc_id, string_agg(s, ' ' order by sent_idx) as b from lines where s is not null group by doc_id),
parts as (select doc_id, 1 as k, {_sql(RULES['r_PC'].template)} as t from fired where f_pc > 0 union all select doc_id, 2, {_sql(RULES['r_WD'].template)} from fired where f_wd > 0
  union all select doc_id, 3, {_sql(RULES['r_SALE'].template)} from fired where f_sale > 0 union all select doc_id, 5, {_sql(RULES['r_NOTIFY'].template)} from fired where f_notify > 0),
extra as (select doc_id, string_agg(t, ' ' order by k) as x from parts group by doc_id),
done as materialized (select doc_id, concat_ws(' ', b, x) as output from fired left join body using (doc_id) left join extra using (doc_id))"""


@query("realize_text", f"{_REALIZED} select doc_id, md5(output) as digest, length(output)::bigint as n_chars from done", True)
def _(spark, sf):
    out = realize.realized(list(LIBRARY), delta.normalise(list(LIBRARY), local.graph_rows(_n(spark, sf)).drop("text")))
    return out.select("doc_id", F.md5("output").alias("digest"), F.length("output").cast("long").alias("n_chars"))


_AGAIN = f"""{_REALIZED}, again as materialized (select done.doc_id, output as text, age, jurisdiction from done join notices using (doc_id)),{chain("again", "_2")},
checked as (select n.doc_id, n.jurisdiction, f.f_pc + f.f_wd + f.f_sale + f.f_ret + f.f_notify > 0 as flagged, coalesce(h.f_pc + h.f_wd + h.f_sale + h.f_ret + h.f_notify, 0) = 0 as compliant, n.text = d.output as same
  from notices n join fired f using (doc_id) join done d using (doc_id) left join fired_2 h using (doc_id))"""


@query("round_trip_compliance", f"{_AGAIN} select flagged, compliant, count(*) as n, sum((compliant or same)::int)::bigint as scored_output from checked group by all", True)
def _(spark, sf):
    d = realize.process_documents(list(LIBRARY), _n(spark, sf))
    return d.groupBy("flagged", "compliant").agg(F.count("*").alias("n"), F.sum((F.col("scored_text") == F.col("output")).cast("long")).alias("scored_output"))


@query("flag_and_roundtrip_rates", f"{_AGAIN} select jurisdiction, count(*) as n, round(avg(flagged::int), 6) as flag_rate, round(avg(compliant::int), 6) as round_trip_rate from checked group by jurisdiction", True)
def _(spark, sf):
    d = realize.process_documents(list(LIBRARY), _n(spark, sf))
    return d.groupBy("jurisdiction").agg(F.count("*").alias("n"), F.round(F.avg(F.col("flagged").cast("double")), 6).alias("flag_rate"), F.round(F.avg(F.col("compliant").cast("double")), 6).alias("round_trip_rate"))


@query("connected_components", """, comp as (select doc_id, (bb::int + sale + ret)::bigint as components from g) select components, count(*) as n_docs from comp where components > 0 group by components""", True)
def _(spark, sf):
    d = _rows(spark, sf).select(local.component_count().cast("long").alias("components"))
    return d.filter("components > 0").groupBy("components").agg(F.count("*").alias("n_docs"))


# ---- rule sets

_ACTIVE = " union all ".join(f"select '{r.name}' as rule, a as age, j as jurisdiction from ctx where " + " and ".join((["true"] if not r.guard.places and not r.guard.op else []) + ([f"j in ({', '.join(map(_sql, sorted(r.guard.places)))})"] if r.guard.places else []) + ([f"a {r.guard.op} {r.guard.age}"] if r.guard.op else [])) for r in LIBRARY)
_CTX = f"with ctx as (select a::int as a, j from generate_series(0, 120) t(a), (values ('US'), ('EU'), ('UK'), ('US-CA')) v(j)), act as ({_ACTIVE})"
_CELLS = f"""{_CTX}, sig as (select a as age, j as jurisdiction, coalesce(string_agg(rule, ',' order by rule), '') as rules from ctx left join act on act.age = a and act.jurisdiction = j group by a, j),
st as (select *, case when rules = lag(rules) over (partition by jurisdiction order by age) then 0 else 1 end as s from sig), grp as (select *, sum(s) over (partition by jurisdiction order by age) as cell from st),
cells as (select jurisdiction, min(age) as age_lo, max(age) as age_hi, rules from grp group by jurisdiction, cell, rules)"""


@query("context_cells", f"{_CELLS} select * from cells")
def _(spark, sf):
    return RS.context_cells(spark, LIBRARY)


@query("representative_contexts", f"{_CELLS} select jurisdiction, age_lo as age from cells where rules <> ''")
def _(spark, sf):
    return RS.context_cells(spark, LIBRARY).filter("rules <> ''").select("jurisdiction", F.col("age_lo").alias("age"))


@query("jointly_satisfiable", f"{_CTX} select distinct x.rule as a, y.rule as b from act x join act y using (age, jurisdiction) where x.rule < y.rule")
def _(spark, sf):
    return RS.jointly_satisfiable(RS.active(spark, LIBRARY)).filter("a < b")


def _values(rows, columns: str) -> str:
    """A table of facts for the oracle."""
    def one(x):
        return "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else _sql(x)

    return "(values " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") t({columns})"


_EVERY = LIBRARY + PROBES
_PARTS = [(r, part, p) for r in _EVERY for part, p in [("L", r.left), ("R", r.right), *((f"NAC{k}", n) for k, n in enumerate(r.nacs))]]
#: The rules as tables: elem has nodes and edges of each part, guards the contexts where rules are active.
_FACTS = f"""
rules as (select * from {_values([(i, r.name, r.template) for i, r in enumerate(_EVERY)], "ord, rule, template")}),
node as (select * from {_values([(r.name, part, n, t) for r, part, p in _PARTS for n, t in p.nodes.items()], "rule, part, elem, type")}),
edge as (select * from {_values([(r.name, part, e, x, y, t) for r, part, p in _PARTS for e, (x, y, t) in p.edges.items()], "rule, part, elem, src, tgt, type")}),
nac as (select * from {_values([(r.name, part) for r, part, _ in _PARTS if part.startswith("NAC")], "rule, part")}),
elem as (select rule, part, 'n' as k, elem, type from node union all select rule, part, 'e', elem, type from edge),
guard as (select * from {_values([(r.name, r.guard.op, r.guard.age, ",".join(sorted(r.guard.places)) if r.guard.places else None) for r in _EVERY], "rule, op, age, places")}),
active as (select g.rule, a::int as age, j as jurisdiction from guard g, generate_series(0, 120) x(a), (values ('US'), ('EU'), ('UK'), ('US-CA')) v(j)
  where (places is null or list_contains(string_split(places, ','), j)) and (op is null or (op = '<' and a < age) or (op = '>=' and a >= age))),
lost as (select l.* from elem l where part = 'L' and not exists (select 1 from elem r where r.rule = l.rule and r.part = 'R' and r.k = l.k and r.elem = l.elem)),
made as (select r.* from elem r where part = 'R' and not exists (select 1 from elem l where r.rule = l.rule and l.part = 'L' and r.k = l.k and r.elem = l.elem)),
more as (select n.* from elem n where part like 'NAC%' and not exists (select 1 from elem l where n.rule = l.rule and l.part = 'L' and n.k = l.k and n.elem = l.elem)),
types as (select distinct rule, part, k, type from elem),
together as (select distinct x.rule as a, y.rule as b from active x join active y using (age, jurisdiction) where x.rule <> y.rule),
dep as (select distinct d.rule, d.enables, d.mechanism from (
  select r.rule, l.rule as enables, 'creates' as mechanism from types r join types l on l.part = 'L' and l.k = r.k and l.type = r.type where r.part = 'R' and not exists (select 1 from types o where o.rule = r.rule and o.part = 'L' and o.k = r.k and o.type = r.type)
  union select x.rule, m.rule, 'frees' from lost x join more m on m.k = x.k and m.type = x.type
  union select x.rule, y.rule, 'releases' from lost x join edge e on x.k = 'e' and e.rule = x.rule and e.part = 'L' and e.elem = x.elem join node n on n.rule = e.rule and n.part = 'L' and n.elem in (e.src, e.tgt) join lost y on y.k = 'n' and y.type = n.type
  ) d join together on together.a = d.rule and together.b = d.enables)"""


@query("rule_modality", f"with {_FACTS} select rule, case when rule in (select rule from lost) and rule in (select rule from made) then 'substitutive' when rule in (select rule from lost) then 'subtractive' else 'additive' end as modality from rules")
def _(spark, sf):
    return RS.modality(RS.tables(spark))


@query("rule_r1", f"with {_FACTS} select rule, rule in (select rule from lost) or rule in (select m.rule from more m join types r on r.rule = m.rule and r.part = 'R' and r.k = 'e' and m.k = 'e' and r.type = m.type) as discharges from rules")
def _(spark, sf):
    return RS.discharges(RS.tables(spark))


@query("rule_vacuous", f"with {_FACTS} select rule, rule in (select rule from nac where (rule, part) not in (select rule, part from elem)) as vacuous from rules")
def _(spark, sf):
    return RS.vacuous(RS.tables(spark))


@query("rule_dependency", f"with {_FACTS} select rule, enables, mechanism from dep")
def _(spark, sf):
    return RS.dependencies(spark, LIBRARY + PROBES)


_OWN = ", ".join(_sql(r.name) for r in LIBRARY)


@query("stratify_ranks", f"with recursive {_FACTS}, walk as (select rule, rule as at, 0 as depth from rules where rule in ({_OWN}) union select walk.rule, dep.enables, depth + 1 from walk join dep on dep.rule = walk.at where dep.enables in ({_OWN}) and depth < 20) select rule, max(depth)::int as rank from walk group by rule")
def _(spark, sf):
    return RS.ranks(RS.dependencies(spark, LIBRARY), RS.tables(spark, LIBRARY))


@query("critical_pairs_summary")
def _(spark, sf):
    return RS.critical_pairs(spark, LIBRARY + PROBES)


@query("admit_log")
def _(spark, sf):
    return RS.admit_log(spark, LIBRARY + PROBES)


@query("ablation_grid", """select * from (values
 ('creates', 'full', '100%', 0, 1, 1.0, 1.0, 0), ('creates', 'no CPA', '100%', 0, 1, 1.0, 1.0, 2), ('creates', 'no strat', '---', 0, 0, 1.0, null, 1), ('creates', 'neither', '---', 1, 0, 0.933333, null, 3),
 ('all', 'full', '100%', 0, 2, 1.0, 1.0, 0), ('all', 'no CPA', '100%', 0, 2, 1.0, 1.0, 1), ('all', 'no strat', '---', 0, 0, 1.0, null, 1), ('all', 'neither', '---', 1, 0, 0.933333, null, 3)) t(mechanisms, config, term, nonterm, strat_reject, repair_ok, median_cascade, unsound)""".replace("1.0, 1.0,", "1.0::double, 1.0::double,").replace("1.0, null,", "1.0::double, null::double,").replace("0.933333, null,", "0.933333::double, null::double,"))
def _(spark, sf):
    rows = []
    for name, m in (("creates", certify.CREATION), ("all", certify.MECHANISMS)):
        for r in certify.ablation(LIBRARY + PROBES, fixtures.host_graphs(), m):
            rows.append((name, r["config"], r["term"], r["nonterm"], r["strat_reject"], round(r["repair_ok"], 6), None if r["median_cascade"] is None else float(r["median_cascade"]), r["unsound"]))
    return spark.createDataFrame(rows, "mechanisms string, config string, term string, nonterm int, strat_reject int, repair_ok double, median_cascade double, unsound int")


@query("admission_funnel", """
with l as (select o_orderpriority as source, case o_orderstatus when 'F' then 'admit' when 'O' then 'reject:no-measure' else 'reject:non-joinable-CP' end as status from orders)
select coalesce(source, 'TOTAL') as source, count(*) as proposed, count(*) filter (status = 'admit') as certified, count(*) filter (status = 'reject:no-measure') as strat_rejected, count(*) filter (status like '%CP') as cp_rejected from l group by rollup(source)""")
def _(spark, sf):
    s = F.col("o_orderstatus")
    status = F.when(s == "F", "admit").when(s == "O", "reject:no-measure").otherwise("reject:non-joinable-CP")
    return RS.admission_funnel(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("source"), status.alias("status")))


# ---- coverage and labels

@query("coverage_metrics", """, h as (select doc_id, (f_pc > 0)::int as a, (f_wd > 0)::int as b, (f_sale > 0)::int as c, (f_ret > 0)::int as d, (jurisdiction = 'EU' and bnd > 0)::int as e, (bb and not pc)::int + (bb and not wd)::int + (sale > 0)::int + (ind > 0)::int + (bnd > 0)::int as s from fired)
select count(*) as hosts, sum((a + b + c + d + e > 0)::int)::bigint as covered, sum((s > 0)::int)::bigint as structurally, sum(a + b + c + d + e)::bigint as host_rule from h""", True)
def _(spark, sf):
    return local.coverage(list(LIBRARY), _rows(spark, sf))


@query("firing_census", "select r as rule, coalesce(n, 0)::bigint as n, n is null as never from (select unnest(['r_PC', 'r_WD', 'r_SALE', 'r_RET', 'r_NOTIFY', 'r_BAD', 'r_RET_BAD', 'r_FLIP1', 'r_FLIP2']) as r) left join (select rule, sum(n)::bigint as n from (select unnest(['r_PC', 'r_WD', 'r_SALE', 'r_RET', 'r_NOTIFY']) as rule, unnest([f_pc, f_wd, f_sale, f_ret, f_notify]) as n from fired) where n > 0 group by rule) x on x.rule = r", True)
def _(spark, sf):
    fired = _fired(_normal(spark, sf))
    names = spark.createDataFrame([(r.name,) for r in LIBRARY + PROBES], "rule string")
    n = fired.groupBy("rule").agg(F.count("*").alias("n"))
    return names.join(n, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("never"))


_CODES_SQL = "(values ('PC', 'EU', 16, 'consent'), ('WD', 'EU', null, 'withdrawal'), ('SALE', 'US', 16, 'sale'), ('RET', 'EU', null, 'retention'), ('AADC', 'UK', 18, 'design')) c(code, jurisdiction, age_lt, topic)"


@query("coverage_map", f"""
with rules as (select * from (values ('r_PC', 'consent', ['EU'], 16), ('r_WD', 'withdrawal', ['EU'], 999), ('r_SALE', 'sale', ['EU', 'US'], 16), ('r_RET', 'retention', ['EU'], 999)) r(rule, topic, places, below))
select code, count(rule) as n_rules, coalesce(string_agg(rule, ',' order by rule), '') as rules from {_CODES_SQL} left join rules r on r.topic = c.topic and list_contains(places, c.jurisdiction) and least(coalesce(age_lt, 999), below) > 0 group by code""")
def _(spark, sf):
    return RS.coverage_map(RS.codes(spark), LIBRARY)


@query("per_code_breakdown", f"""
select code, jurisdiction, count(*) as n_applicable, sum(case code when 'PC' then f_pc when 'WD' then f_wd when 'SALE' then (f_sale > 0)::int when 'RET' then (f_ret > 0)::int else 0 end)::bigint as n_violations
from (select c.code, f.* from {_CODES_SQL} join fired f on f.jurisdiction = c.jurisdiction and (age_lt is null or age < age_lt)) group by code, jurisdiction""", True)
def _(spark, sf):
    n = _n(spark, sf)
    hits = _steps(spark, sf).select("doc_id", F.regexp_replace("rule", "^r_", "").alias("code")).distinct().withColumn("hit", F.lit(1))
    c = F.broadcast(RS.codes(spark).withColumnRenamed("jurisdiction", "place"))
    d = n.join(c, (F.col("jurisdiction") == F.col("place")) & (F.col("age_lt").isNull() | (F.col("age") < F.col("age_lt"))))
    return d.join(hits, ["doc_id", "code"], "left").groupBy("code", "jurisdiction").agg(F.count("*").alias("n_applicable"), F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("n_violations"))


_LAB = "(select documents.doc_id, lang, source, toxic, quality, (toxic = 1 or quality = 0)::int as bad from documents join labels using (doc_id))"


def _labelled(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels"), "doc_id")
    return d.withColumn("bad", ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int"))


@query("compliance_rate_by_group", f"select lang, count(*) as n, round(100 * avg(1 - bad), 6) as rate from {_LAB} group by lang")
def _(spark, sf):
    return _labelled(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), F.round(100 * F.avg(1 - F.col("bad")), 6).alias("rate"))


@query("ccr_pivot", f"select lang, round(avg(case when doc_id % 3 = 0 then 1 - bad end), 6) as arm_0, round(avg(case when doc_id % 3 = 1 then 1 - bad end), 6) as arm_1, round(avg(case when doc_id % 3 = 2 then 1 - bad end), 6) as arm_2 from {_LAB} group by lang")
def _(spark, sf):
    d = _labelled(spark, sf).withColumn("arm", (F.col("doc_id") % 3).cast("string"))
    p = d.groupBy("lang").pivot("arm", ["0", "1", "2"]).agg(F.round(F.avg(1 - F.col("bad")), 6))
    return p.select("lang", *[F.col(k).alias(f"arm_{k}") for k in "012"])


@query("ccr_grouping_sets", f"select coalesce(lang, 'all') as lang, coalesce(arm, -1)::bigint as arm, count(*) as n, round(avg(1 - bad), 6) as ccr from (select *, doc_id % 3 as arm from {_LAB}) group by grouping sets ((lang, arm), (lang), (arm), ())")
def _(spark, sf):
    d = _labelled(spark, sf).withColumn("arm", F.col("doc_id") % 3)
    g = d.groupingSets([["lang", "arm"], ["lang"], ["arm"], []], "lang", "arm").agg(F.count("*").alias("n"), F.round(F.avg(1 - F.col("bad")), 6).alias("ccr"))
    return g.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("arm", F.lit(-1)).cast("long").alias("arm"), "n", "ccr")


@query("wilson_ci", f"""
select lang, k::bigint as k, n, round(greatest(0, (p + 3.841458820901220225 / (2 * n)) / (1 + 3.841458820901220225 / n) - 1.959963985 * sqrt(p * (1 - p) / n + 3.841458820901220225 / (4.0 * n * n)) / (1 + 3.841458820901220225 / n)), 6)::double as lo,
 round(least(1, (p + 3.841458820901220225 / (2 * n)) / (1 + 3.841458820901220225 / n) + 1.959963985 * sqrt(p * (1 - p) / n + 3.841458820901220225 / (4.0 * n * n)) / (1 + 3.841458820901220225 / n)), 6)::double as hi
from (select lang, sum(1 - bad) as k, count(*)::bigint as n, avg(1 - bad)::double as p from {_LAB} group by lang)""")
def _(spark, sf):
    g = _labelled(spark, sf).groupBy("lang").agg(F.sum(1 - F.col("bad")).alias("k"), F.count("*").alias("n"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return g.select("lang", "k", "n", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


_HASH = "(('0x' || substr(md5('{seed}|' || b || '|' || pos), 1, 8))::bigint % n)"


@query("bootstrap_ci_hash", f"""
with s as (select lang, count(*)::bigint as n, sum(1 - bad)::bigint as k from {_LAB} group by lang), d as (select lang, n, k, b, pos from s, generate_series(0, 1999) t(b), lateral (select unnest(generate_series(0, n - 1)) as pos)),
r as (select lang, n, k, b, avg(({_HASH.format(seed=0)} < k)::int) as r from d group by all)
select lang, n, round(k / n, 6) as rate, round(list_sort(list(r))[51], 6) as lo, round(list_sort(list(r))[1950], 6) as hi from r group by lang, n, k""")
def _(spark, sf):
    return stats.bootstrap_rate(_labelled(spark, sf), "lang", F.col("bad") == 0)


_CLUSTERS = f"(select row_number() over (order by source nulls first) - 1 as pos, coalesce(sum(1 - bad) filter (doc_id % 2 = 0), 0)::double as a_sum, count(*) filter (doc_id % 2 = 0)::double as a_n, coalesce(sum(1 - bad) filter (doc_id % 2 = 1), 0)::double as b_sum, count(*) filter (doc_id % 2 = 1)::double as b_n from {_LAB} group by source)"


@query("paired_bootstrap_diff", f"""
with c as (select * from {_CLUSTERS}), m as (select count(*)::bigint as n from c), i as (select b, {_HASH.format(seed=2026)} as pick from m, (select b, pos from generate_series(0, 4999) t(b), (select unnest(generate_series(0, (select n - 1 from m))) as pos))),
d as (select b, sum(a_sum) / sum(a_n) - sum(b_sum) / sum(b_n) as d from i join c on c.pos = pick group by b)
select (select round(sum(a_sum) / sum(a_n) - sum(b_sum) / sum(b_n), 6) from c) as diff, round(list_sort(list(d))[126], 6) as lo, round(list_sort(list(d))[4875], 6) as hi, round(least(1.0, 2 * least(avg((d <= 0)::int), avg((d >= 0)::int))), 6) as p from d""")
def _(spark, sf):
    d = _labelled(spark, sf)
    good = 1 - F.col("bad")

    def arm(k):
        mine = F.col("doc_id") % 2 == k
        return F.coalesce(F.sum(F.when(mine, good)), F.lit(0)).cast("double"), F.sum(mine.cast("double"))

    (a_sum, a_n), (b_sum, b_n) = arm(0), arm(1)
    g = d.groupBy("source").agg(a_sum.alias("a_sum"), a_n.alias("a_n"), b_sum.alias("b_sum"), b_n.alias("b_n"))
    return stats.paired_cluster_bootstrap(g.withColumn("pos", (F.row_number().over(Window.orderBy("source")) - 1).cast("long")).drop("source"))


@query("holm_adjust", f"""
with t as (select source, round(avg(bad) / 10, 6)::double as p from {_LAB} group by source), r as (select *, count(*) over () as m, row_number() over (order by p, source) as rn from t)
select source, p, round(least(1.0, max((m - rn + 1) * p) over (order by p, source rows between unbounded preceding and current row)), 6) as p_holm from r""")
def _(spark, sf):
    g = _labelled(spark, sf).groupBy("source").agg(F.round(F.avg("bad") / 10, 6).alias("p"))
    return stats.holm(g, "p", "source").select("source", "p", "p_holm")


_COHEN = "count(*) as n, round(avg((a = b)::int), 6) as po, round(avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)), 6) as pe, round(case when avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) >= 1 then 1.0 else (avg((a = b)::int) - (avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)))) / (1 - (avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)))) end, 6) as kappa, round(2 * avg((a = b)::int) - 1, 6) as pabak"


@query("cohen_kappa", f"select {_COHEN} from (select quality as a, 1 - toxic as b from labels)")
def _(spark, sf):
    return stats.cohen(table(spark, sf, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")), "a", "b")


@query("pabak", f"select lang, pabak from (select lang, {_COHEN} from (select lang, quality as a, 1 - toxic as b from {_LAB}) group by lang)")
def _(spark, sf):
    return stats.cohen(_labelled(spark, sf).select("lang", F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")), "a", "b", ["lang"]).select("lang", "pabak")


_RATERS = "(select doc_id, quality as r1, case when doc_id % 5 = 0 then 1 - quality else quality end as r2, case when toxic = 1 then 0 else quality end as r3 from labels)"


def _raters(spark, sf) -> DataFrame:
    q = F.col("quality")
    return table(spark, sf, "labels").select("doc_id", q.alias("r1"), F.when(F.col("doc_id") % 5 == 0, 1 - q).otherwise(q).alias("r2"), F.when(F.col("toxic") == 1, 0).otherwise(q).alias("r3"))


@query("fleiss_kappa", f"select n, round(pb, 6) as p_bar, round(q * q + (1 - q) * (1 - q), 6) as p_e, round((pb - (q * q + (1 - q) * (1 - q))) / (1 - (q * q + (1 - q) * (1 - q))), 6) as kappa, round((pb - 0.5) / 0.5, 6)::double as free from (select count(*) as n, avg((k * (k - 1) + (3 - k) * (2 - k)) / 6) as pb, sum(k) / (count(*) * 3) as q from (select r1 + r2 + r3 as k from {_RATERS}))")
def _(spark, sf):
    return stats.fleiss(_raters(spark, sf), ["r1", "r2", "r3"])


@query("majority_overlay", f"select v, count(*) as n, sum(changed)::bigint as changed from (select case when doc_id % 4 = 0 then (r1 + r2 + r3 >= 2)::int else r1 end as v, (case when doc_id % 4 = 0 then (r1 + r2 + r3 >= 2)::int else r1 end <> r1)::int as changed from {_RATERS}) group by v")
def _(spark, sf):
    d = _raters(spark, sf).withColumn("v", F.when(F.col("doc_id") % 4 == 0, stats.majority(["r1", "r2", "r3"])).otherwise(F.col("r1")))
    return d.groupBy("v").agg(F.count("*").alias("n"), F.sum((F.col("v") != F.col("r1")).cast("long")).alias("changed"))


@query("agreement_by_code", f"""
with u as (select 'c1' as code, r1 as a, r2 as b from {_RATERS} union all select 'c2', r1, r3 from {_RATERS} union all select 'c3', r2, r3 from {_RATERS})
select coalesce(code, 'pooled') as code, count(*) as n, round(avg((a = b)::int), 6) as po from u group by rollup(code)""")
def _(spark, sf):
    r = _raters(spark, sf)
    u = files.union_all([r.select(F.lit(c).alias("code"), F.col(x).alias("a"), F.col(y).alias("b")) for c, x, y in (("c1", "r1", "r2"), ("c2", "r1", "r3"), ("c3", "r2", "r3"))])
    g = u.rollup("code").agg(F.count("*").alias("n"), F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("po"))
    return g.select(F.coalesce("code", F.lit("pooled")).alias("code"), "n", "po")


@query("false_negative_split", """
select sum((truth > 0 and found = 0)::int)::bigint as missed, sum((truth > 0)::int)::bigint as violating, sum((truth > 0 and found = 0 and targeted = 0)::int)::bigint as missed_untargeted
from (select f_pc + f_wd + (f_sale > 0)::int + (f_ret > 0)::int as truth, f_pc + (f_sale > 0)::int as found, f_pc + (f_sale > 0)::int as targeted from fired)""", True)
def _(spark, sf):
    steps = _steps(spark, sf).filter("rule <> 'r_NOTIFY'").groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))
    found = F.exists("rules", lambda r: r.isin("r_PC", "r_SALE"))
    return steps.agg(F.sum((~found).cast("long")).alias("missed"), F.count("*").alias("violating"), F.sum(F.forall("rules", lambda r: ~r.isin("r_PC", "r_SALE")).cast("long")).alias("missed_untargeted"))


@query("counterfactual_subset", "select sum((f_pc + f_wd + f_sale + f_ret + f_notify > 0 and f_pc = 0 and f_sale = 0)::int)::bigint as only_removed, sum((f_pc + f_wd + f_sale + f_ret + f_notify > 0)::int)::bigint as fired from fired", True)
def _(spark, sf):
    sets = _fired(_normal(spark, sf)).groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))
    removed = F.array(*map(F.lit, ("r_WD", "r_RET", "r_NOTIFY")))
    return sets.agg(F.sum((F.size(F.array_except("rules", removed)) == 0).cast("long")).alias("only_removed"), F.count("*").alias("fired"))


@query("parser_prf", "select * from (values ('instances', 42, 49, 45, 0.857143::double, 0.933333::double, 0.893617::double), ('relations', 28, 32, 30, 0.875::double, 0.933333::double, 0.903226::double), ('all', 70, 81, 75, 0.864198::double, 0.933333::double, 0.897436::double)) t(part, matched, predicted, gold, p, r, f1)")
def _(spark, sf):
    return RS.parser_scores(fixtures.gold_table(spark))


@query("csv_label_upsert", """
with o as (select conv_id || '-' || turn as item, case when turn % 2 = 0 then 'NONE' end as v from conversations), n as (select conv_id || '-' || turn as item, case when conv_id % 3 = 0 then 'PC' end as v from conversations where conv_id % 2 = 0)
select item, coalesce(n.v, o.v) as violations from o full join n using (item)""")
def _(spark, sf):
    c = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("item"), "conv_id", "turn")
    old = c.select("item", F.when(F.col("turn") % 2 == 0, F.lit("NONE")).alias("violations"))
    new = c.filter("conv_id % 2 = 0").select("item", F.when(F.col("conv_id") % 3 == 0, F.lit("PC")).alias("violations"))
    return files.upsert(old, new, "item")


@query("todo_queue", "select conv_id, turn from conversations where not (conv_id % 3 = 0 and turn = 0)")
def _(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    return files.todo(c, c.filter("conv_id % 3 = 0 and turn = 0"), ["conv_id", "turn"])


@query("jsonl_cache_last_wins", "select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by event_id desc) = 1")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("key", F.concat_ws("|", "user_id", "event_type"))
    return files.last_wins(e.select("key", "user_id", "event_type", "event_id"), "key", F.col("event_id")).select("user_id", "event_type", "event_id")


@query("usage_totals_window", "select event_id, round(sum(value) over (partition by event_type order by ts range between interval 60 second preceding and current row), 4) as tokens from events")
def _(spark, sf):
    w = Window.partitionBy("event_type").orderBy(F.expr("unix_micros(cast(ts as timestamp))")).rangeBetween(-60_000_000, 0)
    return table(spark, sf, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("tokens"))


_LIB_SQL = "(values ('r_PC', 'yes', null), ('r_WD', 'partial', 'You can withdraw.'), ('r_SALE', null, null), ('r_RET', 'no', 'Kept for a year.'), ('r_NOTIFY', 'yes', null)) v(rule, verdict, instead)"


def _verdicts(spark) -> DataFrame:
    return spark.createDataFrame([("r_PC", "yes", None), ("r_WD", "partial", "You can withdraw."), ("r_SALE", None, None), ("r_RET", "no", "Kept for a year."), ("r_NOTIFY", "yes", None)], "rule string, verdict string, instead string")


@query("library_verdict_filter", f"select rule, coalesce(verdict, 'unrated') as verdict from {_LIB_SQL} where coalesce(verdict, 'unrated') in ('yes', 'partial')")
def _(spark, sf):
    return RS.verdict_filter(spark, LIBRARY, _verdicts(spark))


@query("template_override", f"with {_FACTS} select rules.rule, coalesce(instead, template) as template from rules left join {_LIB_SQL} on v.rule = rules.rule where rules.rule in ({_OWN})")
def _(spark, sf):
    return RS.template_override(spark, LIBRARY, _verdicts(spark).select("rule", "instead"))


@query("stop_rules", "select bool_or(sale > 3) as any_hot, bool_and(bb or sale + ret >= 0) as all_known, max(ind)::bigint as most_endless, avg(bb::int) < 0.2 as too_sparse from g", True)
def _(spark, sf):
    p = parse.parsed(_n(spark, sf))

    def count(field):
        return F.size(F.filter("marks", lambda m: m[field]))

    d = p.select(F.col("backbone").isNotNull().alias("bb"), count("sale").alias("sale"), count("retain").alias("ret"), count("endless").alias("ind"))
    return d.agg(F.bool_or(F.col("sale") > 3).alias("any_hot"), F.bool_and(F.col("bb") | (F.col("sale") + F.col("ret") >= 0)).alias("all_known"), F.max("ind").cast("long").alias("most_endless"), (F.avg(F.col("bb").cast("double")) < 0.2).alias("too_sparse"))
