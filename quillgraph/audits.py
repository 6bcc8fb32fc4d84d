"""Further registered queries: sources and sinks, scalar functions, proposals, arms, and audits of rule sets, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import _AGAIN, _ATTACH_SQL, _FACTS, _LAB, _OWN, _graph, _labelled, _n, _rows, _sql, query, table
from .functions import text as T
from .operators import local, parse, realize, rewrite, sampling, specs, stats
from .operators import ruleset as RS
from .operators.notices import _BLANK
from .plans import certify
from .plans.rules import ATTACH, LIBRARY, PROBES
from .session import shared_dir
from .sources import files, logs

_TRIM = f"lambda x: trim(x, {_BLANK})"
_LONGER = f"lambda x: length(x) >= {T.LEAST_SEGMENT}"


def _docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").filter("text is not null")


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/quillgraph/{name}-{uuid.uuid4().hex}"


def _sized(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.size("p").cast("long").alias("pieces"), F.md5(F.array_join("p", "|")).alias("digest"))


# ---- sources and sinks


@query("jsonl_cache_round_trip", "select 'h' || event_id % 500 as hash, max(event_id)::varchar as spec, 'later' as source from events where event_id % 3 = 0 group by 1 union all select 'h' || event_id % 500, max(event_id)::varchar, 'first' from events where 'h' || event_id % 500 not in (select 'h' || event_id % 500 from events where event_id % 3 = 0) group by 1")
def _(spark, sf):
    """Two appends to a cache, of which the later one wins, read again."""
    e = table(spark, sf, "events").withColumn("hash", F.concat(F.lit("h"), (F.col("event_id") % 500).cast("string")))
    path = _folder(spark, "cache")
    for source, part in (("first", e), ("later", e.filter("event_id % 3 = 0"))):
        files.append_cache(part.groupBy("hash").agg(F.lit(source).alias("source"), F.max("event_id").cast("string").alias("spec")), path)
    return files.read_cache(spark, path).select("hash", "spec", "source")


@query("run_readiness", "select item, item in (select table_name from information_schema.tables) as ready from (select unnest(['documents', 'orders', 'events', 'labels', 'no_such_table']) as item)")
def _(spark, sf):
    return logs.readiness(spark, {name: f"{sf}/{name}.parquet" for name in ("documents", "orders", "events", "labels", "no_such_table")})


@query("json_array_read", "select item_id, md5(text) as digest from benchmark")
def _(spark, sf):
    path = _folder(spark, "array")
    d = table(spark, sf, "benchmark")
    # A JSON array a file, as fixtures come.
    d.groupBy((F.col("item_id") % 4).alias("k")).agg(F.to_json(F.collect_list(F.struct("item_id", "text"))).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.read_json_array(spark, path, "item_id bigint, text string").select("item_id", F.md5("text").alias("digest"))


@query("csv_sheet_round_trip", """
select conv_id || '-' || turn as item_id, case turn % 3 when 1 then '' else case when conv_id % 2 = 0 then 'PC,WD' else 'SALE' end end as violations from conversations where turn % 3 <> 0""")
def _(spark, sf):
    """Label sheets written as CSV with a byte-order mark, read, and their answers parsed: blank ones are unanswered."""
    given = F.when(F.col("turn") % 3 == 0, F.lit("")).when(F.col("turn") % 3 == 1, F.lit("None")).when(F.col("conv_id") % 2 == 0, F.lit("pc; wd")).otherwise(F.lit("sale"))
    c = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("item_id"), *[F.lit("x").alias(k) for k in files.SHEET[1:7]], F.col("text").alias("output_text"), given.alias("violations_found"))
    path = _folder(spark, "sheet")
    files.write_sheet(c, path)
    good, _ = files.answers(files.read_sheet(spark, path), spark.createDataFrame([("PC",), ("WD",), ("SALE",)], "code string"))
    return good.select("item_id", F.array_join("violations", ",").alias("violations"))


@query("unblind_export", "select turn % 3 as arm, count(*) as n, sum((conv_id % 2 = 0)::int)::bigint as marked from conversations group by 1")
def _(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("pair_id"), F.char(F.lit(65) + F.col("turn")).alias("output_label"), (F.col("turn") % 3).alias("arm"), F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("PC"))).otherwise(F.array().cast("array<string>")).alias("violations"))
    d = files.unblind(c.select("pair_id", "output_label", "violations"), c.select("pair_id", "output_label", "arm"))
    return d.groupBy("arm").agg(F.count("*").alias("n"), F.sum((F.size("violations") > 0).cast("long")).alias("marked"))


@query("prompt_table_parse", "select conv_id, 'P' || turn as prompt_id, 'Ask ' || conv_id || ' for ' || role as prompt from conversations")
def _(spark, sf):
    lines = F.concat(F.lit("| P"), F.col("turn").cast("string"), F.lit(" | Ask "), F.col("conv_id").cast("string"), F.lit(" for "), F.col("role"), F.lit(" |"))
    d = table(spark, sf, "conversations").groupBy("conv_id").agg(F.concat(F.lit("# Prompts\n|---|---|\n"), F.array_join(F.collect_list(lines), "\n")).alias("text"))
    return files.prompt_table(d, keep=["conv_id"])


@query("text_files_read", """
select k || item_id as source, case k when 'gdpr8_' then 'EU' when 'ccpa_' then 'US-CA' when 'uk_aadc_' then 'UK' else 'UNKNOWN' end as jurisdiction, md5(text || chr(10)) as digest
from (select item_id, text, (['gdpr8_', 'ccpa_', 'uk_aadc_', 'other_'])[(item_id % 4 + 1)::int] as k from benchmark)""")
def _(spark, sf):
    """A folder of text files, one for each item, read whole by name."""
    path, kinds = _folder(spark, "texts"), F.array(*map(F.lit, ("gdpr8_", "ccpa_", "uk_aadc_", "other_")))
    d = table(spark, sf, "benchmark").select(F.concat(F.element_at(kinds, (F.col("item_id") % 4 + 1).cast("int")), F.col("item_id").cast("string")).alias("source"), "text")
    d.write.partitionBy("source").text(path)
    return files.read_texts(spark, path).select("source", "jurisdiction", F.md5("text").alias("digest"))


@query("frozen_table", "select item_id, md5(text) as digest from benchmark")
def _(spark, sf):
    """A copy of a table, which is read only if it has the digest that its original had."""
    d, path = table(spark, sf, "benchmark").select("item_id", F.md5("text").alias("digest")), _folder(spark, "frozen")
    d.write.parquet(path)
    return files.gated(spark.read.schema(d.schema).parquet(path), files.digest(d).first()[0])


#: What the tables must hold at any size.
EXPECTED = {"nations": 25, "regions": 5, "kinds of events": 5, "states of orders": 3, "market segments": 5}


@query("config_gate", """
select 'nations' as name, count(*) as found from nation union all select 'regions', count(*) from region union all select 'kinds of events', count(distinct event_type) from events
union all select 'states of orders', count(distinct o_orderstatus) from orders union all select 'market segments', count(distinct c_mktsegment) from customer""")
def _(spark, sf):
    """Counts that were written down, held against counts that are found."""
    found = {"nations": ("nation", F.count("*")), "regions": ("region", F.count("*")), "kinds of events": ("events", F.count_distinct("event_type")), "states of orders": ("orders", F.count_distinct("o_orderstatus")), "market segments": ("customer", F.count_distinct("c_mktsegment"))}
    facts = [table(spark, sf, t).agg(F.lit(name).alias("name"), F.lit(EXPECTED[name]).alias("expected"), n.alias("found")) for name, (t, n) in found.items()]
    return logs.gate(files.union_all(facts)).select("name", "found")


@query("event_log", "select event_type as kind, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as at, count(*) as n from events group by all")
def _(spark, sf):
    """All events, logged as JSON lines in one write and read again."""
    path = _folder(spark, "events")
    logs.append_events(table(spark, sf, "events").select("event_id", "ts", "event_type"), path, F.col("event_type"), F.col("ts"))
    return logs.read_events(spark, path).groupBy("kind", "at").agg(F.count(F.get_json_object("detail", "$.event_id")).alias("n"))


@query("results_written", """
select 'by source' as name, coalesce(source, 'none') as row, count(*) as n, sum(length(text))::bigint as chars from documents group by all
union all select 'by language', coalesce(lang, 'none'), count(*), sum(length(text))::bigint from documents group by all""")
def _(spark, sf):
    """Two tables of results, written as JSON lines below one folder and read again by name."""
    path, d = _folder(spark, "results"), table(spark, sf, "documents")
    tables = {name: d.groupBy(F.coalesce(c, F.lit("none")).alias("row")).agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars")) for name, c in (("by source", "source"), ("by language", "lang"))}
    logs.write_results(tables, path)
    return files.union_all([spark.read.schema(t.schema).json(f"{path}/{name}").select(F.lit(name).alias("name"), "row", "n", "chars") for name, t in tables.items()])


@query("results_rendered", "select rpad(coalesce(source, '-'), 12, ' ') || ' | ' || lpad(n::varchar, 8, ' ') as line from (select source, count(*) as n from documents group by 1)")
def _(spark, sf):
    return logs.rendered(table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")), {"source": 12, "n": 8})


@query("extract_batches", "select doc_id, ((row_number() over (order by sha256(doc_id::varchar)) - 1) // 5)::bigint as batch from documents where doc_id % 3 <> 0")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("hash"))
    return files.cache_split(d, d.filter("doc_id % 3 = 0").select("hash"))[1].select("doc_id", _long("batch"))


def _long(c: str) -> F.Column:
    return F.col(c).cast("long").alias(c)


#: A schema file, as a control table comes.
_SCHEMA = "# what may connect what\nattach:\n" + "".join(f"  - [{', '.join(t)}]  # {k}\n" for k, t in enumerate(ATTACH)) + "retired:\n  - [Operator, permits, DataProcessing]\n  # - [DataSubject, grants, DataProcessing]\n"


@query("schema_conformance", f", typed as (select * from edges union all select doc_id, 'Operator', 'permits', 'DataProcessing', sent_idx from say where operates and doc_id in (select doc_id from g where bb_op)) select case when (src_type, edge_type, tgt_type) in (('Operator', 'permits', 'DataProcessing')) then 'retired' when (src_type, edge_type, tgt_type) in ({_ATTACH_SQL}) then 'attach' end as section, src_type, edge_type, tgt_type, count(*) as n from typed group by all", True)
def _(spark, sf):
    """All edges of all notices, with the permits extension, by the section of the schema file that has their triple."""
    path = _folder(spark, "schema")
    spark.createDataFrame([(_SCHEMA,)], "value string").coalesce(1).write.text(path)
    held = files.read_triples(spark, path).drop("place")
    p = parse.parsed(_n(spark, sf), permits=True).select("doc_id", F.explode(parse.typed_edge_array(True)).alias("e")).select("doc_id", "e.*")
    counted = p.groupBy("src_type", "edge_type", "tgt_type").agg(F.count("*").alias("n"))
    return counted.join(held, ["src_type", "edge_type", "tgt_type"], "left").select("section", "src_type", "edge_type", "tgt_type", "n")


# ---- scalar functions


@query("segment_articles", f"""
with t as (select doc_id, replace(text, '. ', '.' || chr(10) || 'Article 8 ') as t from documents where text is not null)
select doc_id, len(p)::bigint as pieces, md5(array_to_string(p, '|')) as digest from (select doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '\\n\\s*\\n', chr(30), 'g'), '(?m)^(\\s*Article\\s+\\d+)', chr(30) || '\\1', 'g'), chr(30)), {_TRIM}), {_LONGER}) as p from t)""")
def _(spark, sf):
    return _sized(_docs(spark, sf).select("doc_id", T.segments(F.replace("text", F.lit(". "), F.lit(".\nArticle 8 "))).alias("p")))


@query("segment_headers", f"""
with t as (select doc_id, replace(text, '. ', '. 1798.100. ') as t from documents where text is not null)
select doc_id, len(p)::bigint as pieces, md5(array_to_string(p, '|')) as digest from (select doc_id, list_filter(list_transform(string_split(regexp_replace(t, '(\\b1798\\.\\d+(?:\\.\\d+)?\\.\\s)', chr(30) || '\\1', 'g'), chr(30)), {_TRIM}), {_LONGER}) as p from t)""")
def _(spark, sf):
    return _sized(_docs(spark, sf).select("doc_id", T.header_segments(F.replace("text", F.lit(". "), F.lit(". 1798.100. "))).alias("p")))


@query("page_lines_drop", """
with t as (select doc_id, string_split(replace(text, '. ', '.' || chr(10) || '-- Page 3 --' || chr(10) || '12' || chr(10)), chr(10)) as p from documents where text is not null)
select doc_id, md5(array_to_string(list_filter(p, lambda x: not regexp_matches(trim(x), '(?i)^-+\\s*Page\\s+\\d+\\s*-+$|^\\d{1,4}$')), chr(10))) as digest from t""")
def _(spark, sf):
    paged = F.replace("text", F.lit(". "), F.lit(".\n-- Page 3 --\n12\n"))
    return _docs(spark, sf).select("doc_id", F.md5(T.drop_page_lines(paged)).alias("digest"))


@query("article_slice", "select doc_id, md5('Article 8' || chr(10) || text || chr(10)) as digest from documents where text is not null and not contains(text, 'Article 9') and not contains(text, 'Article 8')")
def _(spark, sf):
    d = _docs(spark, sf).filter("not contains(text, 'Article 9') and not contains(text, 'Article 8')")
    return d.select("doc_id", F.md5(T.article_slice(F.concat(F.lit("head\nArticle 8\n"), "text", F.lit("\nArticle 9\ntail")), "Article 8", "Article 9")).alias("digest"))


@query("provision_stored", "select doc_id, length(left(text, 2000))::bigint as stored, sha256('m|0.0|512|EU|None|' || left(text, 800)) as cache_key from documents where text is not null")
def _(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", F.length(F.substring(t, 1, T.STORED)).cast("long").alias("stored"), T.provision_key("m", 0.0, 512, F.lit("EU"), F.lit(None).cast("int"), t).alias("cache_key"))


_CLEAN = "regexp_replace(regexp_replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')".replace("{{", "{").replace("}}", "}")
_CUT = "regexp_replace(regexp_replace(regexp_replace({}, '\\n\\s*\\n', chr(30), 'g'), '(?m)^(\\s*Article\\s+\\d+)', chr(30) || '\\1', 'g'), '(?m)^(\\s*§)', chr(30) || '\\1', 'g')"


@query("provisions_by_source", f"""
with a as (select doc_id, (['gdpr8', 'ccpa', 'uk_aadc', 'page'])[(doc_id % 4 + 1)::int] as kind, replace(text, '&', '+') as text from documents where text is not null and doc_id is not null),
b as (select doc_id, kind, case kind when 'gdpr8' then 'head' || chr(10) || 'Article 8' || chr(10) || replace(text, '. ', '. (b) ') || chr(10) || 'Article 9' || chr(10) || 'tail' when 'ccpa' then replace(text, '. ', '. 1798.100. ')
  when 'uk_aadc' then replace(text, '. ', '.' || chr(10) || '-- Page 3 --' || chr(10) || '12' || chr(10)) else '(a) ' || replace(text, '. ', '. (b) ') end as t from a),
c as (select doc_id, kind, {_CLEAN} as t from b),
d as (select doc_id, kind, case kind
  when 'ccpa' then list_filter(list_transform(string_split(regexp_replace(t, '(\\b1798\\.\\d+(?:\\.\\d+)?\\.\\s)', chr(30) || '\\1', 'g'), chr(30)), {_TRIM}), {_LONGER})
  when 'uk_aadc' then list_filter(list_transform(string_split(array_to_string(list_transform(list_filter(list_transform(list_filter(string_split(t, chr(10)), lambda x: not regexp_matches(trim(x), '(?i)^-+\\s*Page\\s+\\d+\\s*-+$|^\\d{{1,4}}$')), {_TRIM}), lambda x: x <> ''),
    lambda x: case when regexp_matches(x, '[.!?:]$') then x || chr(30) else x || ' ' end), ''), chr(30)), lambda x: rtrim(x)), lambda x: length(x) >= {T.LEAST_SEGMENT})
  when 'gdpr8' then list_filter(list_transform(string_split({_CUT.format("substr(t, instr(t, 'Article 8'), instr(t, 'Article 9') - instr(t, 'Article 8'))")}, chr(30)), {_TRIM}), {_LONGER})
  else list_filter(list_transform(string_split({_CUT.format("t")}, chr(30)), {_TRIM}), {_LONGER}) end as p from c),
e as (select doc_id, kind, flatten(list_transform(p, lambda s: case when length(s) > {T.LONGEST_SPAN} then list_filter(list_transform(string_split(regexp_replace(s, '(\\(\\w{{1,3}}\\)\\s)', chr(30) || '\\1', 'g'), chr(30)), {_TRIM}), lambda x: length(x) >= {T.LEAST_PIECE}) else [s] end)) as p from d)
select kind || '_' || doc_id as source, len(p)::bigint as n, list_sum(list_transform(p, lambda x: least(length(x), {T.STORED})))::bigint as stored from e where len(p) > 0""")
def _(spark, sf):
    """Every document cut by the rules of the source that it is taken for: an article between two headings, sections by number, wrapped
    lines with page banners, or paragraphs."""
    d = _docs(spark, sf).filter("doc_id is not null").withColumn("kind", F.element_at(F.array(*map(F.lit, ("gdpr8", "ccpa", "uk_aadc", "page"))), (F.col("doc_id") % 4 + 1).cast("int")))
    own = F.replace("text", F.lit("&"), F.lit("+"))
    marked = F.replace(own, F.lit(". "), F.lit(". (b) "))
    made = F.when(F.col("kind") == "gdpr8", F.concat(F.lit("head\nArticle 8\n"), marked, F.lit("\nArticle 9\ntail"))).when(F.col("kind") == "ccpa", F.replace(own, F.lit(". "), F.lit(". 1798.100. ")))
    made = made.when(F.col("kind") == "uk_aadc", F.replace(own, F.lit(". "), F.lit(".\n-- Page 3 --\n12\n"))).otherwise(F.concat(F.lit("(a) "), marked))
    texts = d.select(F.concat_ws("_", "kind", F.col("doc_id").cast("string")).alias("source"), F.lit("EU").alias("jurisdiction"), made.alias("text"))
    return files.provisions(texts).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("stored"))


@query("answer_fields", """
select o_orderkey, o_orderkey::varchar as object_id, '[' || o_custkey || ']' as array_text, 'kept ' || o_orderstatus as revised, case when o_custkey % 4 = 0 then null else greatest(0.0, least(1.0, o_custkey % 7 / 4.0 - 0.25))::double end as confidence,
  case o_custkey % 3 when 0 then 'A,C' when 1 then 'B' else '' end as codes from orders""")
def _(spark, sf):
    """What is read from answers: an object and an array in prose, a text after a marker, a confidence, and chosen codes."""
    d, k, c = table(spark, sf, "orders"), F.col("o_orderkey").cast("string"), F.col("o_custkey")
    said = F.concat(F.lit('Sure: {"id": "'), k, F.lit('"} and [ignored'))
    listed = F.concat(F.lit("It is ["), c.cast("string"), F.lit("], so."))
    text = F.concat(F.lit("draft REVISED: first REVISED: kept "), "o_orderstatus", F.lit(" "))
    number = F.when(c % 4 == 0, F.lit("high")).otherwise((c % 7 / 4.0 - 0.25).cast("string"))
    picked = F.element_at(F.array(F.lit("1, 3"), F.lit("2,9"), F.lit("none")), (c % 3 + 1).cast("int"))
    return d.select("o_orderkey", F.get_json_object(T.json_object(said), "$.id").alias("object_id"), T.json_array(listed).alias("array_text"), T.after_marker(text).alias("revised"), T.confidence(number).alias("confidence"), F.array_join(T.chosen_codes(picked, F.array(*map(F.lit, "ABC"))), ",").alias("codes"))


@query("text_screens", "select coalesce(lang, '?') as lang, count(*) as n, min(length(text))::bigint as shortest, max(length(text))::bigint as longest, round(avg(length(text)), 4) as mean, sum((contains(lower(text), 'must') or contains(lower(text), 'shall') or contains(lower(text), 'please'))::int)::bigint as imperative from documents where text is not null group by 1")
def _(spark, sf):
    n = F.length("text")
    return _docs(spark, sf).groupBy(F.coalesce("lang", F.lit("?")).alias("lang")).agg(F.count("*").alias("n"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), F.round(F.avg(n), 4).alias("mean"), F.sum(T.any_of(F.lower("text"), ("must", "shall", "please")).cast("long")).alias("imperative"))


@query("prompts_rendered", ", p as (select doc_id, left(text, 800) as r, 'Reader: age ' || age || ', ' || jurisdiction || '.' as who from notices) select doc_id, md5('Write a privacy notice. Request: ' || r || ' ' || who) as unconstrained, md5('Here are two notices that keep the law. Write one like them. Request: ' || r || ' ' || who) as few_shot, md5('Write a privacy notice, say what is wrong with it, and end with REVISED: and the notice mended. Request: ' || r || ' ' || who) as critique from p", True)
def _(spark, sf):
    d = specs.prompts(_n(spark, sf))
    return d.select("doc_id", *[F.md5(f"prompt_{k}").alias(k) for k in specs.PROMPTS])


@query("codebook_digest", "select code, sha256(concat_ws('|', code, jurisdiction, coalesce(age_lt::varchar, 'any'), topic)) as digest from (values ('PC', 'EU', 16, 'consent'), ('WD', 'EU', null, 'withdrawal'), ('SALE', 'US', 16, 'sale'), ('RET', 'EU', null, 'retention'), ('AADC', 'UK', 18, 'design')) c(code, jurisdiction, age_lt, topic)")
def _(spark, sf):
    return RS.codes(spark).select("code", F.sha2(F.concat_ws("|", "code", "jurisdiction", F.coalesce(F.col("age_lt").cast("string"), F.lit("any")), "topic"), 256).alias("digest"))


# ---- graphs, proposals, arms


@query("graph_signatures", """, n as (select doc_id, string_agg(node_type, ',' order by node_type) as ns from nodes group by doc_id), e as (select doc_id, string_agg(src_type || ' ' || edge_type || ' ' || tgt_type, ',' order by src_type || ' ' || edge_type || ' ' || tgt_type) as es from edges group by doc_id)
select md5(ns || ';' || coalesce(es, '')) as signature, count(*) as n_docs from n left join e using (doc_id) group by 1""", True)
def _(spark, sf):
    kind = F.map_from_entries(F.transform("nodes", lambda n: F.struct(n["node_id"], n["node_type"])))
    types = F.array_sort(F.transform("nodes", lambda n: n["node_type"]))
    ends = F.array_sort(F.transform("edges", lambda e: F.concat_ws(" ", kind[e["src"]], e["edge_type"], kind[e["tgt"]])))
    d = _rows(spark, sf).filter(F.size("nodes") > 0).select(F.md5(F.concat(F.array_join(types, ","), F.lit(";"), F.array_join(ends, ","))).alias("signature"))
    return d.groupBy("signature").agg(F.count("*").alias("n_docs"))


_ATTACHED = ", ".join(f"('{s}', '{e}', '{t}')" for s, e, t in ATTACH)


@query("parser_emittable", f", a as (select * from (values {_ATTACHED}) v(src_type, edge_type, tgt_type)), m as (select distinct src_type, edge_type, tgt_type from edges) select coalesce(a.src_type, m.src_type) as src_type, coalesce(a.edge_type, m.edge_type) as edge_type, coalesce(a.tgt_type, m.tgt_type) as tgt_type, a.src_type is not null as admissible, m.src_type is not null as emitted from a full join m on a.src_type = m.src_type and a.edge_type = m.edge_type and a.tgt_type = m.tgt_type", True)
def _(spark, sf):
    _, nodes, edges = _graph(spark, sf)
    return RS.emittable(parse.typed_edges(nodes, edges))


@query("topology_messages", ", bad as (select doc_id, src_type || ' -' || edge_type || '-> ' || tgt_type || ' is not admissible' as m from (select doc_id, 'Operator' as src_type, 'permits' as edge_type, 'DataProcessing' as tgt_type from g where n_op > 0 and bb_op)) select doc_id, string_agg(distinct m, '; ' order by m) as message from bad group by doc_id", True)
def _(spark, sf):
    """Of the parser's extension, whose edges the schema doesn't admit."""
    nodes, edges = parse.graph_of(_n(spark, sf), permits=True)
    bad = parse.topology_violations(parse.typed_edges(nodes, edges))
    message = F.concat(F.col("src_type"), F.lit(" -"), F.col("edge_type"), F.lit("-> "), F.col("tgt_type"), F.lit(" is not admissible"))
    return bad.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(message)), "; ").alias("message"))


@query("parser_before_after", """, k as (select doc_id, bb, bb_op, n_op, 2 * bb::int + n_pc + n_wd + sale + ind + bnd as before, 2 * bb_op::int + n_pc + n_wd + sale + ind + bnd + n_op as after from g)
select count(*) as n, sum((before <> after)::int)::bigint as changed, sum(before)::bigint as before, sum(after)::bigint as after, round(1 - sum(n_op) / sum(after), 6) as conformance from k""", True)
def _(spark, sf):
    """The parser without and with its extension: edges of each document, and the share that the schema admits."""
    n = _n(spark, sf)
    sizes = [parse.parsed(n, permits=p).select("doc_id", F.size(parse.edge_array(p)).alias(c), F.size(F.filter(parse.edge_array(p), lambda e: e["edge_id"].startswith("ef"))).alias(f"odd_{c}")) for p, c in ((False, "before"), (True, "after"))]
    d = sizes[0].join(sizes[1], "doc_id", "full_outer")
    return d.agg(F.count("*").alias("n"), F.sum((F.col("before") != F.col("after")).cast("long")).alias("changed"), F.sum("before").alias("before"), F.sum("after").alias("after"), F.round(1 - F.sum("odd_after") / F.sum("after"), 6).alias("conformance"))


#: A proposal, and what is done to it by the number of its order.
_GOOD = '{"name": "r", "L": {"nodes": [{"id": "a", "type": "Operator"}, {"id": "b", "type": "ThirdParty"}], "edges": [{"id": "e", "src": "a", "tgt": "b", "type": "sellsTo"}]}, "R": {"nodes": [{"id": "a", "type": "Operator"}], "edges": []}, "confidence": "0.5"}'
_FAULTS = [
    (_GOOD, None),
    (_GOOD.replace("ThirdParty", "Nobody"), "L: off-schema node type"),
    (_GOOD.replace("sellsTo", "gives"), "L: off-schema edge type"),
    (_GOOD.replace('"tgt": "b"', '"tgt": "z"'), "L: undeclared endpoint"),
    (_GOOD.replace('"R": {"nodes": [{"id": "a", "type": "Operator"}]', '"R": {"nodes": [{"id": "a", "type": "Withdrawal"}]'), "kept node changes type"),
    ("I can't say.", "no rule"),
]


def _answer(k: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(f"Here it is: {x}") for x, _ in _FAULTS]), (k % len(_FAULTS) + 1).cast("int"))


_ERRORS = "[" + ", ".join("null" if e is None else _sql(e) for _, e in _FAULTS) + "]"


@query("rule_proposals", f"select o_orderstatus as source, ({_ERRORS})[(o_orderkey % 6 + 1)::int] as error, count(*) as n from orders group by all")
def _(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("source"), F.col("o_orderkey").cast("string").alias("hash"), _answer(F.col("o_orderkey")).alias("spec_json"))
    good, bad = specs.rules_of(d)
    return good.select("source", F.lit(None).cast("string").alias("error")).unionByName(bad.select("source", "error")).groupBy("source", "error").agg(F.count("*").alias("n"))


@query("rules_from_cache", f"select ({_ERRORS})[(k % 6 + 1)::int] as error, count(*) as n from (select case when o_custkey % 2 = 0 then max(o_orderkey) else min(o_orderkey) end as k from orders group by o_custkey) group by all")
def _(spark, sf):
    """Proposals read back from a cache in which a later answer replaces the first one of each second key."""
    o = table(spark, sf, "orders")
    path = _folder(spark, "proposals")
    for part, key in ((o, F.min("o_orderkey")), (o.filter("o_custkey % 2 = 0"), F.max("o_orderkey"))):
        k = part.groupBy("o_custkey").agg(key.alias("k"))
        files.append_cache(k.select(F.col("o_custkey").cast("string").alias("hash"), F.lit("orders").alias("source"), _answer(F.col("k")).alias("spec")), path)
    good, bad = files.rules_from_cache(spark, path)
    return good.select(F.lit(None).cast("string").alias("error")).unionByName(bad.select("error")).groupBy("error").agg(F.count("*").alias("n"))


@query("refinement_rounds", f"select case when o_orderkey % 6 = 0 then 0 when (o_orderkey + 1) % 6 = 0 then 1 else 2 end as round, case when o_orderkey % 6 in (0, 5, 4) then null else ({_ERRORS})[((o_orderkey + 2) % 6 + 1)::int] end as error, count(*) as n from orders group by all")
def _(spark, sf):
    """Each round's answer has the next fault of the list; the fourth answer isn't asked for."""
    d = table(spark, sf, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("round"))
    out = specs.refined(d.withColumn("response", _answer(F.col("o_orderkey") + F.col("round"))), "o_orderkey")
    return out.groupBy("round", "error").agg(F.count("*").alias("n"))


def _model_answers(n: DataFrame) -> DataFrame:
    """What a model might have answered: the keyword parse as JSON at the second attempt, with an odd edge; nothing for each fourth document."""
    p = rewrite.kept(local.graph_rows(n).select("doc_id", "nodes", "edges"), "answers")
    place = F.transform("nodes", lambda x: x["node_id"])
    nodes = F.transform("nodes", lambda x, i: F.struct(i.alias("id"), x["node_type"].alias("type"), x["sent_idx"].alias("sent")))
    edges = F.transform("edges", lambda e: F.struct((F.array_position(place, e["src"]) - 1).cast("int").alias("src"), (F.array_position(place, e["tgt"]) - 1).cast("int").alias("tgt"), e["edge_type"].alias("type"), e["sent_idx"].alias("sent")))
    odd = F.array(F.struct(F.lit(0).alias("src"), F.lit(0).alias("tgt"), F.lit("grants").alias("type"), F.lit(0).alias("sent")), F.struct(F.lit(0).alias("src"), F.lit(9999).alias("tgt"), F.lit("grants").alias("type"), F.lit(0).alias("sent")))
    good = p.filter("doc_id % 4 <> 0").select("doc_id", F.lit(1).alias("attempt"), F.concat(F.lit("Graph: "), F.to_json(F.struct(nodes.alias("nodes"), F.concat(edges, odd).alias("edges")))).alias("response"))
    return good.unionByName(n.select("doc_id", F.lit(0).alias("attempt"), F.lit("no graph").alias("response")))


def _denied_sql() -> str:
    parts = []
    for kind, words in T.PREDICATES.items():
        some = " or ".join(f"contains(c, '{w}')" for w in words)
        none = " or ".join("contains(c, '" + w.replace("'", "''") + "')" for w in T.NEGATIONS)
        parts.append(f"when edge_type = '{kind}' then len(list_filter(string_split(regexp_replace(low, ';|,|\\band\\b|\\bbut\\b', chr(30), 'g'), chr(30)), lambda c: ({some}) and ({none}))) > 0")
    return "case " + " ".join(parts) + " else false end"


@query("model_parse", f", x as (select e.*, sent.low, e.doc_id % 4 = 0 as fallback from edges e join sent on sent.doc_id = e.doc_id and sent.sent_idx = e.sent_idx) select fallback, src_type, edge_type, tgt_type, count(*) as n from x where fallback or not ({_denied_sql()}) group by all", True)
def _(spark, sf):
    n = _n(spark, sf)
    return specs.model_parsed(n, _model_answers(n)).groupBy("fallback", "src_type", "edge_type", "tgt_type").agg(F.count("*").alias("n"))


#: What a model says of every notice, right or wrong, whatever its text; 4 and 9 are odd nodes.
_SAID = '{"nodes": [{"id": 0, "type": "DataSubject"}, {"id": 1, "type": "ConsentProcess"}, {"id": 2, "type": "Operator"}, {"id": 3, "type": "ThirdParty"}, {"id": 4, "type": "Alien"}], "edges": [%s, {"src": 2, "tgt": 3, "type": "sellsTo", "sent": 0}, {"src": 0, "tgt": 4, "type": "grants", "sent": 0}, {"src": 0, "tgt": 9, "type": "grants", "sent": 0}]}'
_RIGHT = _SAID % '{"src": 0, "tgt": 1, "type": "subjectOf", "sent": 1}'
_WRONG = _SAID % '{"src": 1, "tgt": 0, "type": "subjectOf", "sent": 1}, {"src": 2, "tgt": 1, "type": "grants", "sent": 0}'


@query("model_parse_repaired", f"""
, f as (select doc_id, doc_id % 8 = 5 as fallback, doc_id % 3 = 1 or doc_id % 6 = 0 as mended, case when doc_id % 3 in (1, 2) then 1 when doc_id % 6 = 0 then 2 else 3 end as rounds from notices),
x as (
  select f.doc_id, true as fallback, 0 as rounds, src_type, edge_type, tgt_type from f join edges using (doc_id) where f.fallback
  union all select f.doc_id, false, f.rounds, 'Operator', e.edge_type, 'ThirdParty' from f join (select 'sellsTo' as edge_type) e on not f.fallback left join sent s on s.doc_id = f.doc_id and s.sent_idx = 0 where not coalesce({_denied_sql()}, false)
  union all select f.doc_id, false, f.rounds, 'DataSubject', e.edge_type, 'ConsentProcess' from f join (select 'subjectOf' as edge_type) e on not f.fallback and f.mended left join sent s on s.doc_id = f.doc_id and s.sent_idx = 1 where not coalesce({_denied_sql()}, false))
select fallback, rounds, src_type, edge_type, tgt_type, count(*) as n from x group by all""", True)
def _(spark, sf):
    """Answers that have nothing of the keyword parse: wrong at first, told so up to three times, and mended at once, later, or never."""
    n, k = _n(spark, sf), F.col("doc_id")
    first = n.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("attempt"))
    silent = (k % 8 == 5) | ((k % 4 == 1) & (F.col("attempt") == 0))
    first = first.withColumn("response", F.when(silent & (F.col("attempt") < 3), "I can't say.").otherwise(F.lit("Here: " + _WRONG)))
    told = n.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("round"))
    answer = F.when(k % 3 == 2, "Sorry.").when(k % 3 == 1, _RIGHT).when((k % 6 == 0) & (F.col("round") == 2), _RIGHT).when(F.col("round") == 4, _RIGHT).otherwise(_WRONG)
    found = specs.model_parsed(n, first, repairs=told.withColumn("response", answer))
    return found.groupBy("fallback", "rounds", "src_type", "edge_type", "tgt_type").agg(F.count("*").alias("n"))


@query("arm_outputs", f"""{_AGAIN}, s as (select n.doc_id, n.text, c.flagged, case when c.compliant then d.output else n.text end as scored from notices n join checked c using (doc_id) join done d using (doc_id)),
a as (select 'unconstrained' as arm, text as output from s union all select 'few_shot', case when doc_id % 5 <> 0 then 'Few: ' || text end from s union all select 'critique', 'c' || doc_id from s
  union all select 'regenerate', case when not flagged then text when doc_id % 3 = 0 then 'again ' || doc_id end from s union all select 'flag_only', case when not flagged then text end from s
  union all select 'repair', scored from s)
select arm, count(*) as n, count(output) as recorded, coalesce(sum(length(output)), 0)::bigint as chars from a group by arm""", True)
def _(spark, sf):
    """All six arms for every notice: answers on record, a second answer where the first is flagged, and the repair of the first."""
    n, k = _n(spark, sf), F.col("doc_id").cast("string")
    drafts = n.select("doc_id", F.col("text").alias("unconstrained"), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("Few: "), "text")).alias("few_shot"), F.concat(F.lit("draft REVISED: c"), k).alias("critique"))
    repaired = realize.process_documents(list(LIBRARY), n).select("doc_id", "flagged", "scored_text")
    again = n.filter("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("again "), k).alias("regenerated"))
    return specs.arms(drafts, repaired, again).groupBy("arm").agg(F.count("*").alias("n"), F.count("output").alias("recorded"), F.coalesce(F.sum(F.length("output")), F.lit(0)).cast("long").alias("chars"))


# ---- rule sets


@query("coverage_by_rule", "select r as rule, sum(guarded)::bigint as guarded, sum(structural)::bigint as structural from (select unnest(['r_PC', 'r_WD', 'r_SALE', 'r_RET', 'r_NOTIFY']) as r, unnest([(f_pc > 0)::int, (f_wd > 0)::int, (f_sale > 0)::int, (f_ret > 0)::int, (jurisdiction = 'EU' and bnd > 0)::int]) as guarded, unnest([(bb and not pc)::int, (bb and not wd)::int, (sale > 0)::int, (ind > 0)::int, (bnd > 0)::int]) as structural from fired) group by r", True)
def _(spark, sf):
    return local.coverage_by_rule(list(LIBRARY), _rows(spark, sf))


@query("produce_forbid", f"with {_FACTS} select distinct r.rule, m.rule as forbids, r.type from types r join more m on m.k = 'e' and r.k = 'e' and m.type = r.type where r.part = 'R' and r.rule <> m.rule")
def _(spark, sf):
    return RS.produce_forbid(RS.tables(spark))


#: Edges of nodes, and the dependencies by elements that fit into a left side.
_FITS = """
ends as (select e.rule, e.part, e.src as elem, 'out ' || e.type || ' ' || n.type as way from edge e join node n on n.rule = e.rule and n.part = e.part and n.elem = e.tgt
  union select e.rule, e.part, e.tgt, 'in ' || e.type || ' ' || n.type from edge e join node n on n.rule = e.rule and n.part = e.part and n.elem = e.src where e.src <> e.tgt),
has as (select n.rule, n.part, n.elem, n.type, list(e.way) filter (e.way is not null) as ways from node n left join ends e on e.rule = n.rule and e.part = n.part and e.elem = n.elem group by all),
fresh as (select r.rule, r.type from types r where r.part = 'R' and r.k = 'e' and not exists (select 1 from types l where l.rule = r.rule and l.part = 'L' and l.k = 'e' and l.type = r.type)),
fits as (select distinct d.rule, d.enables from (
  select r.rule, l.rule as enables from made m join has r on m.k = 'n' and r.rule = m.rule and r.part = 'R' and r.elem = m.elem join has l on l.part = 'L' and l.type = r.type where list_has_all(coalesce(r.ways, []), coalesce(l.ways, []))
  union select f.rule, e.rule from fresh f join edge e on e.part = 'L' and e.type = f.type join node s on s.rule = e.rule and s.part = 'L' and s.elem = e.src join node t on t.rule = e.rule and t.part = 'L' and t.elem = e.tgt
    join types x on x.rule = f.rule and x.part = 'R' and x.k = 'n' and x.type = s.type join types y on y.rule = f.rule and y.part = 'R' and y.k = 'n' and y.type = t.type
  ) d join together on together.a = d.rule and together.b = d.enables)"""


@query("rule_dependency_instance", f"with {_FACTS}, {_FITS} select coalesce(t.rule, f.rule) as rule, coalesce(t.enables, f.enables) as enables, t.rule is not null as by_type, f.rule is not null as by_instance from (select distinct rule, enables from dep where mechanism = 'creates') t full join fits f on f.rule = t.rule and f.enables = t.enables")
def _(spark, sf):
    rules = LIBRARY + PROBES
    by_type = RS.dependencies(spark, rules, certify.CREATION).select("rule", "enables").distinct().withColumn("by_type", F.lit(True))
    by_instance = RS.instance_dependencies(spark, rules).withColumn("by_instance", F.lit(True))
    no = F.lit(False)
    return by_type.join(by_instance, ["rule", "enables"], "full_outer").select("rule", "enables", F.coalesce("by_type", no).alias("by_type"), F.coalesce("by_instance", no).alias("by_instance"))


@query("dependency_rejection_rates")
def _(spark, sf):
    return RS.rejection_rates(spark, LIBRARY + PROBES)


@query("cpa_cost_trace")
def _(spark, sf):
    """Without the seconds, which differ from run to run."""
    return RS.cost_trace(spark, LIBRARY + PROBES).drop("seconds")


@query("per_cell_audit", f"""with recursive {_FACTS}, sig as (select c.age, c.jurisdiction, coalesce(string_agg(a.rule, ',' order by a.rule), '') as rules from (select a::int as age, j as jurisdiction from generate_series(0, 120) x(a), (values ('US'), ('EU'), ('UK'), ('US-CA')) v(j)) c left join active a on a.age = c.age and a.jurisdiction = c.jurisdiction group by all),
st as (select *, case when rules = lag(rules) over (partition by jurisdiction order by age) then 0 else 1 end as s from sig), grp as (select *, sum(s) over (partition by jurisdiction order by age) as cell from st),
cells as (select jurisdiction, min(age) as age_lo, max(age) as age_hi, rules from grp group by jurisdiction, cell, rules),
reach as (select c.jurisdiction, c.age_lo, d.rule, d.enables from cells c join dep d on list_contains(string_split(rules, ','), d.rule) and list_contains(string_split(rules, ','), d.enables)
  union select r.jurisdiction, r.age_lo, r.rule, d.enables from reach r join cells c on c.jurisdiction = r.jurisdiction and c.age_lo = r.age_lo join dep d on d.rule = r.enables and list_contains(string_split(c.rules, ','), d.enables))
select c.jurisdiction, c.age_lo, c.age_hi, c.rules, not exists (select 1 from reach r where r.jurisdiction = c.jurisdiction and r.age_lo = c.age_lo and r.rule = r.enables) as acyclic from cells c""")
def _(spark, sf):
    return RS.per_cell(spark, LIBRARY + PROBES)


@query("sublibrary_check", f"with recursive {_FACTS}, walk as (select rule, rule as at, 0 as depth from rules where rule in ({_OWN}) union select walk.rule, dep.enables, depth + 1 from walk join dep on dep.rule = walk.at where dep.enables in ({_OWN}) and depth < 20) select 5::bigint as rules, true as all_discharge, true as acyclic, max(depth)::int as depth from walk")
def _(spark, sf):
    return RS.sublibrary(spark, LIBRARY)


# ---- samples and statistics


@query("overlap_subset", "select item from (select conv_id || '-' || turn as item, row_number() over (order by sha256('11|' || conv_id || '-' || turn)) as k, count(*) over () as n from conversations) where k <= ceil(n * 0.2)")
def _(spark, sf):
    return sampling.overlap_subset(table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("item")), "item")


@query("union_with_full_arm", "with d as (select doc_id, source, row_number() over (partition by source order by sha256('3|' || doc_id)) as k, doc_id % 4 = 0 as own from documents) select doc_id, source, own from d where own or k <= 5")
def _(spark, sf):
    """All documents of one arm, and the first few of each stratum."""
    d = table(spark, sf, "documents").select("doc_id", "source", (F.col("doc_id") % 4 == 0).alias("own")).withColumn("draw", sampling.draw(3, F.col("doc_id")))
    few = d.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("draw"))).filter("k <= 5").drop("k")
    return d.filter("own").unionByName(few.filter("not own")).drop("draw")


@query("scored_units", "select arm, count(*) as n, count(distinct md5(t)) as units from (select 'draft' as arm, text as t from documents where text is not null union all select 'first', left(text, 40) from documents where text is not null) group by arm")
def _(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.col("text").alias("draft"), F.substring("text", 1, 40).alias("first")).unpivot(["doc_id"], ["draft", "first"], "arm", "t")
    return d.groupBy("arm").agg(F.count("*").alias("n"), F.count_distinct(F.md5("t")).alias("units"))


@query("overlay_gated", "select v, count(*) as n from (select case when toxic = 1 and quality = 1 then 'n-a' when doc_id % 7 = 0 then 'no' when doc_id % 4 = 0 then case when quality + (1 - toxic) + (doc_id % 2) >= 2 then 'yes' else 'no' end else case when quality = 1 then 'yes' else 'no' end end as v from labels) group by v")
def _(spark, sf):
    """Labels in layers: the base, the majority on the overlap, a later override; what doesn't apply stays n-a throughout."""
    d = table(spark, sf, "labels").withColumns({"r2": 1 - F.col("toxic"), "r3": (F.col("doc_id") % 2).cast("int")})
    base, vote = (F.when(x == 1, "yes").otherwise("no") for x in (F.col("quality"), stats.majority(["quality", "r2", "r3"])))
    v = F.when((F.col("toxic") == 1) & (F.col("quality") == 1), "n-a").otherwise(F.coalesce(F.when(F.col("doc_id") % 7 == 0, "no"), F.when(F.col("doc_id") % 4 == 0, vote), base))
    return d.groupBy(v.alias("v")).agg(F.count("*").alias("n"))


_DRAWN = "(('0x' || substr(md5('2026|' || b || '|' || pos), 1, 8))::bigint % n)"


@query("cluster_bootstrap_mean", f"""
with c as (select row_number() over (order by source nulls first) - 1 as pos, sum(bad)::double as total, count(*)::double as k from {_LAB} group by source), m as (select count(*)::bigint as n from c),
i as (select b, {_DRAWN} as pick from m, (select b, pos from generate_series(0, 4999) t(b), (select unnest(generate_series(0, (select n - 1 from m))) as pos))), d as (select b, sum(total) / sum(k) as m from i join c on c.pos = pick group by b)
select (select round(sum(total) / sum(k), 6) from c) as mean, round(list_sort(list(m))[126], 6) as lo, round(list_sort(list(m))[4875], 6) as hi from d""")
def _(spark, sf):
    g = _labelled(spark, sf).groupBy("source").agg(F.sum("bad").cast("double").alias("total"), F.count("*").cast("double").alias("n"))
    return stats.cluster_bootstrap_mean(g.withColumn("pos", (F.row_number().over(Window.orderBy("source")) - 1).cast("long")).drop("source"))


@query("cohen_categorical", """
with t as (select quality * 2 + toxic as a, case when doc_id % 6 = 0 then 0 else quality * 2 + toxic end as b from labels), n as (select count(*) as n, avg((a = b)::int) as po from t),
pe as (select sum(x * y)::double as xy from (select a, count(*) as x from t group by a) join (select b as a, count(*) as y from t group by b) using (a))
select n, round(po, 6) as po, round(xy / (n * n), 6) as pe, round(case when xy / (n * n) < 1 then (po - xy / (n * n)) / (1 - xy / (n * n)) end, 6) as kappa, round(2 * po - 1, 6) as pabak from n, pe""")
def _(spark, sf):
    a = F.col("quality") * 2 + F.col("toxic")
    return stats.cohen_categorical(table(spark, sf, "labels").select(a.alias("a"), F.when(F.col("doc_id") % 6 == 0, 0).otherwise(a).alias("b")), "a", "b")


@query("degenerate_codes", "select code, count(*) as n, count(distinct a) + count(distinct b) < 4 as degenerate from (select 'quality' as code, quality as a, 1 - toxic as b from labels union all select 'never', 0, 0 from labels) group by code")
def _(spark, sf):
    l = table(spark, sf, "labels")
    u = l.select(F.lit("quality").alias("code"), F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")).unionByName(l.select(F.lit("never").alias("code"), F.lit(0).alias("a"), F.lit(0).alias("b")))
    return u.groupBy("code").agg(F.count("*").alias("n"), ((F.count_distinct("a") + F.count_distinct("b")) < 4).alias("degenerate"))


@query("repeat_runs", f"select lang, round(avg(r), 6) as mean, round(min(r), 6) as lowest, round(max(r), 6) as highest from (select lang, doc_id % 5 as run, avg(1 - bad) as r from {_LAB} group by all) group by lang")
def _(spark, sf):
    runs = _labelled(spark, sf).groupBy("lang", (F.col("doc_id") % 5).alias("run")).agg(F.avg(1 - F.col("bad")).alias("r"))
    return runs.groupBy("lang").agg(F.round(F.avg("r"), 6).alias("mean"), F.round(F.min("r"), 6).alias("lowest"), F.round(F.max("r"), 6).alias("highest"))
