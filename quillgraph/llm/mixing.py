"""Operator 4, mixing sources to target weights: Efraimidis-Spirakis sampling in DataFrame operations.

Method. A document's size is its number of words. Sources get shares of the whole size by weight; no source gets more
than three times its own size, and what is over is shared again by weight (water filling, solved in closed form by one
sort of the sources on their cap per weight). A source first takes complete epochs; for the fraction that is left, each
document draws u**(1/weight) from a hash of its id and a seed, and documents are taken in descending order of the draw
until the prefix sum of sizes comes nearest to the target. Quality weights: 2 for a positive label, 1/2 for a negative
one, 1 for none; a higher weight makes an early place in that order likelier.

Defined results. Null text: size 0. Null source: a source of its own, last in order. Null ids take part as an id of
their own; rows with the same id and source have the same draw, and which of several such rows is taken first is decided
by size. An empty table gives an empty result. Other columns aren't read.

Scale: the order within a source is found in two steps, so that a source with a third of all rows is never sorted in one
task: draws fall into 4096 equal ranges, range sums are added up, and only the one range of each source in which the
target falls is sorted. Shuffled rows hold five short columns, never text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Weights of the sources in order, repeating; a source is taken this many times at most.
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
QUALITY = {1: 2.0, 0: 0.5}
SEED = "mix-1"
RANGES = 4096


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST_EPOCHS) -> DataFrame:
    """(src, named, total) to the same with target: by weight, none above most times its total. One row for each source."""
    order = Window.orderBy(F.col("named").desc(), F.col("src"))
    by_cap = Window.orderBy("cap_per_weight", F.col("named").desc(), "src")
    w = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.col("total") * F.lit(float(most))).withColumn("cap_per_weight", F.col("cap") / F.col("weight"))
    # A source is capped when the level that would satisfy it exceeds what is left over after all sources capped before it.
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = w.withColumn("left", F.sum("total").over(Window.partitionBy()).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("level", F.col("left") / F.sum("weight").over(rest))
    # The level at the first source that isn't capped holds for all that follow.
    w = w.withColumn("place", F.row_number().over(by_cap)).withColumn("open", F.min(F.when(F.col("cap_per_weight") > F.col("level"), F.col("place"))).over(Window.partitionBy()))
    w = w.withColumn("final", F.max(F.when(F.col("place") == F.col("open"), F.col("level"))).over(Window.partitionBy()))
    return w.withColumn("target", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("final")))).select("src", "named", "total", "target")


def mix(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, seed: str = SEED, ranges: int = RANGES) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target of its source, and taken, the words that the mix takes of it.

    quality: (doc_id, quality) labels, if there are any.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"), F.col(source_col).isNotNull().alias("named"), word_count(F.col(text_col)).alias("size"))
    # 48 bits of a hash, as a number strictly between 0 and 1.
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    d = d.withColumn("u", u)
    if quality is not None:
        q = quality.groupBy(F.col("doc_id").alias("qid")).agg(F.max("quality").alias("q")).filter("qid is not null and q is not null")
        weight = F.lit(1.0)
        for value, x in QUALITY.items():
            weight = F.when(F.col("q") == value, F.lit(x)).otherwise(weight)
        d = d.join(q, d.doc_id == q.qid, "left").withColumn("w", weight).drop("qid", "q")
    else:
        d = d.withColumn("w", F.lit(1.0))
    d = d.withColumn("draw", F.when(F.col("w") == 1.0, F.col("u")).otherwise(F.pow("u", 1.0 / F.col("w")))).withColumn("part", F.least(F.floor((1.0 - F.col("draw")) * ranges), F.lit(ranges - 1)).cast("int")).drop("u", "w")
    d = shared.settle(d, "mix-draws")
    parts = d.groupBy("src", "named", "part").agg(F.sum("size").alias("words"))
    parts = shared.settle(parts, "mix-ranges")
    goals = targets(parts.groupBy("src", "named").agg(F.sum("words").alias("total")), weights)
    goals = goals.withColumn("epochs", F.when(F.col("total") > 0, F.least(F.lit(MOST_EPOCHS), F.floor(F.col("target") / F.col("total")))).otherwise(0)).withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("total")))
    # The range of each source in which the prefix sum reaches what is needed, and the sum before it.
    run = Window.partitionBy("src", "named").orderBy("part")
    edge = parts.withColumn("upto", F.sum("words").over(run)).join(goals.select("src", "named", "need"), ["src", "named"]).filter("upto >= need and need > 0")
    edge = edge.groupBy("src", "named").agg(F.min(F.struct("part", (F.col("upto") - F.col("words")).alias("sum_before"))).alias("e")).select("src", "named", F.col("e.part").alias("edge_part"), F.col("e.sum_before").alias("sum_before"))
    goals = shared.settle(goals.join(edge, ["src", "named"], "left"), "mix-goals")
    d = d.join(goals, ["src", "named"])
    extra = F.when((F.col("need") > 0) & (F.col("part") < F.col("edge_part")), F.col("size")).otherwise(F.lit(0))
    settled = d.filter("edge_part is null or part <> edge_part").withColumn("extra", extra)
    order = Window.partitionBy("src", "named").orderBy(F.col("draw").desc(), "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    close = d.filter("part = edge_part").withColumn("upto", F.col("sum_before") + F.sum("size").over(order))
    # The document that crosses the target is taken if that brings the sum nearer to it.
    close = close.withColumn("extra", F.when((F.col("upto") <= F.col("need")) | ((F.col("upto") - F.col("size") < F.col("need")) & (F.col("upto") - F.col("need") <= F.col("need") - (F.col("upto") - F.col("size")))), F.col("size")).otherwise(F.lit(0))).drop("upto")
    return settled.unionByName(close).select("doc_id", "size", F.col("total").alias("source_size"), "target", (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels").select("doc_id", "quality"))


ORACLE = r"""
with q as (select doc_id, max(quality) q from labels where doc_id is not null and quality is not null group by doc_id),
d as (
  select documents.doc_id, coalesce(source, '') src, source is not null as named,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ((('0x' || substr(md5('mix-1|' || coalesce(documents.doc_id::varchar, 'null')), 1, 12))::bigint)::double + 0.5) / 281474976710656.0 as u,
    case when q.q = 1 then 2.0 when q.q = 0 then 0.5 else 1.0 end::double as w
  from documents left join q on documents.doc_id = q.doc_id),
k as (select *, case when w = 1.0 then u else pow(u, 1.0 / w) end as draw from d),
s as (select src, named, sum(size)::double total from k group by all),
s1 as (select *, [5.0, 2.0, 1.0][((row_number() over (order by named desc, src) - 1) % 3 + 1)::int]::double as weight, 3.0 * total as cap from s),
s2 as (select *, cap / weight as cpw from s1),
s3 as (select *, (sum(total) over () - coalesce(sum(cap) over (order by cpw, named desc, src rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cpw, named desc, src rows between current row and unbounded following) as lvl from s2),
sp as (select *, row_number() over (order by cpw, named desc, src) as place from s3),
so as (select *, min(case when cpw > lvl then place end) over () as first_open from sp),
sf as (select *, max(case when place = first_open then lvl end) over () as final from so),
s4 as (select *, case when final is null then cap else least(cap, weight * final) end as target from sf),
s5 as (select *, case when total > 0 then least(3, floor(target / total)) else 0 end as epochs from s4),
s6 as (select *, greatest(0.0, target - epochs * total) as need from s5),
r as (select k.*, s6.total, s6.target, s6.epochs, s6.need,
    sum(k.size) over (partition by k.src, k.named order by k.draw desc, k.doc_id, k.size rows between unbounded preceding and current row) as upto
  from k join s6 on k.src = s6.src and k.named = s6.named)
select doc_id, size, total::bigint as source_size, target,
  (epochs * size + case when need > 0 and (upto <= need or (upto - size < need and upto - need <= need - (upto - size))) then size else 0 end)::bigint as taken
from r
"""
