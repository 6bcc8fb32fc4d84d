"""Which rule fired: a census by content, where several rules have one name and only their guards tell them apart.

A rule's guard is an interval of ages for each place. Intervals are cut at the bounds of buckets of ages, so that a firing in a
context meets the rules of its name by equality of name, place and bucket, and only then compares ages: a hash join of the log with
a table of rules, not a loop over it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.rules import AGES, Rule

#: Years of a bucket, and the place that stands for any other.
YEARS, ANY = 16, "*"


def intervals(rules: Iterable[Rule]) -> list[tuple[str, str, str, str, int, int, int]]:
    """(name, content_hash, source, place, bucket, low, high): where each rule may act. A rule for any place has one row of ANY."""
    out = []
    for r in rules:
        ages = [a for a in AGES if r.guard.op is None or r.guard.age is None or r.guard.holds(a, next(iter(r.guard.places or {""})))]
        for place in sorted(r.guard.places) if r.guard.places is not None else [ANY]:
            for bucket in sorted({a // YEARS for a in ages}):
                own = [a for a in ages if a // YEARS == bucket]
                out.append((r.name, r.content_hash, r.source or "", place, bucket, min(own), max(own)))
    return out


def resolved(firings: DataFrame, rules: list[Rule], key: str = "doc_id") -> DataFrame:
    """(key, rule, age, jurisdiction) to the same with status and content_hash, source: the rule of that name that may act there. status is
    resolved, ambiguous where several may, or unresolved where none may; the last two have no hash."""
    spark: SparkSession = firings.sparkSession
    held = spark.createDataFrame(intervals(rules), "rule string, content_hash string, source string, place string, bucket int, low int, high int")
    log = firings.select(key, "rule", "age", "jurisdiction", F.monotonically_increasing_id().alias("firing"))
    asked = log.withColumn("place", F.explode(F.array(F.col("jurisdiction"), F.lit(ANY)))).withColumn("bucket", F.floor(F.col("age") / YEARS).cast("int"))
    met = asked.join(F.broadcast(held), ["rule", "place", "bucket"], "left").withColumn("fits", F.col("age").between(F.col("low"), F.col("high")))
    # A firing's two rows stand in one task, since nothing was shuffled: this sums them up there and then by firing.
    one = met.groupBy("firing", key, "rule", "age", "jurisdiction").agg(F.count_if("fits").alias("n"), F.min(F.when(F.col("fits"), F.col("content_hash"))).alias("content_hash"), F.min(F.when(F.col("fits"), F.col("source"))).alias("source"))
    alone = F.col("n") == 1
    status = F.when(alone, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    return one.select(key, "rule", "age", "jurisdiction", status.alias("status"), F.when(alone, F.col("content_hash")).alias("content_hash"), F.when(alone, F.col("source")).alias("source"))


def census(firings: DataFrame, rules: list[Rule], key: str = "doc_id") -> DataFrame:
    """(rule, status, content_hash, source, n, n_hosts): how often each rule fired and on how many hosts, and what can't be told; rules
    that never fired have a row of status never."""
    found = resolved(firings, rules, key).groupBy("rule", "status", "content_hash", "source").agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_hosts"))
    every = firings.sparkSession.createDataFrame([(r.name, r.content_hash, r.source or "") for r in rules], "rule string, content_hash string, source string")
    never = every.join(found.filter("status = 'resolved'"), "content_hash", "left_anti").select("rule", F.lit("never").alias("status"), "content_hash", "source", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("n_hosts"))
    return found.unionByName(never)
