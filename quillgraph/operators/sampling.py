"""Counting, validation, deduplication, sampling and shuffling of a corpus.

Seeded orders come from a SHA-256 of seed and id, so that every engine and every rerun agrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def draw(seed, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")), 256)


def counts_share(df: DataFrame, by: str) -> DataFrame:
    """(source, n, share) and a row of the total, whose source is TOTAL. One pass; shares come from the small result."""
    n = df.groupBy(F.coalesce(F.col(by), F.lit("none")).alias("source")).agg(F.count("*").alias("n"))
    every = n.groupBy().agg(F.sum("n").alias("all"))
    rows = n.crossJoin(F.broadcast(every)).select("source", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))
    return rows.unionByName(every.select(F.lit("TOTAL").alias("source"), F.col("all").alias("n"), F.lit(1.0).alias("share")))


def validate(df: DataFrame, id_col: str, by: str, text_col: str, least: int = 5, most_share: float = 0.5, shortest: int = 20, longest: int = 5000) -> DataFrame:
    """(check, subject, value) of each violation: repeated ids, too few spans of a source, too large a share, lengths."""
    per = df.groupBy(F.coalesce(F.col(by), F.lit("none")).alias("subject")).agg(F.count("*").alias("n"))
    every = per.groupBy().agg(F.sum("n").alias("all"))
    rows = [
        df.groupBy(F.col(id_col).cast("string").alias("subject")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate_id").alias("check"), "subject", F.col("n").cast("double").alias("value")),
        per.filter(F.col("n") < least).select(F.lit("few_spans").alias("check"), "subject", F.col("n").cast("double").alias("value")),
        per.crossJoin(F.broadcast(every)).filter(F.col("n") / F.col("all") > most_share).select(F.lit("large_share").alias("check"), "subject", F.round(F.col("n") / F.col("all"), 6).alias("value")),
        df.filter(~F.length(text_col).between(shortest, longest)).select(F.lit("length").alias("check"), F.col(id_col).cast("string").alias("subject"), F.length(text_col).cast("double").alias("value")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def dedup_first(df: DataFrame, text_col: str, order_col: str) -> DataFrame:
    """(order, dedup_key): the first place of each text. Keys are hashed once, and only they and places are shuffled, combined first."""
    keyed = df.select(F.sha2(T.dedup_key(F.col(text_col)), 256).alias("dedup_key"), order_col)
    return keyed.filter("dedup_key is not null").groupBy("dedup_key").agg(F.min(order_col).alias(order_col)).select(order_col, "dedup_key")


def dedup_ratio(df: DataFrame, text_col: str) -> DataFrame:
    return df.agg(F.count(text_col).alias("n"), F.count_distinct(F.sha2(T.dedup_key(F.col(text_col)), 256)).alias("n_distinct")).withColumn("ratio", F.round(1 - F.col("n_distinct") / F.col("n"), 6))


def stratified_sample(df: DataFrame, id_col: str, by: str, n: int, seed=42) -> DataFrame:
    """n rows: floor(n / strata) of each stratum, one at least, then what is missing in turns. Order within a stratum by hash.

    Every task keeps the first n of each stratum before the shuffle, so no stratum is gathered whole.
    """
    d = df.withColumn("draw", draw(seed, F.col(id_col)))
    strata = df.select(by).distinct().count()
    per = max(1, n // max(1, strata))
    ranked = d.withColumn("rk", F.row_number().over(Window.partitionBy(by).orderBy("draw"))).filter(F.col("rk") <= n)
    return ranked.orderBy(F.greatest(F.col("rk") - per, F.lit(0)), by, "rk").limit(n).drop("draw", "rk")


def largest_remainder(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """(by, size, quota): n places in proportion to sizes; the largest fractions take what flooring leaves."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("size"))
    every = sizes.groupBy().agg(F.sum("size").alias("all"))
    q = sizes.crossJoin(F.broadcast(every)).withColumn("base", F.floor(F.col("size") * n / F.col("all"))).withColumn("frac", F.round(F.col("size") * n / F.col("all") - F.col("base"), 9))
    left = q.groupBy().agg((F.lit(n) - F.sum("base")).alias("left"))
    ranked = q.crossJoin(F.broadcast(left)).withColumn("rk", F.row_number().over(Window.orderBy(F.desc("frac"), *by)))
    return ranked.select(*by, "size", (F.col("base") + F.when(F.col("rk") <= F.col("left"), 1).otherwise(0)).cast("long").alias("quota"))


def ranked(df: DataFrame, slice_: Column, *order) -> DataFrame:
    """The rows with rank, their place from 1 in an order of which slice_ is the coarsest part. Slices are ranked apart and then offset."""
    d = df.withColumn("slice", slice_)
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = d.groupBy("slice").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("slice", "offset")
    own = Window.partitionBy("slice").orderBy(*order)
    return d.join(F.broadcast(sizes), "slice").withColumn("rank", F.col("offset") + F.row_number().over(own)).drop("slice", "offset")


def blind_order(df: DataFrame, id_col: str, seed) -> DataFrame:
    """The rows with blind_ord, their place in the seeded order."""
    d = df.withColumn("draw", draw(seed, F.col(id_col)))
    return ranked(d, F.substring("draw", 1, 3), "draw").withColumnRenamed("rank", "blind_ord").drop("draw")


def overlap_subset(df: DataFrame, id_col: str, share: float = 0.2, seed=11) -> DataFrame:
    """ceil(share) of the rows, the first ones in the seeded order, for a second rater."""
    most = -(-df.count() * round(share * 1000) // 1000)
    return blind_order(df, id_col, seed).filter(F.col("blind_ord") <= most).drop("blind_ord")
