"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's documents.

toxicity       documents that the classifier rejects go.
line_dedup     passages that an earlier document holds are deleted; a document that loses all of its text goes.
jaccard_join   of documents that are linked by 5-word shingles at 0.8 or more, over any number of links, the one with the
               smallest id stays.
decontaminate  documents that hold a passage of a benchmark item go.
mixing         the words that the mix takes of each document that is left.

SQL expresses none of the first four, so there is no ORACLE_SQL; tests hold run() against brute force on small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate, jaccard_join, line_dedup, mixing, shared, toxicity
from quillgraph.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = toxicity.fit(docs, shared.table(spark, sf_dir, "labels"))
    shared.release(spark)  # training's memory
    return docs.filter(toxicity.score_column(spark, model, F.col("text")) < 0.5)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    out = line_dedup.dedup_lines(docs)
    removed = out.columns[-1]
    out = out.filter((F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        n = F.when(F.col(removed) == 0, F.col("n_chars")).otherwise(F.length("text"))
        out = out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.clean(docs, shared.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mix(docs, shared.table(spark, sf_dir, "labels").select("doc_id", "quality"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
