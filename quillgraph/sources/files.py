"""Readers and writers at the edge of the engine."""

from __future__ import annotations

import re
import time
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sampling, specs

SPEC = "hash string, source string, spec string"
#: Columns of the label sheet, and the spellings of an answer that names no violation.
SHEET = ("item_id", "pair_id", "output_label", "prompt_id", "age", "jurisdiction", "applicable_violation_codes", "output_text", "violations_found")
NONE_TOKENS = ("none", "no", "n/a", "na", "-", "0", "[]")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(source, jurisdiction, text) of every .txt file, whole, by name: the file's, or that of its folder where folders are named
    source=..., as a table that is partitioned by source is written."""
    raw = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    name = F.col("source") if "source" in raw.columns else F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "")
    return raw.select(name.cast("string").alias("source"), T.jurisdiction_of(name).alias("jurisdiction"), F.col("value").alias("text")).orderBy("source")


def provisions(texts: DataFrame, article: tuple[str, str] = ("Article 8", "Article 9")) -> DataFrame:
    """(id, source, jurisdiction, tau, text): each source cut by its own rules, long spans in pieces, stored up to a length.

    A source whose name holds gdpr is the stretch from one heading to the next, if both are there, and is then cut like any other.
    """
    clean = T.named_entities(T.strip_markup(F.col("text")))
    begin, end = (F.locate(x, clean) for x in article)
    name = F.col("source")
    by = (
        F.when(name.contains("ccpa"), T.header_segments(clean))
        .when(name.contains("uk_aadc"), F.filter(T.dewrap(T.drop_page_lines(clean)), lambda x: F.length(x) >= T.LEAST_SEGMENT))
        .when(name.contains("gdpr") & (begin > 0) & (end > begin), T.segments(T.article_slice(clean, *article)))
        .otherwise(T.segments(clean))
    )
    spans = texts.select("source", "jurisdiction", F.flatten(F.transform(by, lambda x: T.split_long(x))).alias("spans"))
    # Sources are files: few, and only their numbers of spans are added up in order.
    before = Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.groupBy("source").agg(F.sum(F.size("spans")).alias("n")).select("source", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = spans.join(F.broadcast(offsets), "source").select("source", "jurisdiction", "offset", F.posexplode("spans").alias("pos", "span"))
    return numbered.select(F.format_string("prov_%04d", F.col("offset") + F.col("pos")).alias("id"), "source", "jurisdiction", T.find_tau(F.col("span")).alias("tau"), F.substring("span", 1, T.STORED).alias("text"))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The last line of each hash in a JSON-lines cache; lines that aren't JSON are passed over. Later appends win, by the number
    that append_cache gave them; lines without one count as written when their file was, within it from top to bottom. Of equal
    hashes in one append the last in order of source and spec wins."""
    raw = spark.read.text(path).select("value", F.unix_micros("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))
    r = F.from_json("value", f"{SPEC}, seq bigint", {"mode": "PERMISSIVE"}).alias("r")
    rows = raw.select("time", "file", "line", r).select("time", "file", "line", "r.*").filter("hash is not null")
    place = F.when(F.col("seq").isNull(), F.col("file")), F.when(F.col("seq").isNull(), F.col("line"))
    order = F.struct(F.coalesce("seq", "time").alias("at"), place[0].alias("file"), place[1].alias("line"), F.col("source"), F.col("spec"))
    return last_wins(rows, "hash", order).drop("time", "file", "line", "seq")


def rules_from_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The proposals of a cache whose specs hold, and those that are passed over with their error, without asking a model again."""
    return specs.rules_of(read_cache(spark, path).withColumnRenamed("spec", "spec_json"))


def last_wins(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The row of each key that is last in order; only keys and orders are compared before the rows are joined."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r")).select(key, "r.*")


def append_cache(rows: DataFrame, path: str) -> None:
    """Appends the rows to a cache, with the time of the append in microseconds, which later ones exceed."""
    rows.withColumn("seq", F.lit(time.time_ns() // 1000)).write.mode("append").json(path)


def cache_split(wanted: DataFrame, cache: DataFrame, key: str = "hash", size: int = 5) -> tuple[DataFrame, DataFrame]:
    """Rows that the cache answers, and those left, with the number of their batch of size rows."""
    hits = wanted.join(cache, key, "left_semi")
    misses = wanted.join(cache, key, "left_anti")
    numbered = sampling.ranked(misses, F.substring(key, 1, 2), key)
    return hits, numbered.withColumn("batch", F.floor((F.col("rank") - 1) / size)).drop("rank")


def write_sheet(rows: DataFrame, path: str) -> None:
    """The label sheet as CSV, with a byte-order mark before the header of each file."""
    named = rows.select(*SHEET)
    named.select(F.col(SHEET[0]).alias("﻿" + SHEET[0]), *SHEET[1:]).write.option("header", True).mode("overwrite").csv(path)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.option("header", True).option("multiLine", True).csv(path)
    return d.toDF(*[c.replace("﻿", "") for c in d.columns])


def answers(sheet: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, violations) of answered rows, and (item_id, unknown) of rows with codes that don't exist. Blank: unanswered."""
    given = F.trim(F.coalesce(F.col("violations_found"), F.lit("")))
    none = F.lower(given).isin(*NONE_TOKENS)
    parts = F.filter(F.transform(F.split(given, "[,;\\s]+"), lambda x: F.upper(F.trim(x))), lambda x: x != "")
    d = sheet.filter(given != "").select("item_id", F.when(none, F.array().cast("array<string>")).otherwise(parts).alias("violations"))
    known = codes.agg(F.collect_set("code").alias("known"))
    d = d.crossJoin(F.broadcast(known)).withColumn("unknown", F.array_except("violations", "known"))
    return d.filter(F.size("unknown") == 0).select("item_id", "violations"), d.filter(F.size("unknown") > 0).select("item_id", "unknown")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both; where a key is in both, the new row's values that aren't null."""
    cols = [c for c in old.columns if c != key]
    n = new.select(key, *[F.col(c).alias(f"new_{c}") for c in cols])
    return old.join(n, key, "full_outer").select(key, *[F.coalesce(f"new_{c}", c).alias(c) for c in cols])


def todo(queue: DataFrame, answered: DataFrame, keys: list[str]) -> DataFrame:
    return queue.join(answered, keys, "left_anti")


def unblind(labels: DataFrame, blind_map: DataFrame) -> DataFrame:
    """(pair_id, arm, violations) from labels by letter; an error where a pair lacks an answer."""
    joined = blind_map.join(labels, ["pair_id", "output_label"], "left")
    return joined.select("pair_id", "arm", F.when(F.col("violations").isNull(), F.raise_error(F.concat(F.lit("no answer for "), F.col("pair_id").cast("string")))).otherwise(F.col("violations")).alias("violations"))


def prompt_table(markdown: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(prompt_id, prompt) of the rows `| P1 | ... |` of markdown tables, with the columns to keep."""
    rows = F.filter(F.transform(F.split(text_col, "\n"), lambda x: F.regexp_extract(x, r"^\|\s*([A-Z]+\d+)\s*\|\s*(.*?)\s*\|", 0)), lambda x: x != "")
    d = markdown.select(*(keep or []), F.explode(rows).alias("row"))
    return d.select(*(keep or []), F.regexp_extract("row", r"^\|\s*([A-Z]+\d+)\s*\|", 1).alias("prompt_id"), F.regexp_extract("row", r"^\|[^|]*\|\s*(.*?)\s*\|", 1).alias("prompt"))


def checked_prompts(prompts: DataFrame, own: int = 10, practice: int = 2) -> DataFrame:
    """The prompts, if there are as many of each kind (P and X) as are expected; an error otherwise. For control tables."""
    kinds = prompts.agg(F.count_if(F.col("prompt_id").startswith("P")).alias("own"), F.count_if(F.col("prompt_id").startswith("X")).alias("practice"))
    good = F.assert_true((F.col("own") == own) & (F.col("practice") == practice), F.lit(f"not {own} prompts and {practice} for practice"))
    return prompts.crossJoin(F.broadcast(kinds)).filter(good.isNull()).drop("own", "practice")


def triples(text: str) -> list[tuple[str, str, str]]:
    """`[a, b, c]` lists of a schema file, in order."""
    return [tuple(m) for m in re.findall(r"\[\s*(\w+)\s*,\s*(\w+)\s*,\s*(\w+)\s*\]", re.sub(r"(?m)^\s*#.*$", "", text))]


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(section, place, src_type, edge_type, tgt_type) of the `[a, b, c]` lists in schema files, by the key that they stand under and
    their place in it; comments are passed over. Schema files are control tables: each is read whole."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"(?m)#.*$", "").alias("t"))
    parts = F.filter(F.split("t", r"(?m)^(?=\w+\s*:)"), lambda x: x.rlike(r"^\w+\s*:"))
    d = whole.select(F.explode(parts).alias("part")).select(F.regexp_extract("part", r"^(\w+)", 1).alias("section"), F.posexplode(F.regexp_extract_all("part", F.lit(r"\[\s*\w+\s*,\s*\w+\s*,\s*\w+\s*\]"), F.lit(0))).alias("place", "list"))
    names = F.regexp_extract_all("list", F.lit(r"\w+"), F.lit(0))
    return d.select("section", "place", *[F.get(names, k).alias(c) for k, c in enumerate(("src_type", "edge_type", "tgt_type"))])


def completions(prompts: DataFrame, answered: DataFrame) -> DataFrame:
    """Model answers are a table by prompt hash: prompts with their response, null where none is on record."""
    return prompts.withColumn("prompt_hash", F.sha2("prompt", 256)).join(answered, "prompt_hash", "left")


def digest(rows: DataFrame) -> DataFrame:
    """(d): the number of rows and two sums of parts of their hashes: the same for tables with the same rows, in any order. Sums are
    added up where the rows are, so any table may be frozen."""
    h = F.sha2(F.to_json(F.struct(*rows.columns)), 256)
    parts = [F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)")) for at in (1, 17)]
    return rows.agg(F.concat_ws("-", F.count("*").cast("string"), *[F.coalesce(p, F.lit(0)).cast("string") for p in parts]).alias("d"))


def gated(rows: DataFrame, expected: str) -> DataFrame:
    """The rows, if their digest is the one that is expected; an error otherwise."""
    return rows.crossJoin(F.broadcast(digest(rows))).filter(F.assert_true(F.col("d") == expected, F.lit("the table isn't the frozen one")).isNull()).drop("d")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
