"""A stream of notices: each micro-batch is parsed and matched within its rows, and appended; usage is summed in a sliding window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import local
from ..operators.rewrite import kept
from ..plans.rules import Rule


def flag_stream(notices: DataFrame, rules: list[Rule], sink: str, checkpoint: str, trigger: dict | None = None):
    """notices: a stream of (doc_id, text, age, jurisdiction). Appends (doc_id, rule, matches) to Parquet, once for each batch."""

    def batch(df: DataFrame, epoch: int) -> None:
        # The graphs are written out, so that what reads them several times doesn't parse again.
        rows = kept(local.graph_rows(df).select("doc_id", "age", "jurisdiction", "nodes", "edges"), "graphs")
        names = F.array(*[F.lit(r.name) for r in rules])
        found = rows.select("doc_id", F.explode(F.transform(local.all_steps(rules), lambda m: m["rule_ord"])).alias("ord")).groupBy("doc_id", F.element_at(names, F.col("ord") + 1).alias("rule")).agg(F.count("*").alias("matches"))
        # A batch that is run again overwrites its own folder.
        found.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    return notices.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def usage_window(events: DataFrame, seconds: int = 60, slide: int = 10, late: str = "2 minutes") -> DataFrame:
    """(window, event_type, tokens) of a stream of (ts, event_type, value)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds", f"{slide} seconds"), "event_type").agg(F.sum("value").alias("tokens"))
