"""A rolling budget on a stream of calls: each call waits until its cost fits in its key's window.

Calls of a key are admitted in the order of their times and ids. A call is admitted at the first time, not before its own and not
before that of the call ahead of it, at which the costs admitted within the window before, and its own, are within the budget, and
fewer than rate calls were admitted in the window. A cost admitted at t leaves the window at t + seconds. A call that costs more than the
budget can never be admitted: it is given out at its turn without a time, and costs nothing.

State of a key: the calls that may still be overtaken, the costs in the window, and the last time of admission, in RocksDB. An
event-time timer stands at the earliest of the calls: once the watermark has passed it no call can come ahead of it, its time of
admission is settled, and it leaves the stream with it. So the state holds what came within the lateness that is allowed and in the last batch, and
the costs of a window, however long calls are delayed: a table that is replayed must come in batches, in the order of its times.
A restart goes on from the checkpoint. A key's calls are a queue by nature: keys are dealt over tasks, one key's calls are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CALLS = "key string, id bigint, at bigint, cost double"
ADMITTED = "key string, id bigint, at bigint, cost double, admitted_at bigint"
CALL, PIECE = np.dtype([("at", "<i8"), ("id", "<i8"), ("cost", "<f8")]), 10_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def admission(at: int, cost: float, last: int, held: list[tuple[int, float]], budget: float, window: int, rate: int | None = None) -> int:
    """The first time at which a call fits. held: (time, cost) admitted before, in order of time; times in microseconds."""
    start = max(at, last)
    for now in [start, *(t + window for t, _ in held if t + window > start)]:
        inside = [c for t, c in held if t + window > now]
        if sum(inside) + cost <= budget and (rate is None or len(inside) < rate):
            return now
    raise ValueError("the call costs more than the budget")


class _Queue(StatefulProcessor):
    def __init__(self, budget: float, window: int, rate: int | None):
        self.budget, self.window, self.rate = budget, window, rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "calls binary")  # in arrays of CALL, PIECE at most
        self.held = handle.getListState("held", "at bigint, cost double")
        self.last = handle.getValueState("last", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for part in rows:
            calls = np.empty(len(part), dtype=CALL)
            for name in CALL.names:
                calls[name] = part[name]
            new.append(calls)
        yield from self._go_on(key, timerValues.getCurrentWatermarkInMs(), self._calls(new))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._go_on(key, max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), self._calls([]))

    def _all(self, state) -> list[tuple]:
        return [tuple(x) for x in state.get()] if state.exists() else []

    def _calls(self, new: list[np.ndarray]) -> np.ndarray:
        """The calls that wait and the new ones, in the order in which they go."""
        calls = np.concatenate([np.empty(0, dtype=CALL), *(np.frombuffer(x[0], dtype=CALL) for x in self._all(self.waiting)), *new])
        return calls[np.lexsort((calls["cost"], calls["id"], calls["at"]))]

    def _go_on(self, key, now_ms: int, waiting: np.ndarray) -> Iterator[pd.DataFrame]:
        """Gives out the calls that nothing can overtake, and sets a timer at the next."""
        done = int(np.searchsorted(waiting["at"], now_ms * 1000, side="right"))
        held, last = self._all(self.held), int(self.last.get()[0]) if self.last.exists() else -(1 << 62)
        for start in range(0, done, PIECE):
            out = []
            for at, id_, cost in waiting[start : min(start + PIECE, done)].tolist():
                over = cost > self.budget or self.rate == 0
                last = max(at, last) if over else admission(at, cost, last, held, self.budget, self.window, self.rate)
                if not over:
                    held = [x for x in held if x[0] + self.window > last] + [(last, cost)]
                out.append((key[0], id_, at, cost, None if over else last))
            yield pd.DataFrame(out, columns=["key", "id", "at", "cost", "admitted_at"]).astype({"admitted_at": "Int64"})
        if done:
            self.held.put(held) if held else self.held.clear()
            self.last.update((last,))
        left = waiting[done:]
        if len(left):
            self.handle.registerTimer(-(-int(left["at"][0]) // 1000))
            self.waiting.put([(left[i : i + PIECE].tobytes(),) for i in range(0, len(left), PIECE)])
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def limited(calls: DataFrame, budget: float, seconds: float = 60.0, rate: int | None = None, late: str = "10 minutes") -> DataFrame:
    """A stream of (key, id, ts, cost) to (key, id, at, cost, admitted_at): when each call may go, in microseconds of the epoch; null
    where it never may. late: how late a call may come and still have its place. The session's state store must be PROVIDER."""
    d = calls.select("key", "id", "ts", F.unix_micros("ts").alias("at"), "cost").filter("key is not null and id is not null and ts is not null and cost is not null").withWatermark("ts", late)
    return d.groupBy("key").transformWithStateInPandas(_Queue(budget, int(seconds * 1_000_000), rate), ADMITTED, "append", "eventtime")


def run_limited(calls: DataFrame, sink: str, checkpoint: str, budget: float, seconds: float = 60.0, rate: int | None = None, late: str = "10 minutes"):
    """Appends what is limited to a folder of Parquet, as far as there is input; a run that starts again goes on from its checkpoint."""
    spark = calls.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        q = limited(calls, budget, seconds, rate, late).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def usage_totals(calls: DataFrame) -> DataFrame:
    """(key, calls, retries, prompt_tokens, completion_tokens, total_tokens) of (key, retries, prompt_tokens, completion_tokens): what
    was spent, to be added up over any parts of a log."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("retries", "prompt_tokens", "completion_tokens")]
    d = calls.groupBy("key").agg(F.count("*").alias("calls"), *sums)
    return d.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def backoff(attempt: F.Column, throttled: F.Column, base: float = 1.0) -> F.Column:
    """Seconds to wait after a failed attempt, from 0: threefold each time if it was throttled, twofold otherwise."""
    return F.lit(base) * F.pow(F.when(throttled, F.lit(3.0)).otherwise(F.lit(2.0)), attempt.cast("double"))
