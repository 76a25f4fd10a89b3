"""Structured Streaming jobs over append-only logs, and how to drain one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shared import fresh_path

c = F.col


#: State that lists and timers need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(stream: DataFrame, name: str, provider: str | None = None) -> DataFrame:
    """What a stream appends until its input is used up, as a table in the shared folder (spark.checkpoint.dir). provider: the state store of this query alone."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    if provider:
        spark.conf.set(key, provider)  # a query keeps the settings that it was started with
    try:
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
    finally:
        spark.conf.set(key, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def operation_rollup(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, operation, n, failures) per window, tumbling, or sliding by `slide`; rows later than the watermark are dropped. events: (ts, operation, success)."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), F.coalesce("operation", F.lit("unknown")).alias("operation"))
    return w.agg(F.count("*").alias("n"), F.count_if(~c("success")).alias("failures")).select(c("window.start").alias("start"), "operation", "n", "failures")


def session_rollup(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """(session, start, end, n) per session window: events of a user with less than gap between them. events: (ts, session)."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "session").agg(F.count("*").alias("n"))
    return w.select("session", c("w.start").alias("start"), c("w.end").alias("end"), "n")


def new_findings(events: DataFrame, key: list[str], late: str = "60 days") -> DataFrame:
    """Each key once, as long as the watermark remembers it. events: (ts, *key)."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key).select(*key)


class _Retries(StatefulProcessor):
    """Holds a session's events until the watermark is past them, then reads them in the order of their time."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a row for each batch of a session's events: reading and writing state costs by the row
        self.waiting = handle.getListState("waiting", "ts array<long>, seq array<long>, type array<string>, tool array<string>, success array<boolean>")
        self.failed = handle.getValueState("failed", "tool string, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        first = None
        for batch in rows:
            ms = batch["ts"].to_numpy("datetime64[us]").astype("int64")
            self.waiting.appendValue((ms.tolist(), batch["seq"].tolist(), batch["type"].tolist(), [None if o is None else str(o) for o in batch["tool"]], batch["success"].astype(bool).tolist()))
            if len(ms):
                first = int(ms.min()) if first is None else min(first, int(ms.min()))
        if first is not None:
            self._wait_for(first)
        return iter(())

    def _wait_for(self, us: int) -> None:
        """One timer, for the first event that waits: it is due when the watermark reaches the next millisecond."""
        self.handle.registerTimer(us // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        mark = timerValues.getCurrentWatermarkInMs()
        rows = [r for held in self.waiting.get() for r in zip(*held)]
        due = sorted(r for r in rows if r[0] // 1000 < mark)
        failed, until = self.failed.get() if self.failed.exists() else (None, None)
        n = 0
        for _, _, kind, tool, success in due:
            if kind == "tool.complete" and not success:
                failed = tool
            elif kind == "tool.start":
                n += failed is not None and tool == failed
                failed = None
        rest = [r for r in rows if r[0] // 1000 >= mark]
        if due:
            self.waiting.clear()
            if rest:
                self.waiting.appendValue(tuple(map(list, zip(*rest))))
                self._wait_for(min(r[0] for r in rest))
            if failed is None:
                self.failed.clear()
            else:
                # a failure is forgotten when nothing comes for so long
                until = max(mark, due[-1][0] // 1000) + self.idle_ms
                self.failed.update((failed, until))
                self.handle.registerTimer(until)
        elif not rows and until is not None and mark >= until:
            self.failed.clear()
        if n:
            yield pd.DataFrame({"session": [key[0]], "retries": [n]})


def tool_retries(events: DataFrame, late: str = "10 minutes", idle_hours: int = 24 * 365) -> DataFrame:
    """(session, retries): retries of a session as the watermark passes them: a start of the tool that failed last, with no start between. events: (ts, session, seq, type, tool, success).

    Events may come in any order within `late`: each waits in a list until a timer says that the watermark is past it, and
    those that are due are read by time, then by seq. So the sums don't depend on how the stream is cut into batches.
    Events later than the watermark are dropped; what the watermark never passes is not told. State is the events
    that wait and the tool that failed last, forgotten after idle_hours without events. Needs the ROCKSDB state store.
    """
    x = events.select("ts", "session", "seq", "type", "tool", "success").withWatermark("ts", late).where("type in ('tool.start', 'tool.complete')")
    return x.groupBy("session").transformWithStateInPandas(_Retries(idle_hours * 3_600_000), "session long, retries long", "append", "EventTime")
