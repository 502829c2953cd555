"""Token budgets kept up to date as calls arrive.

Each agent and session has a state: tokens used, the call that went over the
budget, and the calls of the last ``late`` span.  A call that comes twice counts
once; calls are taken in the order of their log ids within a micro-batch.  The call
that takes a session over its budget is named once, in the batch in which it
arrives, and every later row of the session carries it.  A session without
calls for ``idle`` (event time) is forgotten; a call after that starts it anew.  Calls
older than ``late`` behind the newest one are dropped by the watermark.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from carelake import reference_data as ref
from carelake.functions.scalars import total_tokens
from carelake.operators.usage import with_budget

#: ``crossed_by``: the call that went over; ``crosses``: it came in this batch.
CHANGES = "AgentName string, SessionID string, used bigint, token_budget bigint, crossed_by bigint, crosses boolean"
STATE_SCHEMA = ("AgentName string, SessionID string, used bigint, token_budget bigint, crossed_by bigint, crosses boolean, "
                "remaining bigint, escalate boolean, epoch bigint")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionBudget(StatefulProcessor):
    def __init__(self, idle: dt.timedelta) -> None:
        self.idle_ms = int(idle.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "used bigint, crossed_by bigint")
        self.seen = handle.getListState("seen", "LogID bigint, at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values("LogID", kind="stable").drop_duplicates("LogID")
        used, crossed_by = self.total.get() or (0, None)
        crosses = False
        # read and written as a whole: a look at each call by itself is a message to the JVM
        seen = dict(self.seen.get())
        new = []
        for log_id, tokens, budget, at in zip(calls["LogID"], calls["tokens"], calls["token_budget"], calls["at"]):
            if int(log_id) in seen:
                continue
            new.append((int(log_id), int(at)))
            used += int(tokens)
            if crossed_by is None and used > budget:
                crossed_by, crosses = int(log_id), True
        self.total.update((used, crossed_by))
        self._remember(seen, new, timerValues.getCurrentWatermarkInMs())
        self._wait(int(calls["at"].max()))
        yield pd.DataFrame({"AgentName": [key[0]], "SessionID": [key[1]], "used": [used], "token_budget": [int(calls["token_budget"].iloc[-1])],
                            "crossed_by": pd.array([crossed_by], dtype="Int64"), "crosses": [crosses]})

    def _remember(self, seen: dict[int, int], new: list[tuple[int, int]], watermark: int) -> None:
        """Calls before the watermark cannot come again."""
        kept = [c for c in seen.items() if c[1] >= watermark]
        new = [c for c in new if c[1] >= watermark]
        if len(kept) == len(seen):
            if new:
                self.seen.appendList(new)
        elif kept or new:
            self.seen.put(kept + new)
        else:
            self.seen.clear()

    def _wait(self, last: int) -> None:
        """One timer per session, after its newest call."""
        due = [t for t in self.handle.listTimers()]
        if not due or max(due) < last + self.idle_ms:
            for t in due:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(last + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.total.clear()
        self.seen.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def usage_budget_stream(usage: DataFrame, budgets: DataFrame, out: str, checkpoint: str,
                        floor: int = ref.MIN_TOKENS_LEFT, available_now: bool = True, late: str = "1 day",
                        idle: dt.timedelta = dt.timedelta(days=7), compact_every: int = 16) -> StreamingQuery:
    """Running token totals per agent and session, and the calls that go over a budget.

    Every micro-batch writes the pairs it changed to ``out/epoch-<n>``; a
    replayed batch overwrites its own folder.  Every ``compact_every`` batches the
    newest state of all pairs becomes ``out/base-<n>`` and what it holds is removed.
    """
    spark = usage.sparkSession
    calls = with_budget(usage.select(
        "AgentName", "SessionID", "LogID", total_tokens("InputTokens", "OutputTokens").cast("bigint").alias("tokens"),
        F.col("RequestTimestamp").cast("timestamp").alias("_time")), budgets)
    timed = calls.withWatermark("_time", late).withColumn("at", F.unix_millis("_time"))
    changed = timed.groupBy("AgentName", "SessionID").transformWithStateInPandas(
        SessionBudget(idle), outputStructType=CHANGES, outputMode="Update", timeMode="EventTime")

    def keep(rows: DataFrame, epoch: int) -> None:
        left = rows.withColumn("remaining", F.col("token_budget") - F.col("used"))
        left.withColumn("escalate", F.col("remaining") < floor).write.mode("overwrite").parquet(f"{out}/epoch-{epoch:012d}")
        base, epochs = _folders(spark, out)
        if len(epochs) >= compact_every:
            _read(spark, out).groupBy("AgentName", "SessionID").agg(_newest()).select("AgentName", "SessionID", "s.*").write.mode(
                "overwrite").parquet(f"{out}/base-{epoch:012d}")
            _remove(spark, [f"{out}/{n}" for n in ([base] if base else []) + epochs])

    # state of this kind is kept in RocksDB, so it may exceed an executor's memory
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS_DB)
    try:
        writer = changed.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _folders(spark: SparkSession, out: str) -> tuple[str | None, list[str]]:
    """The newest finished base, and the finished epochs after it."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(out)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None, []
    done = sorted(s.getPath().getName() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    bases = [n for n in done if n.startswith("base-")]
    base = bases[-1] if bases else None
    return base, [n for n in done if n.startswith("epoch-") and (base is None or n[6:] > base[5:])]


def _read(spark: SparkSession, out: str) -> DataFrame:
    """All rows of the base and the later epochs, with their epoch."""
    base, epochs = _folders(spark, out)
    paths = [f"{out}/{n}" for n in ([base] if base else []) + epochs]
    rows = spark.read.schema(STATE_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], STATE_SCHEMA)
    return rows.withColumn("epoch", F.regexp_extract(F.col("_metadata.file_path"), r"(?:base|epoch)-(\d+)/[^/]*$", 1).cast("bigint")) if paths else rows


def _newest():
    return F.max_by(F.struct("used", "token_budget", "crossed_by", "crosses", "remaining", "escalate"), "epoch").alias("s")


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def current_budgets(spark: SparkSession, out: str) -> DataFrame:
    """Latest state of each agent and session."""
    return _read(spark, out).groupBy("AgentName", "SessionID").agg(_newest()).select(
        "AgentName", "SessionID", "s.used", "s.token_budget", "s.remaining", "s.escalate")


def crossings(spark: SparkSession, out: str) -> DataFrame:
    """The call with which each agent and session went over its budget."""
    newest = _read(spark, out).groupBy("AgentName", "SessionID").agg(_newest())
    return newest.where("s.crossed_by IS NOT NULL").select("AgentName", "SessionID", F.col("s.crossed_by").alias("LogID"))
