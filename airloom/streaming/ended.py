"""Latest value per entity with an end: a keyed state that goes when the entity falls silent.

Each entity holds one row of state and one event-time timer.  An event moves the timer to
its time plus `idle`; when the watermark passes the timer, the row is put out once (append) and the
state is cleared, so the state holds the entities of the last `idle` only.  An entity
that speaks again begins anew.  Events behind the watermark are dropped and counted by Spark."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from airloom.functions.scales import dashboard_category
from airloom.shipping import ship_package
from airloom.sources.scratch import fresh_path
from airloom.streaming.live import EVENTS

STATE = "at long, tie long, value double, events long"
ENDED = "entity string, at long, tie long, value double, events long"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class UntilSilent(StatefulProcessor):
    """The newest event of a key; times are microseconds since 1970."""

    def __init__(self, idle_us: int):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.newest.get() if self.newest.exists() else None
        events = known[3] if known else 0
        best = tuple(known[:3]) if known else None
        for frame in rows:
            last = frame.sort_values(["at", "tie"], kind="stable").iloc[-1]
            found = (int(last["at"]), int(last["tie"]), None if pd.isna(last["value"]) else float(last["value"]))
            best = found if best is None or found[:2] >= best[:2] else best
            events += len(frame)
        self.newest.update((*best, events))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((best[0] + self.idle_us) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, tie, value, events = self.newest.get()
        self.newest.clear()
        yield pd.DataFrame({"entity": [key[0]], "at": [at], "tie": [tie], "value": [value], "events": [events]})

    def close(self) -> None:
        pass


def until_silent(events: DataFrame, entity: str, idle: str, delay: str, tie: str = "event_id") -> DataFrame:
    """The last event of each entity, once, when the entity has been silent for `idle`, on a
    stream of (ts timestamp, value).  `delay` is how late an event may come.  Events without a time,
    an entity or a tie are left out."""
    ship_package(events.sparkSession)
    rows = events.filter(F.col("ts").isNotNull() & F.col(entity).isNotNull() & F.col(tie).isNotNull()).withWatermark("ts", delay)
    slim = rows.select(F.col(entity).cast("string").alias("entity"), "ts", F.unix_micros("ts").alias("at"), F.col(tie).cast("long").alias("tie"), F.col("value").cast("double").alias("value"))
    return slim.groupBy("entity").transformWithStateInPandas(UntilSilent(int(pd.Timedelta(idle).value // 1000)), ENDED, "append", "eventTime")


@dataclass
class Ended:
    """What a run put out, the events it dropped as late, and the rows of state it left."""

    rows: DataFrame
    late: int
    open: int


def run_until_silent(spark: SparkSession, folder: str, entity: str = "user_id", idle: str = "6 hours", delay: str = "1 hour", pattern: str = "*.parquet", files: int = 1000) -> Ended:
    """Run over the files that are there, `files` in a batch, in order of their times."""
    base = fresh_path(spark, "ended")
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)
        rows = until_silent(stream.withColumn("ts", F.col("ts").cast("timestamp")), entity, idle, delay)
        query = rows.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)
    steps = [s for p in query.recentProgress for s in p["stateOperators"]]
    late = sum(s["numRowsDroppedByWatermark"] for s in steps)
    out = spark.read.schema(ENDED).parquet(f"{base}/out")
    return Ended(out, late, steps[-1]["numRowsTotal"] if steps else 0)


def ended_rows(rows: DataFrame) -> DataFrame:
    """Entity, time, value, category and number of events, as shown."""
    time = F.date_format(F.timestamp_micros("at"), "yyyy-MM-dd HH:mm:ss")
    return rows.select("entity", time.alias("time"), "value", dashboard_category("value").alias("category"), "events")


def ended_batch(events: DataFrame, entity: str = "user_id", idle: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """The same over a table at once: what had been silent when the last event came."""
    rows = events.filter(F.col("ts").isNotNull() & F.col(entity).isNotNull() & F.col("event_id").isNotNull())
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    newest = F.max(F.struct(at.alias("at"), F.col("event_id").alias("tie"), "value")).alias("m")
    last = rows.groupBy(F.col(entity).cast("string").alias("entity")).agg(newest, F.count(F.lit(1)).alias("events")).select("entity", "m.*", "events")
    mark = last.agg(F.max("at") - int(pd.Timedelta(delay).value // 1000)).scalar()
    return ended_rows(last.filter(F.col("at") + int(pd.Timedelta(idle).value // 1000) <= mark))


def live_ended(spark: SparkSession, folder: str) -> DataFrame:
    return ended_rows(run_until_silent(spark, folder, pattern="events.parquet").rows)
