"""Latest value per entity with its category, as a Structured Streaming job.

The stream runs in update mode: a batch writes only the entities it changed, to
its own folder, so a batch that is run again replaces its own output and state
grows with the entities, not with the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom.functions.scales import dashboard_category
from airloom.sources.scratch import fresh_path

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def latest(events: DataFrame, entity: str, ts: str = "ts", value: str = "value", tie: str = "event_id") -> DataFrame:
    """Last value per entity; works on a batch and on a stream alike."""
    at = F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"))
    newest = F.max(F.struct(at.alias("at"), F.col(value).alias("value"))).alias("m")
    return events.groupBy(F.col(entity).alias("entity")).agg(newest).select(
        "entity", F.col("m.at.ts").alias("ts"), F.col("m.at.tie").alias("tie"), F.col("m.value").alias("value")
    )


def categorised(rows: DataFrame) -> DataFrame:
    return rows.select("entity", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), "value", dashboard_category("value").alias("category"))


def live_batch(events: DataFrame, entity: str = "event_type") -> DataFrame:
    return categorised(latest(events, entity))


def run_live(spark: SparkSession, folder: str, entity: str = "event_type", pattern: str = "events.parquet") -> DataFrame:
    """Run the stream over the files that are there and return the latest values.

    The state holds the newest event of each entity and grows with the entities only."""
    base = fresh_path(spark, "live")
    stream = (
        spark.readStream.schema(EVENTS)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", 1000)
        .parquet(folder)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = (
        latest(stream, entity)
        .writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    changes = spark.read.parquet(f"{base}/out")
    # An entity occurs once per batch that changed it.
    return categorised(latest(changes, "entity", tie="tie"))
