"""File sources and sinks: CSV per city, JSON documents and feeds, keyed tables,
and materialised results with an age limit."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airloom.model import LANDED_VALUES, MEASURES, RAW_CSV


def write_city_csv(df: DataFrame, path: str) -> None:
    """One folder per city, header on every file."""
    df.write.option("header", True).partitionBy("city_key").csv(path)


def read_city_csv(spark: SparkSession, path: str) -> DataFrame:
    """All city files by glob.  The key comes from the path, the discarded monthly
    column is not kept."""
    raw = spark.read.schema(RAW_CSV).option("header", True).csv(f"{path}/*/*.csv")
    key = F.regexp_extract(F.col("_metadata.file_path"), r"city_key=([^/]+)/", 1)
    return raw.withColumn("city_key", F.lower(key)).drop("aqi_monthly")


def read_staging_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bulk load: columns by position, header skipped, last column dropped."""
    raw = spark.read.schema(RAW_CSV).option("header", True).option("enforceSchema", True).csv(path)
    return raw.select(F.col("city").alias("city_name"), "date", *MEASURES)


def write_feed(df: DataFrame, path: str) -> None:
    """A landed sensor feed as JSON lines, one folder per sensor."""
    df.write.partitionBy("sensor").json(path)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    extra = T.StructType([f for f in LANDED_VALUES.fields] + [T.StructField("load_seq", T.IntegerType())])
    return spark.read.schema(extra).json(path)


def write_documents(df: DataFrame, path: str, by: str | None = None) -> None:
    """Result documents as JSON, one folder per value of `by`."""
    writer = df.write.partitionBy(by) if by else df.write
    writer.json(path)


def read_documents(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def append_keyed(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Insert-select into a keyed table: only keys the table does not hold yet, each once.

    Of rows with one key in the batch, the one with the smallest values goes in."""
    spark = df.sparkSession
    rest = [c for c in df.columns if c not in keys]
    fresh = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)
    one = fresh
    if _exists(spark, path):
        held = spark.read.schema(df.schema).parquet(path).select(*keys)
        fresh = one.join(held, list(keys), "left_anti").select(*df.columns)
    fresh.write.mode("append").parquet(path)


class ResultStore:
    """Results kept as written tables until they are older than `ttl` seconds.

    A result is addressed by its name and parameters.  Each refresh writes a new
    version folder, so a reader of the old version is not disturbed."""

    def __init__(self, spark: SparkSession, folder: str, ttl: float, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.ttl, self.clock = spark, folder, ttl, clock

    def _home(self, name: str, params: dict) -> str:
        digest = hashlib.sha256(json.dumps([name, params], sort_keys=True, default=str).encode()).hexdigest()
        return f"{self.folder}/{name}-{digest[:16]}"

    def _versions(self, home: str) -> list[int]:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        done = [s.getPath() for s in fs.listStatus(at) if _exists(self.spark, f"{s.getPath().toString()}/_SUCCESS")]
        return sorted(int(p.getName()) for p in done)

    def get(self, name: str, params: dict, build: Callable[[], DataFrame]) -> DataFrame:
        home = self._home(name, params)
        now = int(self.clock() * 1000)
        fresh = [v for v in self._versions(home) if now - v < self.ttl * 1000]
        version = fresh[-1] if fresh else now
        if not fresh:
            build().write.mode("overwrite").parquet(f"{home}/{version}")
        return self.spark.read.parquet(f"{home}/{version}")

    def sweep(self, name: str, params: dict) -> int:
        """Delete versions older than the limit; returns how many."""
        home = self._home(name, params)
        now = int(self.clock() * 1000)
        old = [v for v in self._versions(home) if now - v >= self.ttl * 1000]
        for v in old:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{home}/{v}")
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        return len(old)
