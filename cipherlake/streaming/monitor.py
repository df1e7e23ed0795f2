"""Continuous monitoring: windows over events, and diffs of successive scans with kept state."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cipherlake.functions.storage import shared_dir


def stream_table(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """A folder or file of Parquet as a stream; files come in the order in which they were written."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def with_event_time(events: DataFrame, column: str, delay: str) -> DataFrame:
    """Event time as TIMESTAMP (watermarks do not take TIMESTAMP_NTZ), with a watermark of ``delay``."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def tumbling(events: DataFrame, size: str, *keys: str, delay: str = "1 hour") -> DataFrame:
    """Counts and sums by fixed window; state older than the watermark is dropped."""
    return windowed(with_event_time(events, "ts", delay), F.window("ts", size), *keys)


def sliding(events: DataFrame, size: str, step: str, *keys: str, delay: str = "1 hour") -> DataFrame:
    return windowed(with_event_time(events, "ts", delay), F.window("ts", size, step), *keys)


def sessions(events: DataFrame, gap: str, *keys: str, delay: str = "1 hour") -> DataFrame:
    """Sessions that end after ``gap`` without an event."""
    return windowed(with_event_time(events, "ts", delay), F.session_window("ts", gap), *keys)


def windowed(events: DataFrame, window: Column, *keys: str) -> DataFrame:
    out = events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", F.round("total", 4).alias("total"))


def run_to_table(stream: DataFrame, name: str, mode: str = "complete", trigger: dict | None = None) -> DataFrame:
    """Run a stream over what is there now and read what it wrote.

    Each micro-batch overwrites (complete) or adds (append) its own folder, so a
    batch that is repeated after a failure writes the same again.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


class Monitor:
    """Diffs each arriving scan against the one before it. [J1 to J4]

    The state is the set of finding keys of the last scan, one folder for each
    micro-batch, so a repeated batch reads the state it read before: its diff,
    the outbox and the counters come out the same. Alerts are rows of the
    outbox; delivering them is left to whoever reads it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, what: str, number: int) -> DataFrame:
        return self.spark.read.schema("key string").parquet(f"{self.path}/{what}/batch={number}")

    def step(self, batch: DataFrame, number: int) -> None:
        now = batch.select(F.concat_ws(":", "rule_id", "file_path", F.col("line_start").cast("string")).alias("key")).distinct()
        now.write.mode("overwrite").parquet(f"{self.path}/keys/batch={number}")
        now = self._read("keys", number)
        before = self._read("keys", number - 1) if number else now.limit(0)
        changes = now.join(before, "key", "left_anti").withColumn("change", F.lit("new")).unionByName(before.join(now, "key", "left_anti").withColumn("change", F.lit("fixed")))
        changes.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{self.path}/outbox/step={number}")

    def run(self, scans: DataFrame, trigger: dict | None = None) -> None:
        query = scans.writeStream.foreachBatch(self.step).option("checkpointLocation", f"{self.path}/state").trigger(**(trigger or {"availableNow": True})).start()
        query.awaitTermination()

    def outbox(self) -> DataFrame:
        return self.spark.read.schema("key string, change string, batch int").parquet(f"{self.path}/outbox")

    def status(self) -> DataFrame:
        """Cumulative counters and the latest change counts."""
        return self.outbox().groupBy("batch", "change").agg(F.count("*").alias("n"))
