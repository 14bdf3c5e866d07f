"""Structured Streaming: incremental filtering of new files, resumable output and a registry of live workers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def filter_new_files(spark: SparkSession, source: str, schema: str, transform, target: str, checkpoint: str, files: int = 100) -> StreamingQuery:
    """Apply ``transform`` to files as they come; the checkpoint lets a restart go on where it stopped. Bad files are skipped."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("ignoreCorruptFiles", "true").json(source)
    return transform(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows without a result yet."""
    return todo.join(done, key, "left_anti")


def counts_by_window(events: DataFrame, time: str, size: str, late: str, *keys: str) -> DataFrame:
    """Event counts by window and key; on a stream the watermark bounds the state."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("n"))


def live_workers(beats: DataFrame, worker: str, time: str, ttl_seconds: int) -> DataFrame:
    """Each worker's last beat, for those heard within ``ttl_seconds`` of the newest beat of all."""
    last = beats.groupBy(worker).agg(F.max(time).alias("last"))
    newest = last.agg(F.max("last").alias("newest"))
    return last.crossJoin(F.broadcast(newest)).where(F.unix_timestamp(F.col("newest").cast("timestamp")) - F.unix_timestamp(F.col("last").cast("timestamp")) <= ttl_seconds).drop("newest")


def shortest_queue(workers: DataFrame, group: str, worker: str, queue: str, speed: str) -> DataFrame:
    """The worker of each group with the least queue by speed; ties go to the smaller name."""
    return workers.groupBy(group).agg(F.min_by(worker, F.struct(F.col(queue) / F.col(speed), F.col(worker))).alias(worker))


def running_mean(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("mean", F.avg(value).over(w))
