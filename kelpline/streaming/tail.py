"""The archiver followed live: windows, de-duplication, batches and requests, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from kelpline.operators import delivery, windows
from kelpline.sources import registry
from kelpline.streaming.replay import newer_only


def batches(samples: DataFrame, span_s: int) -> DataFrame:
    """Samples (pv, arrival_seq, epoch_seconds, nanoseconds, …) of one window as frames: (root_source, batch, ts_list, columns), a row for each
    batch of at most span_s from its first sample, in arrival order within the source."""
    at = samples.withColumn("t", windows.total_ns("epoch_seconds", "nanoseconds"))
    split = windows.anchor_batches(at, ["pv"], ["arrival_seq"], F.col("t"), span_s * 1_000_000_000)
    stamp = F.struct("arrival_seq", "epoch_seconds", "nanoseconds")
    rows = split.groupBy(F.col("pv").alias("root_source"), "batch").agg(F.array_sort(F.collect_list(stamp)).alias("s"))  # a batch is span_s long
    return rows.select("root_source", "batch", F.transform("s", lambda x: F.struct(x.epoch_seconds, x.nanoseconds)).alias("ts_list"), F.array("root_source").alias("columns"))


def follow(spark: SparkSession, folder: str, span_s: int, provider: str, **options: str) -> StreamingQuery:
    """Polls the archiver each poll_s seconds, drops samples that aren't newer than all before them of their source, splits each window into
    batches, and writes these and their requests under the micro-batch's number, so that one that is run again replaces itself.
    options: those of the data source. The folder holds `samples`, `frames` and `requests` of each micro-batch and the checkpoint."""
    fresh = newer_only(registry.create("archiver_tail", spark, **options), "pv", "epoch_seconds", "nanoseconds", "arrival_seq")

    def deliver(window: DataFrame, number: int) -> None:
        window.write.mode("overwrite").parquet(f"{folder}/samples/window={number}")
        held = window.sparkSession.read.schema(window.schema).parquet(f"{folder}/samples/window={number}")
        frames = batches(held, span_s).withColumn("stream_start", F.lit(number))
        frames.write.mode("overwrite").parquet(f"{folder}/frames/window={number}")
        sent = window.sparkSession.read.schema(frames.schema).parquet(f"{folder}/frames/window={number}")
        delivery.write_requests(delivery.requests(sent, provider, ["root_source", "batch"]), f"{folder}/requests/window={number}")

    query = fresh.writeStream.foreachBatch(deliver).option("checkpointLocation", f"{folder}/checkpoint")
    return query.trigger(processingTime=f"{options['poll_s']} seconds").start()
