"""Frames on their way out: validation, requests, dispatch, accounting and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.operators.numbering import numbered


def check_frames(frames: DataFrame) -> DataFrame:
    """frames (root_source, ts_list, columns array). Adds error: a frame needs timestamps and at least one column with values."""
    none = F.coalesce(F.size("ts_list"), F.lit(0)) <= 0
    empty = F.coalesce(F.size("columns"), F.lit(0)) <= 0
    return frames.withColumn("error", F.when(none, "no timestamps").when(empty, "no columns"))


def error_counts(checked: DataFrame) -> DataFrame:
    """Failures for each source. A batch without root source is refused before its frames are looked at: those count nowhere."""
    return checked.where("error is not null and coalesce(root_source, '') <> ''").groupBy("root_source", "error").agg(F.count("*").alias("failures"))


def enqueued() -> Column:
    """Whether a checked frame gets into a worker's queue: its batch has a root source, and it has timestamps. Columns are looked at later,
    when its request is built."""
    return (F.coalesce("root_source", F.lit("")) != "") & (F.coalesce(F.size("ts_list"), F.lit(0)) > 0)


def accept_batches(frames: DataFrame) -> DataFrame:
    """(batch_id, n_frames, n_enqueued, accepted): a batch is accepted if it has a root source and at least one frame of it was enqueued."""
    rows = frames.groupBy("batch_id").agg(F.count("*").alias("n_frames"), F.count_if(enqueued()).alias("n_enqueued"))
    return rows.withColumn("accepted", F.col("n_enqueued") > 0)


def requests(frames: DataFrame, provider: str, order: list[str]) -> DataFrame:
    """One request for each enqueued frame that has columns: provider, request_id and the frame's source; tags don't go along. The number
    in the id counts a stream's frames over all its sources, those included that turn out to have no columns."""
    n = F.row_number().over(Window.partitionBy("stream_start").orderBy(*order)) - 1
    rows = check_frames(frames.where(enqueued()).withColumn("n", n)).where("error is null")
    name = F.concat_ws("_", F.lit("pv_stream"), F.col("stream_start").cast("string"), "root_source", F.col("n").cast("string"))
    return rows.select(F.lit(provider).alias("provider_id"), name.alias("request_id"), "root_source", F.size("ts_list").alias("events"))


def round_robin(frames: DataFrame, order: list[str], workers: int) -> DataFrame:
    """Adds worker: enqueued frames in turn, over batches too; others have no turn and aren't returned.

    The order is global; the numbering is done by slices of it (see numbering.numbered())."""
    return numbered(frames.where(enqueued()), order, "__n").withColumn("worker", F.pmod("__n", F.lit(workers)).cast("int")).drop("__n")


def ack_status(acks: DataFrame) -> DataFrame:
    """acks (sent, acked). Adds status."""
    status = F.when(F.col("acked") < 0, "INVALID").when(F.col("acked") < F.col("sent"), "INCOMPLETE").when(F.col("acked") > F.col("sent"), "EXTRA").otherwise("OK")
    return acks.withColumn("status", status)


def payload_bytes(names: Column, values: Column, times: Column) -> Column:
    """A frame's size by a declared formula: its names, 8 bytes for each value, 12 for each timestamp."""
    return (names + 8 * values + 12 * times).cast("long")


def write_requests(batch: DataFrame, path: str) -> None:
    """The sink of a stream's micro-batch: appended once, under its batch id."""
    batch.write.mode("overwrite").parquet(path)
