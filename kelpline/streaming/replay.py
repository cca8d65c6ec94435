"""Streams of samples: replay from files, high-water de-duplication with state, and an idempotent sink."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kelpline.functions.time import NANOS


def working_folder(spark: SparkSession, name: str) -> str:
    """A new folder for checkpoints and outputs, in spark.checkpoint.dir; a temporary one where that is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='kelpline-')}"
    return f"{root.rstrip('/')}/kelpline/{name}-{uuid.uuid4().hex[:12]}"


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """New files of a folder (or of a pattern) as a stream; the schema is that of the files that are there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def newer_only(samples: DataFrame, key: str, seconds: str, nanos: str, order: str) -> DataFrame:
    """Samples strictly newer than all before them of their source, over all micro-batches; within one, in the order of `order`. The mark
    is state, so that it survives a restart from the checkpoint. Rows with equal or older times are dropped for good: this is no
    event-time watermark, which would let late rows through until it passes. Times are whole nanoseconds from 1970 in 64 bits, which
    reach to 2262; null times are not newer than anything."""
    columns = samples.columns

    def accept(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        at = rows[seconds].fillna(-(1 << 33)).to_numpy(np.int64) * NANOS + rows[nanos].fillna(0).to_numpy(np.int64)
        mark = state.get[0] if state.exists else np.iinfo(np.int64).min
        upto = np.maximum.accumulate(np.concatenate([[mark], at]))
        state.update((int(upto[-1]),))
        yield rows.loc[at > upto[:-1], columns]

    return samples.groupBy(key).applyInPandasWithState(accept, samples.schema, "mark long", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], Any] | None = None) -> str:
    """Processes what is there and stops. Each micro-batch is written under its number, so that a batch that is run again replaces
    itself. Returns the folder of the output."""
    out = f"{folder}/out"

    def write(batch: DataFrame, number: int) -> None:
        if each:
            each(batch, number)
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return out
