"""Token counts of documents in flat token files that have no index: a scan for end-of-document ids."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.llm.shared import new_folder, partitions, read_range, stage, tidy, write_bytes
from kelpline.llm.tokens import PieceEncoder, runs

BLOCK = 1 << 22  # bytes of a file that a task scans at a time
_FILES = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("ordinal", pa.int64()), ("doc_id", pa.int64())])


def _flat(path: str, folder: str, eod: int):
    def run(batches):
        encoder = PieceEncoder.at(path, literal=True)  # a text can't hold the end id
        end = np.array([eod], encoder.dtype).tobytes()
        uri = f"{folder}/{uuid.uuid4().hex}.bin"
        names: list[pa.Array] = []

        def parts():
            for batch in runs(batches):
                names.append(batch.column(0))
                for x in encoder.encode(batch.column(1)):
                    yield x.tobytes() + end

        size = write_bytes(uri, parts())
        n = 0
        for x in names:
            yield pa.RecordBatch.from_arrays([pa.array([uri] * len(x)), pa.array([size] * len(x), pa.int64()), pa.array(range(n, n + len(x)), pa.int64()), x], schema=_FILES)
            n += len(x)
        tidy()

    return run


def write_flat(docs: DataFrame, tokenizer: str, eod: int, folder: str) -> DataFrame:
    """Writes the ids of each whole text and the end-of-document id, one after another, to flat files, one for each task, in input
    order; nothing else is in the files. Returns (file, bytes, ordinal, doc_id): which document came when. Null texts are empty.
    A task that runs again writes a new file; only the files listed in the result count. Strings of special tokens are ordinary text here,
    as the end id is one of those: `<|endoftext|>` in a text ends nothing."""
    return stage(docs.select("doc_id", "text").mapInArrow(_flat(tokenizer, folder, eod), "file string, bytes long, ordinal long, doc_id long"), "flat")


def _scan(dtype: np.dtype, eod: int, block: int):
    """Of each block (file, bytes, at): how many ends it has, and the place of each, as tokens from the file's beginning."""

    def run(batches):
        width = dtype.itemsize
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(read_range(r["file"], r["at"], min(block, r["bytes"] - r["at"])), dtype)
                ends = np.flatnonzero(ids == eod) + r["at"] // width
                last = int(ends[-1]) if len(ends) else None
                yield pa.RecordBatch.from_pylist([{"file": r["file"], "bytes": r["bytes"], "at": r["at"], "n": len(ends), "last": last, "ends": ends.tolist()}], schema=_BLOCKS)

    return run


_BLOCKS = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("last", pa.int64()), ("ends", pa.list_(pa.int64()))])


def token_counts(files: DataFrame, dtype: str, eod: int, block: int = BLOCK) -> DataFrame:
    """files (file, bytes), a row for each flat file of ids of `dtype`. Returns (file, ordinal, start, n_tokens, ended): a row for
    each document: its number within the file, its first token's place there, its tokens without the end id, and whether an end id
    closes it. Tokens after a file's last end id are a document that isn't ended; empty files have none.

    Blocks of `block` bytes are scanned independently. What a block can't know, the number of ends before it and the place of the
    last of them, comes from a prefix scan over the blocks' two numbers; no token is read twice."""
    width = np.dtype(dtype).itemsize
    block -= block % width
    spark = files.sparkSession
    units = files.where("bytes > 0").select("file", "bytes", F.explode(F.expr(f"sequence(0L, (bytes - 1) div {block})")).alias("b")).select("file", "bytes", (F.col("b") * block).alias("at"))
    found = units.repartition(partitions(spark), "file", "at").mapInArrow(_scan(np.dtype(dtype), eod, block), "file string, bytes long, at long, n long, last long, ends array<long>")
    found = stage(found, "ends")
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    scan = found.select("file", "bytes", "at", "n", "last").select(
        "file",
        "at",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("seen"),
        F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(-1)).alias("previous"),
    )
    docs = found.join(scan, ["file", "at"]).select("file", "seen", "previous", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("previous")).otherwise(F.expr("ends[i - 1]")) + 1
    docs = docs.select("file", (F.col("seen") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    whole = found.groupBy("file").agg(F.sum("n").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.first("bytes").alias("bytes"))
    rest = whole.select("file", "ordinal", "start", (F.expr(f"bytes div {width}") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended")).where("n_tokens > 0")
    return docs.unionByName(rest)


def document_token_counts(docs: DataFrame, tokenizer: str, eod: int) -> DataFrame:
    """docs (doc_id long, text, …): encodes them to flat files in the shared folder and counts by scanning these. Returns (doc_id,
    n_tokens), a row for each row of docs. Repeated rows and null doc_ids are counted each on their own; null and empty texts have no
    tokens; long texts run over as many blocks as they need; an empty table gives an empty result; other columns aren't looked at."""
    folder = new_folder(docs.sparkSession, "tokens")
    written = write_flat(docs, tokenizer, eod, folder)
    counts = token_counts(written.where("ordinal = 0").select("file", "bytes"), PieceEncoder.at(tokenizer).dtype.str, eod)
    return written.select("file", "ordinal", "doc_id").join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
