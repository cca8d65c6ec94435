"""Ordered operators for each source: anchored batches, high-water de-duplication, stream rotation, polling windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kelpline.functions.time import NANOS
from kelpline.operators.numbering import running


class AnchorFold:
    """Batch numbers by an anchor: a sample before the anchor, or more than `span` after it, begins a new batch and is its anchor."""

    def __init__(self, span: int):
        self.span = span
        self.restart()

    def restart(self):
        self.anchor, self.batch = None, 0

    def run(self, t: np.ndarray) -> np.ndarray:
        out = np.empty(len(t), np.int64)
        k = 0
        if self.anchor is None and len(t):
            self.anchor = int(t[0])
        while k < len(t):
            # The next break is searched in growing steps, so that long and short batches are both found quickly.
            step, end = 16, k
            while end < len(t):
                part = t[end : end + step]
                broken = (part < self.anchor) | (part - self.anchor > self.span)
                if broken.any():
                    end += int(np.argmax(broken))
                    break
                end += len(part)
                step *= 4
            out[k:end] = self.batch
            if end < len(t):
                self.batch += 1
                self.anchor = int(t[end])
                out[end] = self.batch
                end += 1
            k = end
        return out


class RotationFold:
    """Stream numbers: an item begins a new stream if none is open, the open one's age has reached `age`, or it holds something and
    the item would take it over `size`; after the item the stream closes if its age or its bytes have reached the limits."""

    def __init__(self, age: int, size: int):
        self.age, self.size = age, size
        self.restart()

    def restart(self):
        self.open, self.start, self.held, self.stream = False, 0, 0, -1

    def run(self, t: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whole runs of items at a time: where a stream reaches its bytes is looked up in the cumulative sizes (none is negative), and
        up to there the first item that is too late."""
        out = np.empty(len(t), np.int64)
        upto = np.concatenate([[0], np.cumsum(n)])
        k = 0
        while k < len(t):
            if not self.open:
                self.open, self.start, self.held = True, int(t[k]), 0
                self.stream += 1
            full = int(np.searchsorted(upto, self.size - self.held + upto[k], "left"))  # items from full on come after it has closed
            over = int(np.searchsorted(upto, self.size - self.held + upto[k], "right")) - 1  # the item that would take it over `size`
            end = over if over < full and self.held + upto[min(over, len(t))] - upto[k] > 0 else full
            end = max(min(end, len(t)), k)
            # An item that is too late begins the next stream; the first of all closes its own if no age is allowed.
            late = t[k:end] - self.start >= self.age
            first = end if not late.any() else k + int(np.argmax(late))
            if first == k and end > k and not self.held and t[k] == self.start:
                out[k], self.held, self.open = self.stream, int(n[k]), False
                k += 1
                continue
            stop = min(first, end)
            out[k:stop] = self.stream
            self.held += int(upto[stop] - upto[k])
            if stop < len(t) or self.held >= self.size:
                self.open = False
            k = stop
        return out


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[Column], fold, name: str) -> DataFrame:
    """Adds `name`: the fold's number for each row, in `order` within its keys.

    Rows are dealt by key, sorted, and streamed past a fold that keeps a few numbers: a key's rows are never gathered in memory, so
    a source that holds a large part of all rows costs time in one task but no more memory than any other."""
    marked = df.withColumn("__key", F.xxhash64(*keys))
    for i, c in enumerate(inputs):
        marked = marked.withColumn(f"__in{i}", c.cast("long"))
    dealt = marked.repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])
    names, width, many = [*df.columns, name], len(df.columns), len(inputs)
    key_at = [df.columns.index(k) for k in keys]

    def run(batches):
        own = fold()
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows, bool)
            first = tuple(batch.column(i)[0].as_py() for i in key_at)
            change[0] = first != last
            h = batch.column(width).to_numpy()
            change[1:] = h[1:] != h[:-1]
            for i in key_at:  # equal hashes of different keys
                same = np.flatnonzero(~change[1:]) + 1
                if len(same):
                    c = batch.column(i)
                    a, b = c.take(pa.array(same)), c.take(pa.array(same - 1))
                    differs = np.array([x != y for x, y in zip(a.to_pylist(), b.to_pylist())]) if pa.types.is_nested(c.type) else ~pc.fill_null(pc.or_kleene(pc.equal(a, b), pc.and_(a.is_null(), b.is_null())), False).to_numpy(zero_copy_only=False)
                    change[same[differs]] = True
            cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
            values = [batch.column(width + 1 + i).to_numpy() for i in range(many)]
            out = []
            if cuts[0] > 0:
                out.append(own.run(*[v[: cuts[0]] for v in values]))
            for a, b in zip(cuts, cuts[1:]):
                own.restart()
                out.append(own.run(*[v[a:b] for v in values]))
            last = tuple(batch.column(i)[batch.num_rows - 1].as_py() for i in key_at)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(width)], pa.array(np.concatenate(out))], names)

    return dealt.mapInArrow(run, schema)


def anchor_batches(samples: DataFrame, keys: list[str], order: list[str], t_ns: Column, span_ns: int) -> DataFrame:
    """Adds batch: samples of a key (source, and chunk where readers give one), in arrival order, in batches of at most span_ns from the
    batch's first sample; equal stays, backwards time splits."""
    return ordered_fold(samples, keys, order, [t_ns], lambda: AnchorFold(span_ns), "batch")


def stream_rotation(items: DataFrame, keys: list[str], order: list[str], t: Column, size: Column, max_age: int, max_bytes: int) -> DataFrame:
    """Adds stream: the number of the upload stream that takes each item."""
    return ordered_fold(items, keys, order, [t, size], lambda: RotationFold(max_age, max_bytes), "stream")


def highwater(samples: DataFrame, keys: list[str], order: list[str], t: Column) -> DataFrame:
    """Adds accepted: the sample is strictly newer than all before it in arrival order; a source's first always is. A source's samples are
    spread over slices of that order (see numbering.running())."""
    rows = running(samples, keys, order, t, F.max, F.greatest, "__mark", itself=False)
    return rows.withColumn("accepted", F.col("__mark").isNull() | (t > F.col("__mark"))).drop("__mark")


def idle_gaps(items: DataFrame, keys: list[str], order: list[str], t: Column, max_age: int) -> DataFrame:
    """Adds gap, and idle_before: the pause before an item is max_age or longer, so that an idle stream was closed meanwhile. The item
    before is the last in order of those so far."""
    last = F.struct(*order, t.alias("__t"))
    rows = running(items, keys, order, last, F.max, F.greatest, "__last", itself=False)
    gap = t - F.col("__last.__t")
    return rows.withColumn("gap", gap).withColumn("idle_before", F.coalesce(gap >= max_age, F.lit(False))).drop("__last")


def latest(samples: DataFrame, keys: list[str], order: Column, *values: str) -> DataFrame:
    """The values of each key's last sample."""
    return samples.groupBy(*keys).agg(*[F.max_by(v, order).alias(v) for v in values])


def poll_windows(spark, first_to_ms: int, poll_ms: int, lookback_ms: int, polls: int) -> DataFrame:
    """(poll_id, from_ms, to_ms): to is a poll's time in whole milliseconds; from is to minus lookback, or the previous to where lookback
    equals the poll interval, so that windows join without a gap. A shorter lookback leaves gaps by design; a longer one is refused."""
    if lookback_ms > poll_ms:
        raise ValueError("lookback must not exceed the poll interval")
    ids = spark.range(polls).select(F.col("id").cast("int").alias("poll_id"))
    to = F.lit(first_to_ms) + F.col("poll_id").cast("long") * poll_ms
    rows = ids.withColumn("to_ms", to)
    previous = F.lag("to_ms").over(Window.orderBy("poll_id")) if lookback_ms == poll_ms else F.lit(None)
    return rows.select("poll_id", F.coalesce(previous, F.col("to_ms") - lookback_ms).cast("long").alias("from_ms"), "to_ms")


def window_samples(samples: DataFrame, t_ms: Column, first_to_ms: int, poll_ms: int, lookback_ms: int, polls: int) -> DataFrame:
    """Adds poll_id, and keeps what some poll reads. The window is computed from the time, as windows are regular: no range join."""
    k = F.floor((t_ms - first_to_ms + poll_ms) / poll_ms)
    rows = samples.withColumn("poll_id", k.cast("long")).withColumn("__to", F.lit(first_to_ms) + F.col("poll_id") * poll_ms)
    return rows.where((F.col("poll_id") >= 0) & (F.col("poll_id") < polls) & (t_ms >= F.col("__to") - lookback_ms)).drop("__to")


def total_ns(seconds: str, nanos: str) -> Column:
    return F.col(seconds) * F.lit(NANOS) + F.col(nanos).cast("long")
