"""Ordered folds against plain loops, and the invariants of batches and windows."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kelpline.operators import windows


def loop(times, span):
    out, anchor, batch = [], None, 0
    for t in times:
        if anchor is None:
            anchor = t
        elif t < anchor or t - anchor > span:
            batch, anchor = batch + 1, t
        out.append(batch)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=120), st.integers(0, 40), st.integers(1, 50))
def test_anchor_fold_in_any_pieces(times, span, piece):
    fold = windows.AnchorFold(span)
    t = np.array(times, np.int64)
    got = np.concatenate([fold.run(t[k : k + piece]) for k in range(0, len(t), piece)]) if len(t) else []
    assert list(got) == loop(times, span)


def test_boundary_stays_and_backwards_splits():
    fold = windows.AnchorFold(10)
    assert fold.run(np.array([0, 10, 21, 20, 31], np.int64)).tolist() == [0, 0, 1, 2, 3]


def test_rotation_sends_a_large_item_alone():
    fold = windows.RotationFold(age=100, size=50)
    assert fold.run(np.array([0, 1, 2, 200]), np.array([20, 80, 20, 20])).tolist() == [0, 1, 2, 3]


def test_keys_do_not_leak_into_each_other(spark):
    rows = [(k, i, (i * 37) % 100 + i) for k in ("a", "b", None) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, t long")
    got = {}
    for r in windows.anchor_batches(df, ["k"], ["i"], F.col("t"), 30).collect():
        got.setdefault(r.k, []).append((r.i, r.batch))
    want = loop([(i * 37) % 100 + i for i in range(500)], 30)
    assert set(got) == {"a", "b", None}
    for v in got.values():
        assert [b for _, b in sorted(v)] == want


def test_batch_spans(spark):
    df = spark.range(20).selectExpr("'pv' as k", "cast(id as int) as i", "id * 250000000 as t")
    got = windows.anchor_batches(df, ["k"], ["i"], F.col("t"), 1_000_000_000).groupBy("batch").agg((F.max("t") - F.min("t")).alias("span")).collect()
    assert all(r.span <= 1_000_000_000 for r in got) and len(got) == 4


def test_highwater_accepts_only_newer(spark):
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate([10, 12, 11, 12, 13])], "k string, i int, t long")
    got = windows.highwater(df, ["k"], ["i"], F.col("t")).where("accepted").orderBy("i").collect()
    assert [r.t for r in got] == [10, 12, 13]


def test_windows_join_or_leave_gaps(spark):
    joined = windows.poll_windows(spark, 10_000, 1000, 1000, 5).orderBy("poll_id").collect()
    assert all(b.from_ms == a.to_ms for a, b in zip(joined, joined[1:]))
    gapped = windows.poll_windows(spark, 10_000, 2000, 1000, 5).collect()
    assert all(r.to_ms - r.from_ms == 1000 for r in gapped)
    with pytest.raises(ValueError):
        windows.poll_windows(spark, 0, 1000, 1001, 5)
