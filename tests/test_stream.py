"""The streaming roll-up over many unordered files equals its batch twin, and rows behind a watermark are counted."""

import os
import random
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

from quillspark.session import scratch_path
from quillspark.streaming import metric_stream as MS


def _events(rows):
    df = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    return pa.Table.from_pandas(df, preserve_index=False).cast(pa.schema([
        ("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()),
        ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())]))


def _files(spark, batches):
    local = scratch_path(spark, "stream-src").replace("file:", "")
    os.makedirs(local)
    for i, rows in enumerate(batches):
        pq.write_table(_events(rows), f"{local}/part-{i}.parquet")
        os.utime(f"{local}/part-{i}.parquet", (1_700_000_000 + 10 * i,) * 2)     # the file source reads oldest first
    return local


def _rollup(spark, rows):
    df = spark.createDataFrame(_events(rows).to_pandas())
    return {(r["window_start"], r["run_id"], r["fold"]): (round(r["loss_sum"], 9), r["n"], r["best_loss"], r["steps"])
            for r in MS.rollup(MS.metric_rows(df)).collect()}


def _read(spark, sink):
    return {(r["window_start"], r["run_id"], r["fold"]): (round(r["loss_sum"], 9), r["n"], r["best_loss"], r["steps"])
            for r in MS.latest(spark, sink).collect()}


def test_backlog_of_unordered_files_loses_nothing(spark):
    rng = random.Random(4)
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(43_000)), rng.randrange(5), "x", rng.random(), "{}")
            for i in range(3000)]
    local = _files(spark, [rows[i::7] for i in range(7)])
    sink, dropped = MS.run_metric_stream(spark, local, spark.read.parquet(local).schema, max_files_per_trigger=1)
    assert dropped == 0
    assert _read(spark, sink) == _rollup(spark, rows)


def test_rows_behind_a_given_watermark_are_counted(spark):
    """Late rows inside the watermark merge; those behind it are left out and reported."""
    d = datetime(2024, 1, 5)
    first = [(5, d.replace(hour=10), 1, "x", 1.0, "{}"), (10, d.replace(hour=12), 1, "x", 3.0, "{}")]
    second = [(15, d.replace(hour=12, minute=1), 1, "x", 2.0, "{}")]              # moves the watermark on
    third = [(20, d.replace(hour=11, minute=30), 1, "x", 0.5, "{}"), (25, datetime(2024, 1, 1, 23), 1, "x", 9.0, "{}")]
    local = _files(spark, [first, second, third])
    sink, dropped = MS.run_metric_stream(spark, local, spark.read.parquet(local).schema, watermark="1 hour",
                                         max_files_per_trigger=1)
    assert dropped == 1
    assert _read(spark, sink) == _rollup(spark, first + second + third[:1])


def test_drops_are_counted_over_more_triggers_than_spark_remembers(spark):
    """One file a trigger, 120 triggers, a late row in an early one: the count holds beyond the last hundred."""
    d = datetime(2024, 3, 1)
    batches = [[(i, d + timedelta(hours=3 * i), 1, "x", float(i), "{}")] for i in range(120)]
    batches[5].append((900, d - timedelta(days=30), 1, "x", 1.0, "{}"))
    batches[110].append((901, d - timedelta(days=30), 1, "x", 1.0, "{}"))
    local = _files(spark, batches)
    progress = MS.Progress()
    sink, dropped = MS.run_metric_stream(spark, local, spark.read.parquet(local).schema, watermark="1 hour", max_files_per_trigger=1,
                                         state_partitions=1, progress=progress)
    assert progress.triggers >= 120 and dropped == 2
    assert _read(spark, sink) == _rollup(spark, [r for b in batches for r in b if r[0] < 900])


def test_state_stays_as_small_as_the_disorder(spark):
    """Files in time order need a watermark of a second: old windows leave the state while the backlog grows."""
    most = []
    for days in (8, 24):
        batches = [[(24 * d + h, datetime(2024, 4, 1) + timedelta(days=d, hours=h), h % 3, "x", 0.5, "{}") for h in range(24)] for d in range(days)]
        local = _files(spark, batches)
        schema = spark.read.parquet(local).schema
        assert int(MS.backlog_watermark(spark, local, schema).split()[0]) <= 24 * 3600
        progress = MS.Progress()
        sink, dropped = MS.run_metric_stream(spark, local, schema, max_files_per_trigger=1, state_partitions=1, progress=progress)
        assert dropped == 0 and _read(spark, sink) == _rollup(spark, [r for b in batches for r in b])
        most.append(progress.most_state_rows)
    assert most[1] <= most[0] + 15                          # three times the backlog, the same state
