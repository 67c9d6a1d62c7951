"""Roll up a training-metric stream per (day, run, fold) with Structured Streaming.

``readStream`` (file source) → event-time watermark → tumbling window × (run, fold) aggregate in ``update``
mode → ``foreachBatch`` writes each micro-batch's updated rows to the folder of its batch id. Late rows inside the
watermark update their window and are written again; the ``latest`` view keeps the newest version per key. A
replayed batch (after a failure) overwrites its own folder, so the sink is effectively exactly-once.

A backlog is read in file order, not in time order, so a watermark shorter than its disorder would drop rows. Without an explicit
watermark it covers just that disorder: how far any file reaches back behind the newest row of the files read before it. Files
in time order need none, and then windows leave the state as soon as they are over; the state is as large as the disorder, not
as the backlog. Rows that fall behind a given watermark are counted by a listener that sees every trigger.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from ..session import scratch_path

KEY = ["window_start", "run_id", "fold"]


def metric_rows(events: DataFrame) -> DataFrame:
    """events → metric log rows: run = user, fold = event_id % 5, loss = value, batch size n = 1 + event_id % 6."""
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("run_id"),
        (F.col("event_id") % 5).cast("int").alias("fold"),
        F.col("value").alias("loss"),
        (F.lit(1) + F.col("event_id") % 6).cast("long").alias("n"))


def rollup(rows: DataFrame, window: str = "1 day") -> DataFrame:
    """Batch-size-weighted loss sum, batch count, best (lowest) loss per window, run and fold."""
    return (rows.groupBy(F.window("ts", window).alias("w"), "run_id", "fold")
            .agg(F.sum(F.col("loss") * F.col("n")).alias("loss_sum"), F.sum("n").alias("n"),
                 F.min("loss").alias("best_loss"), F.count(F.lit(1)).alias("steps"))
            .select(F.date_format("w.start", "yyyy-MM-dd").alias("window_start"), "run_id", "fold", "loss_sum", "n",
                    "best_loss", "steps"))


def backlog_watermark(spark: SparkSession, source_path: str, schema: T.StructType) -> str:
    """The shortest watermark (in whole seconds) that no row of the files there now is behind.

    The file source reads files by modification time, so a file is late by its oldest row against the newest row of the
    files read before; one row per file decides.
    """
    ts = F.col("ts").cast("timestamp").cast("double")
    files = spark.read.schema(schema).parquet(source_path).groupBy(
        F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file")).agg(
        F.min(ts).alias("low"), F.max(ts).alias("high"))
    # files of one time may be read in any order
    moments = files.groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    before = F.max("high").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    late = moments.select((before - F.col("low")).alias("late")).agg(F.max("late")).first()[0]
    return f"{int(late or 0) + 1} seconds"


class Progress(StreamingQueryListener):
    """Adds up, over all triggers of one query, the rows dropped behind the watermark; keeps the largest state."""

    def __init__(self):
        self.query_id, self.triggers, self.dropped, self.most_state_rows = None, 0, 0, 0
        self._events: list = []
        self._done: set[str] = set()
        self._lock = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        state = [(op.numRowsDroppedByWatermark, op.numRowsTotal) for op in p.stateOperators]
        with self._lock:
            self._events.append((str(p.id), state))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._done.add(str(event.id))
            self._lock.notify_all()

    def wait(self, query_id: str, seconds: float = 120) -> None:
        """Sums of a terminated query; events arrive in order, its end last."""
        with self._lock:
            if not self._lock.wait_for(lambda: query_id in self._done, seconds):
                raise TimeoutError("the end of the stream was not reported")
            own = [state for i, state in self._events if i == query_id]
        self.triggers = len(own)
        self.dropped = sum(n for state in own for n, _ in state)
        self.most_state_rows = max((sum(n for _, n in state) for state in own), default=0)


def run_metric_stream(spark: SparkSession, source_path: str, schema: T.StructType, sink_path: str | None = None,
                      checkpoint: str | None = None, watermark: str | None = None, window: str = "1 day",
                      max_files_per_trigger: int | None = None, state_partitions: int | None = None,
                      progress: Progress | None = None) -> tuple[str, int]:
    """Run the stream over everything available now (``availableNow``); returns the sink path and the number of rows
    dropped because they were behind the watermark (default: one that covers the backlog's disorder).

    The state store gets ``state_partitions`` partitions (default: the cluster's parallelism). Spark fixes that
    number from ``spark.sql.shuffle.partitions`` when a query first starts, so the query runs in a session of its own.
    """
    sink_path = sink_path or scratch_path(spark, "metric-sink")
    checkpoint = checkpoint or scratch_path(spark, "metric-ckpt")
    watermark = watermark or backlog_watermark(spark, source_path, schema)
    progress = progress or Progress()
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(state_partitions or spark.sparkContext.defaultParallelism))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    reader = own.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = metric_rows(reader.parquet(source_path)).withWatermark("ts", watermark)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_path}/batch_id={batch_id}")

    own.streams.addListener(progress)
    try:
        query = (rollup(rows, window).writeStream.outputMode("update").foreachBatch(sink)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
        progress.wait(str(query.id))
    finally:
        own.streams.removeListener(progress)
    return sink_path, progress.dropped


def latest(spark: SparkSession, sink_path: str) -> DataFrame:
    """Newest version of every (window, run, fold) row in the sink."""
    df = spark.read.parquet(sink_path)
    newest = df.groupBy(*KEY).agg(F.max("batch_id").alias("batch_id"))
    return df.join(newest, [*KEY, "batch_id"]).select(*KEY, "loss_sum", "n", "best_loss", "steps")


def finish(df: DataFrame) -> DataFrame:
    """Add the weighted mean; the numerator is rounded to 9 decimals for engine-independent comparison."""
    from ..plans.registry import round_scaled
    return df.withColumn("epoch_loss", round_scaled(F.col("loss_sum"), 9) / F.col("n"))
