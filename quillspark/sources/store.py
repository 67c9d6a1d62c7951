"""Prediction store: one long, partitioned table for out-of-fold and pseudo-label predictions.

Layout ``<root>/split=<s>/model_id=<m>/fold=<k>/run_ts=<r>/part-*.parquet`` with rows ``(text_id, target, pred)``.
Writes use dynamic partition overwrite, so writing a run again replaces that run of these (model, fold) pairs only;
other runs stay beside it and the ``latest_run`` view picks the newest, instead of renaming folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..targets import TARGETS

STORE_COLUMNS = ["split", "model_id", "fold", "text_id", "target", "pred", "run_ts"]
SPLITS = ("oof", "prev", "curr", "test")


def to_long(wide: DataFrame, id_cols: list[str], pred_prefix: str = "pred_", targets: list[str] | None = None,
            drop_truth: bool = True) -> DataFrame:
    """Wide prediction frame → long ``(id_cols..., target, pred)``.

    Accepts both naming styles: ``pred_<target>`` columns (true targets then dropped) or target-named
    prediction columns.
    """
    targets = targets or TARGETS
    prefixed = [f"{pred_prefix}{t}" for t in targets]
    if all(c in wide.columns for c in prefixed):
        pred_cols = prefixed
    else:
        pred_cols = targets
    value_cols = [F.col(c).cast("double").alias(t) for c, t in zip(pred_cols, targets)]
    narrowed = wide.select(*[F.col(c) for c in id_cols], *value_cols)
    return narrowed.unpivot(id_cols, targets, "target", "pred")


def write_predictions(long_df: DataFrame, root: str, split: str, run_ts: int | None = None) -> None:
    """Write (or replace) one run of the (model, fold) pairs present in ``long_df``; older runs are kept.

    The rows are rebalanced on the partition columns: few files per folder, yet a large (model, fold) is split over
    several tasks (adaptive execution sizes them).
    """
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}; expected one of {SPLITS}")
    out = long_df.withColumn("split", F.lit(split))
    out = out.withColumn("run_ts", F.lit(run_ts if run_ts is not None else 0).cast("long"))
    out = out.select(*STORE_COLUMNS)
    (out.hint("rebalance", "model_id", "fold")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("split", "model_id", "fold", "run_ts").parquet(root))


def read_predictions(spark: SparkSession, root: str, split: str | None = None, models: list[str] | None = None,
                     folds: list[int] | None = None) -> DataFrame:
    """Scan with partition pruning on split / model / fold (filters land in ``PartitionFilters``)."""
    df = spark.read.option("basePath", root).parquet(root).withColumn("run_ts", F.col("run_ts").cast("long"))
    if split is not None:
        df = df.filter(F.col("split") == split)
    if models is not None:
        df = df.filter(F.col("model_id").isin(list(models)))
    if folds is not None:
        df = df.filter(F.col("fold").isin(list(folds)))
    return df


def latest_run(df: DataFrame, keys: tuple[str, ...] = ("split", "model_id", "fold", "text_id", "target")) -> DataFrame:
    """Keep the newest ``run_ts`` per key (a key twice in one run: the larger pred, deterministic).

    Two plain maxima instead of one over structs: hash aggregates with map-side combine, so a key with many runs
    does not pile up in one task.
    """
    newest = df.groupBy(*keys).agg(F.max("run_ts").alias("run_ts"))
    return df.join(newest, [*keys, "run_ts"]).groupBy(*keys, "run_ts").agg(F.max("pred").alias("pred")) \
        .select(*keys, "pred", "run_ts")
