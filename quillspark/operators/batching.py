"""Batch packing (C6–C9, C11): length order, fixed-size batches, per-batch padding and trimming, shuffles.

Positions come from the segmented scan in ``positions`` (range partitioning, no single-task window).
Per-batch windows are partitioned by ``batch_id``; a batch is at most ``batch_size`` rows, so they never skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin
from .positions import attach_positions


def length_order(df: DataFrame, len_col: str, id_col: str = "text_id", pos_col: str = "pos") -> DataFrame:
    """Dense position by (length, id) — shortest first, id breaks ties. Ids are unique.

    Only id and length go through the ordering; they are written first, because ranging reads its input twice (sample, then
    rows). Other columns are joined back by id.
    """
    placed = attach_positions(pin(df.select(id_col, len_col)), [len_col, id_col], pos_col=pos_col)
    others = [c for c in df.columns if c not in (id_col, len_col)]
    return df.join(placed.drop(len_col), id_col).select(*df.columns, pos_col) if others else placed


def shuffle_order(df: DataFrame, id_col: str, seed: int, epoch: int, pos_col: str = "pos") -> DataFrame:
    """C11: a seeded permutation per epoch: order by a digest of (seed, epoch, id)."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.lit(epoch), F.col(id_col)).cast("binary"))
    keyed = df.withColumn("_shuffle_key", digest)
    return attach_positions(keyed, ["_shuffle_key", id_col], pos_col=pos_col).drop("_shuffle_key")


def assign_batches(df: DataFrame, batch_size: int, drop_last: bool, pos_col: str = "pos",
                   batch_col: str = "batch_id") -> DataFrame:
    """``batch_id = pos div batch_size``; ``drop_last`` removes the incomplete last batch."""
    out = df.withColumn(batch_col, (F.col(pos_col) / F.lit(batch_size)).cast("long"))
    if drop_last:
        n = df.select(F.count(F.lit(1))).scalar()
        out = out.filter(F.col(batch_col) < F.floor(n / F.lit(batch_size)))
    return out


def batch_max(col: str, batch_col: str = "batch_id"):
    return F.max(col).over(Window.partitionBy(batch_col))


def pad_batch(df: DataFrame, len_col: str, batch_col: str = "batch_id") -> DataFrame:
    """Pad each row to the longest row of its batch; returns the batch length and the pad count."""
    out = df.withColumn("batch_len", batch_max(len_col, batch_col).cast("int"))
    return out.withColumn("n_pad", (F.col("batch_len") - F.col(len_col)).cast("int"))


def trim_batch(df: DataFrame, ids_col: str, mask_col: str, batch_col: str = "batch_id") -> DataFrame:
    """Cut padded sequences to the longest real row of the batch."""
    real = F.aggregate(F.col(mask_col), F.lit(0), lambda acc, m: acc + m.cast("int"))
    # one number a batch is joined back: the sequences are not shuffled to find it
    longest = df.select(batch_col, real.alias("_real")).groupBy(batch_col).agg(F.max("_real").cast("int").alias("trimmed_len"))
    out = df.join(longest, batch_col).select(*df.columns, "trimmed_len")
    return (out.withColumn(ids_col, F.slice(F.col(ids_col), 1, F.col("trimmed_len")))
               .withColumn(mask_col, F.slice(F.col(mask_col), 1, F.col("trimmed_len"))))
