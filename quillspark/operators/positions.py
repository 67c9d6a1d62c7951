"""Positions and running scans over an ordering, without a single-partition window.

``Window.orderBy`` without ``partitionBy`` moves every row into one task, and a window partitioned by a hot
key moves that key's rows into one task. Both are avoided here with a segmented scan:

1. range-partition on (group, order) and sort within partitions — a hot group spreads over many partitions;
2. pin partition id and in-partition index with a reliable checkpoint (ids stay stable if tasks rerun);
3. aggregate each (partition, group) chunk into a small table (count, sums, minima);
4. carry totals across chunks with a window on that small table;
5. join the carries back (the optimiser picks the join from the measured size) and combine with local values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin

_IDX_MASK = (1 << 33) - 1


def _ranged(df: DataFrame, group_cols: list[str], order_cols: list, num_partitions: int | None) -> DataFrame:
    """Range partitions in key order. Without an explicit count AQE sizes them from the data (coalescing keeps
    neighbouring ranges together, so partition ids stay in key order)."""
    keys = [*group_cols, *order_cols]
    parted = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    ranged = (parted.sortWithinPartitions(*keys)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_idx", F.monotonically_increasing_id().bitwiseAND(F.lit(_IDX_MASK))))
    return pin(ranged)


def attach_positions(df: DataFrame, order_cols: list, group_cols: list[str] | None = None, pos_col: str = "pos",
                     num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row in ``order_cols`` order, restarting per group. Order keys must be unique
    within a group (end them with an id) for a deterministic result."""
    group_cols = list(group_cols or [])
    ranged = _ranged(df, group_cols, order_cols, num_partitions)
    chunks = ranged.groupBy("_pid", *group_cols).agg(F.min("_idx").alias("_first"), F.count(F.lit(1)).alias("_n"))
    carry_w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1) \
        if group_cols else Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carries = chunks.select("_pid", *group_cols, "_first",
                            F.coalesce(F.sum("_n").over(carry_w), F.lit(0)).alias("_before"))
    out = ranged.join(carries, ["_pid", *group_cols])
    out = out.withColumn(pos_col, (F.col("_before") + F.col("_idx") - F.col("_first")).cast("long"))
    return out.drop("_pid", "_idx", "_first", "_before")


def running_aggregates(df: DataFrame, group_cols: list[str], order_cols: list, sums: dict[str, Column] | None = None,
                       mins: dict[str, Column] | None = None, include_current: bool = True,
                       num_partitions: int | None = None) -> DataFrame:
    """Running sums / minima per group in order, as new columns.

    ``include_current=False`` gives the value over the rows strictly before the current one (NULL for the
    first row of a group).
    """
    sums = sums or {}
    mins = mins or {}
    base = df
    for name, expr in {**sums, **mins}.items():
        base = base.withColumn(f"_v_{name}", expr)
    ranged = _ranged(base, group_cols, order_cols, num_partitions)
    frame = (Window.unboundedPreceding, 0) if include_current else (Window.unboundedPreceding, -1)
    local_w = Window.partitionBy("_pid", *group_cols).orderBy("_idx").rowsBetween(*frame)
    local = ranged
    for name in sums:
        local = local.withColumn(f"_l_{name}", F.sum(f"_v_{name}").over(local_w))
    for name in mins:
        local = local.withColumn(f"_l_{name}", F.min(f"_v_{name}").over(local_w))

    aggs = [F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums] + [F.min(f"_v_{n}").alias(f"_t_{n}") for n in mins]
    chunks = ranged.groupBy("_pid", *group_cols).agg(*aggs)
    carry_w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1) \
        if group_cols else Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = [F.sum(f"_t_{n}").over(carry_w).alias(f"_c_{n}") for n in sums] + \
                 [F.min(f"_t_{n}").over(carry_w).alias(f"_c_{n}") for n in mins]
    carries = chunks.select("_pid", *group_cols, *carry_cols)
    out = local.join(carries, ["_pid", *group_cols])
    for name in sums:
        out = out.withColumn(name, _add_nullable(F.col(f"_c_{name}"), F.col(f"_l_{name}")))
    for name in mins:
        out = out.withColumn(name, _least_nullable(F.col(f"_c_{name}"), F.col(f"_l_{name}")))
    drop = ["_pid", "_idx"] + [c for c in out.columns if c.startswith(("_v_", "_l_", "_c_"))]
    return out.drop(*drop)


def _add_nullable(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def _least_nullable(a: Column, b: Column) -> Column:
    return F.least(a, b)  # least() skips NULLs
