"""Ordered scans (rank / running sum) that never put a whole group in one task.

``Window.partitionBy(g).orderBy(o)`` sends every row of a group to one task;
with no ``partitionBy`` at all, every row of the table.  A hot language (a
third of all rows) or a global index over all spots would then be one task.
``prefix_scan`` instead:

1. range-partitions on ``(group, order)`` -- the sampler splits a hot group
   over many partitions -- and sorts inside each partition;
2. tags rows with the partition id and ``monotonically_increasing_id`` and
   checkpoints, so the partition boundaries are fixed (and survive executor
   loss) before they are used twice;
3. sums count / value per (partition, group) segment -- at most
   ``partitions + groups`` rows -- and turns them into per-segment offsets
   with a window whose groups hold at most ``partitions`` rows;
4. adds the offset to the position inside the segment.

The caller's ``(group, order)`` must be a total order (unique per row), which
every caller here guarantees with explicit tie-breakers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from langatlas.session import cut_lineage


def _sort_key(c: Column | str) -> Column:
    return F.col(c).asc_nulls_first() if isinstance(c, str) else c


def prefix_scan(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column | str],
                value_col: str | None = None, pos_col: str = "pos",
                before_col: str = "before", total_col: str | None = None,
                num_partitions: int | None = None) -> DataFrame:
    """Add ``pos_col`` (0-based position within the group, in order) and, when
    ``value_col`` is given, ``before_col`` (sum of ``value_col`` over the earlier
    rows of the group; 0 for the first row) and optionally ``total_col`` (sum
    over the whole group)."""
    group_cols = list(group_cols)
    keys = [_sort_key(c) for c in group_cols] + [_sort_key(c) for c in order_cols]
    # Without an explicit count AQE may merge adjacent range partitions, which
    # keeps the global order; ids are taken after that.
    ranged = (df.repartitionByRange(num_partitions, *keys) if num_partitions
              else df.repartitionByRange(*keys))

    staged = cut_lineage(
        ranged
          .sortWithinPartitions(*keys)
          .withColumn("_pid", F.spark_partition_id())
          .withColumn("_mono", F.monotonically_increasing_id()))

    seg_aggs = [F.count(F.lit(1)).alias("_seg_n"), F.min("_mono").alias("_seg_first")]
    if value_col is not None:
        seg_aggs.append(F.sum(value_col).alias("_seg_sum"))
    seg = staged.groupBy("_pid", *group_cols).agg(*seg_aggs)
    earlier = (Window.partitionBy(*group_cols).orderBy("_pid")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = [F.coalesce(F.sum("_seg_n").over(earlier), F.lit(0)).alias("_off_n")]
    if value_col is not None:
        offsets.append(F.coalesce(F.sum("_seg_sum").over(earlier),
                                  F.lit(0).cast(seg.schema["_seg_sum"].dataType)).alias("_off_sum"))
    if value_col is not None and total_col is not None:
        offsets.append(F.sum("_seg_sum").over(Window.partitionBy(*group_cols)).alias(total_col))
    seg = seg.select(F.col("_pid").alias("_spid"),
                     *[F.col(g).alias(f"_sg_{i}") for i, g in enumerate(group_cols)],
                     "_seg_first", *offsets)

    cond = F.col("_pid") == F.col("_spid")
    for i, g in enumerate(group_cols):
        cond = cond & F.col(g).eqNullSafe(F.col(f"_sg_{i}"))
    joined = staged.join(seg, cond)

    out = joined.withColumn(pos_col, F.col("_off_n") + (F.col("_mono") - F.col("_seg_first")))
    if value_col is not None:
        local = (Window.partitionBy("_pid", *group_cols).orderBy("_mono")
                 .rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn(
            before_col,
            F.col("_off_sum") + F.coalesce(F.sum(value_col).over(local),
                                           F.lit(0).cast(seg.schema["_off_sum"].dataType)))
    drop = ["_pid", "_mono", "_spid", "_seg_first", "_off_n", "_off_sum",
            *[f"_sg_{i}" for i in range(len(group_cols))]]
    return out.drop(*[c for c in drop if c in out.columns])


def rank_within(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column | str],
                rank_col: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """1-based row number per group without a one-task-per-group window."""
    out = prefix_scan(df, group_cols, order_cols, pos_col="_pos", num_partitions=num_partitions)
    return out.withColumn(rank_col, (F.col("_pos") + 1).cast("bigint")).drop("_pos")
