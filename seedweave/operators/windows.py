"""Window-style operators: latest row, first row, argmax, priority order, and a
distributed consecutive index (W1-W3, W8, W9, T1, T5).

``global_index`` never moves all rows into one partition: it range-partitions
and sorts, counts rows per partition (a tiny table), turns the counts into
offsets and adds the position inside the partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN_PRIORITY = 1_000_000


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def latest_per_key(df: DataFrame, keys, order_desc, tie=None) -> DataFrame:
    """The row with the largest ``order_desc`` per key (explicit tie key)."""
    order = [F.desc(order_desc)] + ([F.asc(t) for t in tie] if tie else [])
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_per_key(df: DataFrame, keys, order_asc) -> DataFrame:
    """Drop duplicates by key, keeping the first row in ``order_asc`` order."""
    w = Window.partitionBy(*keys).orderBy(*[F.asc(o) for o in order_asc])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def argmax_per_group(df: DataFrame, group, value, tie) -> DataFrame:
    """The row with the largest value per group; ties go to the smallest ``tie``."""
    w = Window.partitionBy(*group).orderBy(F.desc(value), F.asc(tie))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def priority_rank(col, priority: list[str]) -> Column:
    """1-based position in a priority list; unknown values sort last."""
    pos = F.array_position(F.array(*[F.lit(p) for p in priority]), _c(col))
    return F.when(pos > 0, pos).otherwise(F.lit(UNKNOWN_PRIORITY)).cast("int")


def global_index(df: DataFrame, order: list, name: str = "idx", start: int = 1,
                 partitions: int | None = None) -> DataFrame:
    """Consecutive index over a total order, computed without a single-partition window.

    ``order`` must be a total order (end with a unique key) so that the index
    is deterministic. The sorted, range-partitioned rows are checkpointed so
    that the per-partition counts and the row positions see the same layout.
    """
    from seedweave.operators.common import cut_lineage

    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered = cut_lineage(ordered.withColumn("_pid", F.spark_partition_id())
                          .withColumn("_mid", F.monotonically_increasing_id()))
    counts = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_base"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: a table of at most `n` rows, safe to broadcast.
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    out = ordered.join(F.broadcast(offsets.select("_pid", "_off", "_base")), "_pid")
    return out.withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_base") + start).cast("long")) \
        .drop("_pid", "_mid", "_off", "_base")
