"""Data-set building (D1-D3): balanced one-vs-all sets and per-class samples.

Order inside a class is an MD5 of (id, seed) (stable under repartitioning, the same
in any engine) or the id itself. Rows are ranked within their class by one
distributed index over (class, order), so no class is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedweave.functions.labels import labels_array
from seedweave.operators.windows import global_index


def hash_order(id_col: str, seed: int) -> Column:
    """MD5 of ``id:seed`` as text."""
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))).cast("binary"))


def rank_in_class(rows: DataFrame, id_col: str, label: str, seed: int | None) -> DataFrame:
    """``rows`` with ``_rank``, 1-based within the class, in hash (or id) order; ids are unique within a class."""
    order = [F.col("_order"), F.col(id_col)]
    df = rows.withColumn("_order", hash_order(id_col, seed) if seed is not None else F.lit(""))
    ranked = global_index(df, [F.col(label), *order], "_idx", start=1)
    first = ranked.groupBy(F.col(label).alias("_class")).agg(F.min("_idx").alias("_first"))     # a row per class
    return ranked.join(first, F.col(label).eqNullSafe(F.col("_class"))) \
        .withColumn("_rank", F.col("_idx") - F.col("_first") + 1).drop("_idx", "_order", "_class", "_first")


def one_vs_all(rows: DataFrame, id_col: str, label: str, labels: list[str], seed: int | None = 42) -> DataFrame:
    """For every target label, all its rows plus up to ceil(n_target / (k - 1)) rows of
    each other class, relabelled ``Other``. Returns (target, id, label)."""
    k = len(labels)
    ranked = rank_in_class(rows.select(id_col, label), id_col, label, seed)
    n = rows.groupBy(F.col(label).alias("target")).agg(F.count(F.lit(1)).alias("n_t"))
    quota = n.select("target", F.ceil(F.col("n_t") / F.lit(max(k - 1, 1))).alias("quota"))
    per_target = ranked.select(id_col, label, "_rank", F.explode(labels_array(labels)).alias("target"))
    pos = per_target.where(F.col(label) == F.col("target")).select("target", id_col, F.col(label).alias("out"))
    neg = (per_target.where(F.col(label) != F.col("target")).join(quota, "target").where(F.col("_rank") <= F.col("quota"))
           .select("target", id_col, F.lit("Other").alias("out")))
    return pos.unionByName(neg).withColumnRenamed("out", "label")


def per_class_sample(rows: DataFrame, id_col: str, label: str, n: int, seed: int | None = 42) -> DataFrame:
    """N rows per class (all rows of a smaller class), in hash (or id) order."""
    return rank_in_class(rows, id_col, label, seed).where(F.col("_rank") <= n).drop("_rank")
