"""Label encodings and decoders (X17-X23): per-row array expressions.

A label set is the list of classes, given as an array literal, so encoding and
decoding stay row-local: no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def labels_array(labels: list[str]) -> Column:
    return F.array(*[F.lit(l) for l in labels])


def label_index(df: DataFrame, col: str) -> DataFrame:
    """(label, idx) of the distinct labels in alphabetical order, 0-based; any number of labels."""
    from seedweave.operators.windows import global_index
    labels = df.select(F.col(col).alias("label")).where(F.col("label").isNotNull()).distinct()
    return global_index(labels, [F.col("label")], "idx", start=0).select("label", F.col("idx").cast("int").alias("idx"))


def one_hot(label, labels: list[str]) -> Column:
    """0/1 array over the sorted label list."""
    return F.transform(labels_array(labels), lambda l: (l == _c(label)).cast("int"))


def multi_hot(label_arr, labels: list[str]) -> Column:
    """0/1 array, 1 where the label is in the row's label list."""
    return F.transform(labels_array(labels), lambda l: F.coalesce(F.array_contains(_c(label_arr), l), F.lit(False)).cast("int"))


def dense_scores(score_map, labels: list[str]) -> Column:
    """Scores as an array in label order from a map label -> score (0 when absent)."""
    return F.transform(labels_array(labels), lambda l: F.coalesce(_c(score_map)[l], F.lit(0.0)).cast("double"))


def decode_scores(scores, labels: list[str], threshold: float = 0.5) -> Column:
    """Labels with score > threshold; none -> the argmax (ties: lowest index)."""
    s = _c(scores)
    pairs = F.arrays_zip(s.alias("score"), labels_array(labels).alias("label"))
    over = F.transform(F.filter(pairs, lambda p: p["score"] > threshold), lambda p: p["label"])
    best = F.element_at(labels_array(labels), F.array_position(s, F.array_max(s)).cast("int"))
    return F.when(F.size(over) > 0, over).otherwise(F.array(best))


def decode_one_hot(onehot, labels: list[str]) -> Column:
    """Name of the first position holding 1."""
    pos = F.array_position(_c(onehot), 1).cast("int")
    return F.when(pos > 0, F.element_at(labels_array(labels), pos))


def binarize(scores, threshold: float = 0.5, inclusive: bool = False) -> Column:
    """0/1 per score, strict ``>`` (default) or ``>=``."""
    if inclusive:
        return F.transform(_c(scores), lambda x: (x >= threshold).cast("int"))
    return F.transform(_c(scores), lambda x: (x > threshold).cast("int"))


LABEL_PREFIX = "__label__"


def decode_prefixed(pred_labels, confidences, labels: list[str], threshold: float = 0.5) -> Column:
    """``__label__X`` names + confidences -> multi-hot of those over threshold."""
    pairs = F.arrays_zip(_c(pred_labels).alias("l"), _c(confidences).alias("c"))
    kept = F.transform(F.filter(pairs, lambda p: p["c"] > threshold),
                       lambda p: F.regexp_replace(p["l"], "^" + LABEL_PREFIX, ""))
    return multi_hot(kept, labels)


def hot_count(arr) -> Column:
    """Sum of a 0/1 array (F8: single-label rows have 1)."""
    return F.aggregate(_c(arr), F.lit(0), lambda a, b: a + b)
