"""Helpers shared by the operators: tables in the cluster's shared folder, input size."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedweave.session import ensure_checkpoint_dir

# Word separators of every operator: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts (one cheap scan of a column), for the number of buckets."""
    return df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0


def parts_for(n_bytes: int, each: int, least: int) -> int:
    """So many buckets that each holds about ``each`` bytes; at least ``least``."""
    return max(least, math.ceil(n_bytes / each))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
