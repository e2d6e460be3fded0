"""Run histories (S9): per-round reports and dictionaries, kept by run and round.

A history is a folder ``run=<name>/iteration=<n>`` of Parquet files, so reading one
run or round prunes the others. Writing a round again replaces it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedweave.operators.common import checkpoint_dir

REPORT_SCHEMA = "label string, precision double, recall double, f1 double, support bigint, run string, iteration int"
DICTIONARY_SCHEMA = "label string, word string, run string, iteration int"


def new_history(spark: SparkSession) -> str:
    """A fresh history folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/history-{uuid.uuid4().hex}"


def write_round(report: DataFrame, path: str, run: str, iteration: int) -> None:
    """The report (A22) of one round."""
    out = report.select("label", "precision", "recall", "f1", F.col("support").cast("long").alias("support"))
    out.coalesce(1).write.mode("overwrite").parquet(f"{path}/run={run}/iteration={iteration}")


def write_dictionary(dictionary: DataFrame, path: str, run: str, iteration: int) -> None:
    dictionary.select("label", "word").write.mode("overwrite").parquet(f"{path}/run={run}/iteration={iteration}")


def read_runs(spark: SparkSession, path: str, runs: list[str] | None = None, schema: str = REPORT_SCHEMA) -> DataFrame:
    """All rounds of the runs named (default: of all) with ``run`` and ``iteration``."""
    df = spark.read.schema(schema).parquet(path)
    return df if runs is None else df.where(F.col("run").isin(*runs))
