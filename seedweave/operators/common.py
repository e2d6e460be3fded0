"""Small shared helpers for the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    from seedweave.session import ensure_checkpoint_dir
    return ensure_checkpoint_dir(spark)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives lost executors)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str, mode: str = "error", codec: str | None = None) -> DataFrame:
    """``df`` written as Parquet (texts are best with the ``codec`` zstd) and read back; the shuffle files of the job go with it, not when the driver next collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.mode(mode).parquet(path, compression=codec)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written to a Parquet folder of its own under the shared checkpoint folder, and read back."""
    return written(df, _folder(df.sparkSession, name), codec=codec)


def delete_folder(spark: SparkSession, path: str) -> None:
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)


class Scratch:
    """Tables of a job under the shared checkpoint folder that are deleted once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, {}

    def stored(self, df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
        self.add(name, path := _folder(self.spark, name))
        return written(df, path, codec=codec)

    def add(self, name: str, path: str) -> None:
        self.folders.setdefault(name, []).append(path)

    def drop(self, *names: str) -> None:
        """Deletes the tables of these names, or all."""
        for name in names or [*self.folders]:
            for path in self.folders.pop(name, []):
                delete_folder(self.spark, path)


def _sql_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def local_table(spark: SparkSession, rows, columns: list[str], types: list[str] | None = None) -> DataFrame:
    """A small inline table (SQL ``VALUES``): a local relation planned in the JVM.

    Unlike ``createDataFrame`` on a Python list it needs no Python workers, and
    Catalyst knows its exact size, so it is broadcast only because it is small.
    """
    rows = list(rows)
    cols = ", ".join(columns)
    if not rows:
        schema = ", ".join(f"{c} {t}" for c, t in zip(columns, types or ["string"] * len(columns)))
        return spark.createDataFrame([], schema)
    body = ", ".join("(" + ", ".join(_sql_lit(v) for v in r) + ")" for r in rows)
    df = spark.sql(f"SELECT * FROM VALUES {body} AS t({cols})")
    if types:
        df = df.select(*[F.col(c).cast(t).alias(c) for c, t in zip(columns, types)])
    return df
