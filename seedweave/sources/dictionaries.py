"""Seed dictionaries, tag maps and other JSON / CSV side inputs.

Dictionaries are read with Spark (``wholetext`` + ``from_json``) so that the
same code reads one file or a folder of per-round files on shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED_SCHEMA = "map<string, array<string>>"


def seeds_from_dict(spark: SparkSession, seeds: dict) -> DataFrame:
    """(label, word, pos) from an in-memory {label: [word]} dictionary."""
    from seedweave.operators.common import local_table
    rows = [(label, word, i) for label, words in seeds.items() for i, word in enumerate(words)]
    return local_table(spark, rows, ["label", "word", "pos"], ["string", "string", "int"])


def _decode_twice(col):
    """Accept plain JSON and JSON encoded as a JSON string (Q9)."""
    inner = F.get_json_object(F.concat(F.lit('{"v":'), col, F.lit("}")), "$.v")
    looks_quoted = F.regexp_like(F.trim(col), F.lit('^".*"$'))
    return F.when(looks_quoted, inner).otherwise(col)


def read_seed_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(file, label, word, pos) for each JSON file under ``path``."""
    raw = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.col("value"))
    parsed = raw.select("file", F.from_json(_decode_twice(F.col("value")), SEED_SCHEMA).alias("m"))
    by_label = parsed.select("file", F.explode("m").alias("label", "words"))
    return by_label.select("file", "label", F.posexplode("words").alias("pos", "word"))


def read_seed_dictionaries(spark: SparkSession, path: str) -> DataFrame:
    """(iteration, file, label, word, pos) of all dictionaries under ``path``.

    ``iteration`` counts the files with words from 0 in the order of their names, as the rounds are read.
    """
    from pyspark.sql import Window
    rows = read_seed_dictionary(spark, path)
    files = rows.select("file").distinct()
    files = files.select("file", (F.row_number().over(Window.orderBy("file")) - 1).alias("iteration"))     # one row per file
    return rows.join(files, "file").select("iteration", "file", "label", "word", "pos")


def read_tag_links(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) integer edges from a {"id": [id, ...]} JSON map."""
    raw = spark.read.text(path, wholetext=True)
    m = raw.select(F.from_json("value", "map<string, array<int>>").alias("m"))
    return (m.select(F.explode("m").alias("src", "dsts"))
            .select(F.col("src").cast("int").alias("src"), F.explode("dsts").alias("dst")))


EXTERNAL_MAP_SCHEMA = "map<string, struct<vertical: array<int>, tag: array<int>>>"


def read_external_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, vertical array<int>, tag array<int>) from the nested map."""
    raw = spark.read.text(path, wholetext=True)
    m = raw.select(F.from_json("value", EXTERNAL_MAP_SCHEMA).alias("m"))
    return m.select(F.explode("m").alias("key", "v")).select("key", "v.vertical", "v.tag")


def read_mapping_sheet(spark: SparkSession, path: str, flag_col: str = "flag") -> DataFrame:
    """Mapping sheet exported as CSV with a header; rows with flag = 1."""
    df = spark.read.option("header", True).csv(path)
    return df.where(F.col(flag_col).try_cast("int") == 1)


def write_seed_dictionary(seeds: DataFrame, path: str, iteration_col: str | None = "iteration",
                          mode: str = "overwrite") -> None:
    """One plain JSON object {label: [words]} per iteration partition."""
    keys = [iteration_col] if iteration_col else []
    per_label = seeds.groupBy(*keys, "label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]).alias("words"))
    out = per_label.groupBy(*keys).agg(F.map_from_entries(
        F.array_sort(F.collect_list(F.struct("label", "words")))).alias("m"))
    writer = out.select(*keys, F.to_json("m").alias("value")).write.mode(mode)
    if iteration_col:
        writer = writer.partitionBy(iteration_col)
    writer.text(path)
