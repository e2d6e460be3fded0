"""Tables that jobs leave for each other (S7, S11-S15, S17): vectors, senses, vocabulary, corpus, bigram map.

All are Parquet folders on shared storage; writing again replaces a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VECTOR_BUCKETS = 256


def write_vectors(vectors: DataFrame, path: str, word: str = "word", buckets: int = VECTOR_BUCKETS) -> None:
    """Occurrence vectors in ``buckets`` folders by a hash of the word (never a file per word)."""
    b = F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")
    vectors.withColumn("bucket", b).write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_vectors(spark: SparkSession, path: str, words: DataFrame, clean_fn, word: str = "word") -> DataFrame:
    """(asked, all columns of the vectors): those of the word's clean form, of the raw word where there are none."""
    v = spark.read.parquet(path).drop("bucket")
    w = words.select(F.col(word).alias("asked")).distinct().withColumn("_clean", clean_fn("asked"))
    known = v.select(F.col(word).alias("_w")).distinct()
    key = w.join(known, F.col("_clean") == F.col("_w"), "left") \
        .select("asked", F.coalesce("_w", "asked").alias("_key"))
    return key.join(v, F.col("_key") == F.col(word)).drop("_key")


def write_senses(centers: DataFrame, path: str) -> None:
    """(word, sense, center)."""
    centers.select("word", "sense", "center").write.mode("overwrite").parquet(path)


def read_senses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("word string, sense int, center array<double>").parquet(path)


def write_vocabulary(vocabulary: DataFrame, vectors: DataFrame | None, path: str) -> None:
    """The vocabulary index, with the words' vectors (null: none)."""
    v = vocabulary.select("word", F.col("idx").cast("long").alias("idx"))
    none = F.lit(None).cast("array<double>").alias("vec")
    out = v.select("*", none) if vectors is None else v.join(vectors.select("word", "vec"), "word", "left")
    out.write.mode("overwrite").parquet(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("word string, idx long, vec array<double>").parquet(path)


def write_corpus(corpus: DataFrame, path: str) -> None:
    """A prepared corpus with all its columns."""
    corpus.write.mode("overwrite").parquet(path)


def write_bigrams(pairs: DataFrame, path: str) -> None:
    """The map bigram -> word (``functions.text.merge_seed_bigrams``)."""
    pairs.select("bigram", "word").write.mode("overwrite").json(path)


def read_bigrams(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("bigram string, word string").json(path)


def read_database_table(spark: SparkSession, table: str, options: dict[str, str], partition_column: str | None = None,
                        bounds: tuple[int, int] | None = None, partitions: int = 16) -> DataFrame:
    """A table over JDBC with the caller's connection options, read in ranges of a column if one is named."""
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if partition_column:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1],
                                numPartitions=partitions)
    return reader.load()
