"""Corpus pipeline: quality rules, SimHash near-dedup, suffix-array dedup, best-fit packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all documents its
predecessor kept; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seedweave.llm.catalog import tokenizer_file
from seedweave.llm.packing import pack_documents
from seedweave.llm.quality import keep_good
from seedweave.llm.shared import written
from seedweave.llm.simhash import one_per_group
from seedweave.llm.suffix import without_repeated_strings
from seedweave.session import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled rules keep; cutoffs come from the labelled ones among ``docs``.

    Null and empty texts have no words and go by the base rules. Repeated rows are judged
    one by one and alike; a share equal to a cutoff passes. Null languages are a stratum of
    their own. An empty table stays empty, and columns named like a measure are kept as they are.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group linked at two or fewer bits, on three-word shingles.

    Texts without words (null, empty) have fingerprint zero and are a group like any other.
    Null ids stay only where a group has no other; of repeated rows one stays. An empty
    table stays empty; all columns are returned as they are, names starting with ``_simhash_`` apart.
    """
    return one_per_group(docs, shingle=3, bits=2)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 200-byte strings that also start elsewhere; every document stays, if only as an empty text."""
    return without_repeated_strings(docs, length=200)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, placed in sequences of at most 2048 tokens.

    Null and empty texts are the end id alone; null ids and repeated rows are documents of
    their own, ties in length go by row. An empty table gives no pieces. Of ``docs`` only
    doc_id and text are used, whatever the other columns are called.
    """
    return pack_documents(docs, tokenizer_file())


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

# SQL can't express the packing; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
