"""Queries for projections and filters (F1-F14). Filters reach the parquet scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from seedweave.functions import labels as lb
from seedweave.functions.text import is_boilerplate
from seedweave.plans.registry import query
from seedweave.session import table


def _label_lists(spark, sf):
    """labels(doc_id, quality, toxic) as (doc_id, label list)."""
    l = table(spark, sf, "labels")
    lst = F.filter(F.array(F.lit("quality"), F.lit("toxic")),
                   lambda x: ((x == "quality") & (F.col("quality") == 1)) | ((x == "toxic") & (F.col("toxic") == 1)))
    return l.select("doc_id", lst.alias("labels"), F.array(F.col("quality"), F.col("toxic")).alias("hot"))


@query("f1_select_rename", "SELECT doc_id, text AS sentence, lang AS label FROM documents")
def f1_select_rename(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.col("text").alias("sentence"), F.col("lang").alias("label"))


@query("f2_drop_sentinel", "SELECT doc_id FROM documents WHERE text <> '—'")
def f2_drop_sentinel(spark, sf):
    return table(spark, sf, "documents").where(F.col("text") != "—").select("doc_id")


@query("f3_min_length", "SELECT doc_id, CAST(length(text) AS INT) AS n FROM documents WHERE length(text) > 20")
def f3_min_length(spark, sf):
    d = table(spark, sf, "documents")
    return d.where(F.length("text") > 20).select("doc_id", F.length("text").alias("n"))


@query("f4_non_empty_labels", "SELECT doc_id FROM labels WHERE quality = 1 OR toxic = 1")
def f4_non_empty_labels(spark, sf):
    return _label_lists(spark, sf).where(F.size("labels") > 0).select("doc_id")


@query("f5_exclude_label", "SELECT doc_id FROM labels WHERE NOT (toxic = 1)")
def f5_exclude_label(spark, sf):
    return _label_lists(spark, sf).where(~F.array_contains("labels", "toxic")).select("doc_id")


@query("f6_one_language", "SELECT doc_id FROM documents WHERE lang = 'en'")
def f6_one_language(spark, sf):
    return table(spark, sf, "documents").where(F.col("lang") == "en").select("doc_id")


@query("f7_drop_boilerplate", """
SELECT conv_id, turn FROM conversations
WHERE NOT ((contains(lower(text), 'home') AND length(text) < 50) OR length(text) = 0)
""")
def f7_drop_boilerplate(spark, sf):
    c = table(spark, sf, "conversations")
    return c.where(~is_boilerplate("text")).select("conv_id", "turn")


@query("f8_single_label", "SELECT doc_id FROM labels WHERE quality + toxic = 1")
def f8_single_label(spark, sf):
    return _label_lists(spark, sf).where(lb.hot_count("hot") == 1).select("doc_id")


@query("f9_one_class", "SELECT doc_id FROM labels WHERE quality = 1")
def f9_one_class(spark, sf):
    return table(spark, sf, "labels").where(F.col("quality") == 1).select("doc_id")


@query("f10_word_presence", """
WITH t AS (SELECT doc_id, lang, list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'), 'the') AS has FROM documents)
SELECT lang, CAST(sum(CAST(has AS INT)) AS BIGINT) AS n_with, CAST(sum(CAST(has AND lang <> 'en' AS INT)) AS BIGINT) AS n_outside,
       count(*) AS n_docs
FROM t GROUP BY lang
""")
def f10_word_presence(spark, sf):
    """Documents holding a word, per class, and those outside the word's own class."""
    from seedweave.functions.text import word_tokens
    d = table(spark, sf, "documents").select("lang", F.array_contains(word_tokens("text"), "the").alias("has"))
    return d.groupBy("lang").agg(
        F.sum(F.col("has").cast("int")).cast("long").alias("n_with"),
        F.sum((F.col("has") & (F.col("lang") != "en")).cast("int")).cast("long").alias("n_outside"),
        F.count(F.lit(1)).alias("n_docs"))


@query("f12_select_except", "SELECT doc_id, lang, source, n_chars FROM documents")
def f12_select_except(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(*[c for c in d.columns if c not in ("text",)])


@query("f13_positional_slice", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 20 OFFSET 20")
def f13_positional_slice(spark, sf):
    """Rows 20..39 in id order: the slice is the feature (TakeOrdered with offset)."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return d.orderBy("doc_id").offset(20).limit(20)
