"""Queries for data-set building (D1-D3) and the incremental stream (G1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seedweave.functions import labels as lb
from seedweave.operators import sampling as sp
from seedweave.operators.windows import first_per_key
from seedweave.plans.catalog_match import P6_SQL
from seedweave.plans.registry import query
from seedweave.session import table

LANGS = ["de", "en", "es", "fr"]
_LANGS_SQL = "['de', 'en', 'es', 'fr']"


def _one_vs_all_sql(order: str) -> str:
    return f"""
WITH d AS (SELECT doc_id, lang FROM documents),
n AS (SELECT lang AS target, CAST(ceil(count(*) / 3.0) AS BIGINT) AS quota FROM d GROUP BY lang),
t AS (SELECT d.doc_id, d.lang, x.target FROM d, (SELECT unnest({_LANGS_SQL}) AS target) x),
pos AS (SELECT target, doc_id, lang AS label FROM t WHERE lang = target),
neg AS (SELECT target, doc_id, 'Other' AS label FROM (
          SELECT t.*, n.quota, row_number() OVER (PARTITION BY t.target, t.lang ORDER BY {order}) AS rn
          FROM t JOIN n USING (target) WHERE t.lang <> t.target) WHERE rn <= quota)
SELECT * FROM pos UNION ALL SELECT * FROM neg
"""


@query("d1_one_vs_all", _one_vs_all_sql("t.doc_id"))
def d1_one_vs_all(spark, sf):
    """D1 with id order inside each class (the hash-ordered form is the default API)."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return sp.one_vs_all(d, "doc_id", "lang", LANGS, seed=None).select("target", "doc_id", "label")


@query("d1_one_vs_all_hashed", _one_vs_all_sql("md5(CAST(t.doc_id AS VARCHAR) || ':42'), t.doc_id"))
def d1_one_vs_all_hashed(spark, sf):
    """D1 with the order of the MD5 of id and seed inside each class."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return sp.one_vs_all(d, "doc_id", "lang", LANGS, seed=42).select("target", "doc_id", "label")


@query("d2_per_class_sample", """
SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents)
WHERE rn <= 20
""")
def d2_per_class_sample(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return sp.per_class_sample(d, "doc_id", "lang", 20, seed=None)


@query("d3_corpus_preparation", """
WITH w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1),
f AS (SELECT w.doc_id, w.text, w.lang, l.quality, l.toxic FROM w JOIN labels l USING (doc_id)
      WHERE w.text <> '—' AND (l.quality = 1 OR l.toxic = 1)
        AND w.lang = 'en' AND length(w.text) > 20)
SELECT doc_id, lower(text) AS sentence, CAST(quality AS VARCHAR) || ',' || CAST(toxic AS VARCHAR) AS label FROM f
WHERE NOT (toxic = 1 AND quality = 0)
""")
def d3_corpus_preparation(spark, sf):
    """D3: distinct text (first id), sentinel out, label lists, non-empty, excluded-label
    rows out (toxic-only), one language, minimum length, multi-hot, rename, lower."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    d = first_per_key(d, ["text"], ["doc_id"])                                       # W2
    d = d.where(F.col("text") != "—")                                               # F2
    l = table(spark, sf, "labels")
    lst = F.filter(F.array(F.lit("quality"), F.lit("toxic")),
                   lambda x: ((x == "quality") & (F.col("quality") == 1)) | ((x == "toxic") & (F.col("toxic") == 1)))
    j = d.join(l.select("doc_id", lst.alias("labels")), "doc_id")                   # J5 (mapping)
    j = j.where(F.size("labels") > 0)                                               # F4
    j = j.where(~((F.size("labels") == 1) & F.array_contains("labels", "toxic")))   # F5
    j = j.where(F.col("lang") == "en").where(F.length("text") > 20)                 # F6, F3
    hot = lb.multi_hot("labels", ["quality", "toxic"])                              # X19
    return j.select("doc_id", F.lower("text").alias("sentence"), F.array_join(hot, ",").alias("label"))  # F1


@query("g1_incremental_labels", P6_SQL.replace("docs_here", "(SELECT doc_id, text FROM documents)"))
def g1_incremental_labels(spark, sf):
    """G1: documents arrive as a file stream; each micro-batch is labelled (P6) and written as one
    epoch of the sink; returns the sink's rows."""
    from seedweave.operators.common import checkpoint_dir
    from seedweave.streaming.incremental import run_incremental_labels
    base = f"{checkpoint_dir(spark).rstrip('/')}/g1-{uuid.uuid4().hex}"
    return run_incremental_labels(spark, sf, f"{base}/sink", f"{base}/progress")
