"""Queries for label encodings and decoders (X17-X23) and label distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from seedweave.operators.common import local_table

from seedweave.functions import labels as lb
from seedweave.functions.text import filter_tokens
from seedweave.operators import match
from seedweave.plans.fixtures import SEEDS, seeds_values_sql, sql_filter_tokens
from seedweave.plans.registry import query
from seedweave.session import table
from seedweave.sources.dictionaries import seeds_from_dict

LABELS = sorted(SEEDS)
_LABELS_SQL = "[" + ", ".join(f"'{l}'" for l in LABELS) + "]"

_SHARES_SQL = f"""
tok AS (SELECT doc_id, unnest({sql_filter_tokens('text')}) AS word FROM documents),
seeds AS {seeds_values_sql(SEEDS)},
cnt AS (SELECT doc_id, label, count(*) AS n FROM tok JOIN (SELECT DISTINCT label, word FROM seeds) s USING (word)
        GROUP BY doc_id, label),
sh AS (SELECT doc_id, label, n / sum(n) OVER (PARTITION BY doc_id) AS share FROM cnt)
"""


def _dense(expr_for_label: str) -> str:
    """SQL list over the sorted labels, one conditional aggregate per label."""
    return "[" + ", ".join(expr_for_label.format(l=l) for l in LABELS) + "]"


def _shares(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    counts = match.label_counts(match.explode_tokens(docs, filter_tokens("text")), seeds_from_dict(spark, SEEDS))
    from pyspark.sql import Window
    w = Window.partitionBy("doc_id")
    return counts.select("doc_id", "label", (F.col("n") / F.sum("n").over(w)).alias("share"))


def _score_vectors(spark, sf):
    sh = _shares(spark, sf)
    m = sh.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "share"))).alias("m"))
    return m.select("doc_id", lb.dense_scores("m", LABELS).alias("scores"))


def _fmt(arr):
    return F.array_join(F.transform(arr, lambda x: F.format_number(x, 6)), ",")


@query("x17_label_index", """
SELECT lang AS label, CAST(row_number() OVER (ORDER BY lang) - 1 AS INT) AS idx FROM (SELECT DISTINCT lang FROM documents)
""")
def x17_label_index(spark, sf):
    return lb.label_index(table(spark, sf, "documents"), "lang")


@query("x18_one_hot", f"""
SELECT doc_id, array_to_string(list_transform({_LABELS_SQL}, lambda l: CAST(l = lang AS INT)), ',') AS onehot FROM documents
""")
def x18_one_hot(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(lb.one_hot("lang", LABELS), ",").alias("onehot"))


@query("x19_multi_hot", """
WITH l AS (SELECT doc_id, list_filter(['quality', 'toxic'], lambda x: (x = 'quality' AND quality = 1) OR (x = 'toxic' AND toxic = 1)) AS lst
           FROM labels)
SELECT doc_id, array_to_string(list_transform(['quality', 'toxic'], lambda x: CAST(list_contains(lst, x) AS INT)), ',') AS multihot FROM l
""")
def x19_multi_hot(spark, sf):
    l = table(spark, sf, "labels")
    lst = F.filter(F.array(F.lit("quality"), F.lit("toxic")),
                   lambda x: ((x == "quality") & (F.col("quality") == 1)) | ((x == "toxic") & (F.col("toxic") == 1)))
    return l.select("doc_id", F.array_join(lb.multi_hot(lst, ["quality", "toxic"]), ",").alias("multihot"))


@query("x20_decode_scores", f"""
WITH {_SHARES_SQL},
over AS (SELECT doc_id, label FROM sh WHERE share > 0.5),
best AS (SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, label) rk FROM sh) WHERE rk = 1),
pick AS (SELECT * FROM over UNION ALL SELECT * FROM best WHERE doc_id NOT IN (SELECT doc_id FROM over))
SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM pick GROUP BY doc_id
""")
def x20_decode_scores(spark, sf):
    s = _score_vectors(spark, sf)
    return s.select("doc_id", F.array_join(lb.decode_scores("scores", LABELS, 0.5), ",").alias("labels"))


@query("x21_decode_one_hot", "SELECT doc_id, lang AS decoded FROM documents")
def x21_decode_one_hot(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", lb.decode_one_hot(lb.one_hot("lang", LABELS), LABELS).alias("decoded"))


@query("x22_binarize", f"""
WITH {_SHARES_SQL}
SELECT doc_id, array_to_string({_dense("CAST(coalesce(max(CASE WHEN label = '{l}' THEN share END), 0) > 0.5 AS INT)")}, ',') AS binary,
       array_to_string({_dense("CAST(coalesce(max(CASE WHEN label = '{l}' THEN share END), 0) >= 0.5 AS INT)")}, ',') AS binary_ge
FROM sh GROUP BY doc_id
""")
def x22_binarize(spark, sf):
    s = _score_vectors(spark, sf)
    return s.select("doc_id", F.array_join(lb.binarize("scores", 0.5), ",").alias("binary"),
                    F.array_join(lb.binarize("scores", 0.5, inclusive=True), ",").alias("binary_ge"))


@query("x23_decode_prefixed", f"""
WITH {_SHARES_SQL}
SELECT doc_id, array_to_string({_dense("CAST(coalesce(max(CASE WHEN label = '{l}' THEN share END), 0) > 0.5 AS INT)")}, ',') AS multihot
FROM sh GROUP BY doc_id
""")
def x23_decode_prefixed(spark, sf):
    """Predictions as ``__label__X`` names sorted by confidence, decoded to multi-hot."""
    sh = _shares(spark, sf)
    preds = sh.groupBy("doc_id").agg(F.array_sort(F.collect_list(
        F.struct((-F.col("share")).alias("neg"), F.concat(F.lit(lb.LABEL_PREFIX), "label").alias("name"),
                 F.col("share").alias("conf")))).alias("p"))
    preds = preds.select("doc_id", F.transform("p", lambda x: x["name"]).alias("names"),
                         F.transform("p", lambda x: x["conf"]).alias("confs"))
    return preds.select("doc_id", F.array_join(lb.decode_prefixed("names", "confs", LABELS), ",").alias("multihot"))


_P2_SQL = f"""
{_SHARES_SQL},
st AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, label) AS rk FROM sh),
fin AS (SELECT *, max(CAST(share >= 0.2 AS INT)) OVER (PARTITION BY doc_id) AS anyp FROM st),
p2 AS (SELECT doc_id, label FROM fin WHERE share >= 0.2 OR (anyp = 0 AND rk = 1))
"""


def _p2(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return match.pseudo_labels(docs, filter_tokens("text"), seeds_from_dict(spark, SEEDS), len(SEEDS))


@query("a9_label_distribution", f"""
WITH {_P2_SQL},
lbl AS (SELECT unnest({_LABELS_SQL}) AS label)
SELECT lbl.label, count(p2.doc_id) AS n FROM lbl LEFT JOIN p2 USING (label) GROUP BY lbl.label
""")
def a9_label_distribution(spark, sf):
    from seedweave.operators.metrics import label_distribution
    return label_distribution(_p2(spark, sf), local_table(spark, [(l,) for l in LABELS], ["label"]))


@query("a10_labels_per_doc", f"""
WITH {_P2_SQL},
per AS (SELECT d.doc_id, count(p2.label) AS k FROM documents d LEFT JOIN p2 USING (doc_id) GROUP BY d.doc_id),
b AS (SELECT unnest(range(0, 5)) AS k)
SELECT CAST(b.k AS INT) AS n_labels, count(per.doc_id) AS n_docs FROM b LEFT JOIN per USING (k) GROUP BY b.k
""")
def a10_labels_per_doc(spark, sf):
    from seedweave.operators.metrics import labels_per_doc_histogram
    docs = table(spark, sf, "documents").select("doc_id")
    return labels_per_doc_histogram(docs, _p2(spark, sf), max_k=4)
