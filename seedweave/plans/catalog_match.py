"""Queries for seed matching and pseudo-label rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from seedweave.functions.text import filter_tokens
from seedweave.operators import match
from seedweave.plans.fixtures import (SEEDS, SEEDS_SMALL, seeds_values_sql, sql_filter_tokens,
                                      sql_ngrams_upto, sql_word_tokens)
from seedweave.plans.registry import query
from seedweave.session import spread_table, table
from seedweave.sources.dictionaries import seeds_from_dict

TOK_SQL = sql_filter_tokens("text")

# Shared oracle pieces: tokens of every document, hits per (doc, label).
_COUNTS_SQL = f"""
tok AS (SELECT doc_id, unnest({TOK_SQL}) AS word FROM documents),
seeds AS {seeds_values_sql(SEEDS)},
cnt AS (SELECT doc_id, label, count(*) AS n
        FROM tok JOIN (SELECT DISTINCT label, word FROM seeds) s USING (word)
        GROUP BY doc_id, label),
st AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id) AS BIGINT) AS total,
              max(n) OVER (PARTITION BY doc_id) AS max_n,
              count(*) OVER (PARTITION BY doc_id) AS labels_hit,
              row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, label) AS rk
       FROM cnt)
"""


def _docs_tokens(spark, sf):
    return spread_table(spark, sf, "documents", "doc_id", "text")


def _counts(spark, sf, seeds=SEEDS):
    docs = _docs_tokens(spark, sf)
    toks = match.explode_tokens(docs, filter_tokens("text"))
    return match.label_counts(toks, seeds_from_dict(spark, seeds))


@query("j7_seed_match", f"""
WITH tok AS (SELECT doc_id, unnest({TOK_SQL}) AS word FROM documents),
seeds AS {seeds_values_sql(SEEDS)}
SELECT doc_id, label, word, count(*) AS n
FROM tok JOIN (SELECT DISTINCT label, word FROM seeds) s USING (word)
GROUP BY doc_id, label, word
""")
def j7_seed_match(spark, sf):
    docs = _docs_tokens(spark, sf)
    toks = match.explode_tokens(docs, filter_tokens("text"))
    return match.seed_hits(toks, seeds_from_dict(spark, SEEDS)).select("doc_id", "label", "word", "n")


@query("p1_label_counts", f"""
WITH {_COUNTS_SQL}
SELECT doc_id, label, n FROM cnt
""")
def p1_label_counts(spark, sf):
    return _counts(spark, sf).select("doc_id", "label", "n")


@query("p2_share_rule", f"""
WITH {_COUNTS_SQL},
pk AS (SELECT *, n / total >= 0.2 AS picked FROM st),
fin AS (SELECT *, max(CAST(picked AS INT)) OVER (PARTITION BY doc_id) AS anyp FROM pk)
SELECT doc_id, label, n, total FROM fin WHERE picked OR (anyp = 0 AND rk = 1)
""")
def p2_share_rule(spark, sf):
    counts = _counts(spark, sf)
    return match.share_rule(counts, len(SEEDS), 0.2, fallback=True)


@query("p2_share_rule_small_dict", f"""
WITH tok AS (SELECT doc_id, unnest({TOK_SQL}) AS word FROM documents),
seeds AS {seeds_values_sql(SEEDS_SMALL)},
cnt AS (SELECT doc_id, label, count(*) AS n
        FROM tok JOIN (SELECT DISTINCT label, word FROM seeds) s USING (word)
        GROUP BY doc_id, label)
SELECT doc_id, label, n, CAST(sum(n) OVER (PARTITION BY doc_id) AS BIGINT) AS total FROM cnt
""")
def p2_share_rule_small_dict(spark, sf):
    counts = _counts(spark, sf, SEEDS_SMALL)
    return match.share_rule(counts, len(SEEDS_SMALL), 0.2, fallback=True)


@query("p3_strict_share_rule", f"""
WITH {_COUNTS_SQL}
SELECT doc_id, label, n, total FROM st WHERE n / total >= 0.4
""")
def p3_strict_share_rule(spark, sf):
    return match.share_rule(_counts(spark, sf), len(SEEDS), 0.4, fallback=False)


@query("p4_relative_to_max_rule", f"""
WITH {_COUNTS_SQL}
SELECT doc_id, label, n, total FROM st
WHERE labels_hit < 2 OR (rk <= 3 AND n / max_n > 0.5)
""")
def p4_relative_to_max_rule(spark, sf):
    return match.relative_to_max_rule(_counts(spark, sf), 0.5, 3)


@query("p5_argmax_rule", f"""
WITH {_COUNTS_SQL}
SELECT doc_id, label, n, total FROM st WHERE rk = 1
""")
def p5_argmax_rule(spark, sf):
    return match.argmax_rule(_counts(spark, sf))


P6_SQL = f"""
WITH w AS (SELECT doc_id, {sql_word_tokens("text")} AS ws FROM docs_here),
g2 AS (SELECT doc_id, ws FROM w WHERE len(ws) > 0),
u AS (SELECT doc_id, unnest(ws) AS w1, unnest(ws[2:] || [NULL]) AS w2, unnest(ws[3:] || [NULL, NULL]) AS w3,
             unnest(ws[4:] || [NULL, NULL, NULL]) AS w4 FROM g2),
seeds AS (SELECT DISTINCT label, word, split_part(word, ' ', 1) AS w1, len(string_split(word, ' ')) AS k
          FROM {seeds_values_sql(SEEDS)}),
hit AS (SELECT DISTINCT doc_id, label, word FROM u JOIN seeds USING (w1)
        WHERE word = CASE k WHEN 1 THEN w1 WHEN 2 THEN w1 || ' ' || w2 WHEN 3 THEN w1 || ' ' || w2 || ' ' || w3
                     WHEN 4 THEN w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 END),
cnt AS (SELECT doc_id, label, count(*) AS n FROM hit GROUP BY doc_id, label),
st AS (SELECT *, n / sum(n) OVER (PARTITION BY doc_id) AS share,
              row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, label) AS rk FROM cnt),
fin AS (SELECT *, max(CAST(share >= 0.2 AS INT)) OVER (PARTITION BY doc_id) AS anyp FROM st),
pk AS (SELECT doc_id, label FROM fin WHERE share >= 0.2 OR (anyp = 0 AND rk = 1))
SELECT g2.doc_id, pk.label FROM g2 LEFT JOIN pk USING (doc_id)
"""


_TURNS = "(SELECT {'conv_id': conv_id, 'turn': turn} AS doc_id, text FROM conversations)"


@query("p6_production_rule", f"SELECT doc_id.conv_id AS conv_id, doc_id.turn AS turn, label FROM ({P6_SQL.replace('docs_here', _TURNS)})")
def p6_production_rule(spark, sf):
    conv = table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("doc_id"), "text")
    labels = match.production_labels(conv, "text", seeds_from_dict(spark, SEEDS), len(SEEDS))
    return labels.select("doc_id.conv_id", "doc_id.turn", "label")


@query("p17_rule_comparison", f"""
WITH tok AS (SELECT doc_id, unnest({TOK_SQL}) AS word FROM documents),
seeds AS (SELECT 'full' AS dict_id, * FROM {seeds_values_sql(SEEDS)}
          UNION ALL SELECT 'small' AS dict_id, * FROM {seeds_values_sql(SEEDS_SMALL)}),
cnt AS (SELECT dict_id, doc_id, label, count(*) AS n
        FROM tok JOIN (SELECT DISTINCT dict_id, label, word FROM seeds) s USING (word)
        GROUP BY dict_id, doc_id, label),
st AS (SELECT *, max(n) OVER (PARTITION BY dict_id, doc_id) AS max_n,
              count(*) OVER (PARTITION BY dict_id, doc_id) AS labels_hit,
              row_number() OVER (PARTITION BY dict_id, doc_id ORDER BY n DESC, label) AS rk FROM cnt),
pk AS (SELECT dict_id, label FROM st WHERE labels_hit < 2 OR (rk <= 3 AND n / max_n > 0.5)
       UNION ALL SELECT 'truth' AS dict_id, lang AS label FROM documents)
SELECT dict_id, label, count(*) AS n_docs FROM pk GROUP BY dict_id, label
""")
def p17_rule_comparison(spark, sf):
    """Label distribution of the relative-to-max rule for several dictionaries and of the truth."""
    docs = _docs_tokens(spark, sf)
    toks = match.explode_tokens(docs, filter_tokens("text"))
    parts = []
    for dict_id, seeds in (("full", SEEDS), ("small", SEEDS_SMALL)):
        counts = match.label_counts(toks, seeds_from_dict(spark, seeds))
        parts.append(match.relative_to_max_rule(counts).select(F.lit(dict_id).alias("dict_id"), "label"))
    truth = table(spark, sf, "documents").select(F.lit("truth").alias("dict_id"), F.col("lang").alias("label"))
    allp = parts[0].unionByName(parts[1]).unionByName(truth)
    return allp.groupBy("dict_id", "label").agg(F.count(F.lit(1)).alias("n_docs"))
