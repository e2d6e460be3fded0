"""Queries for keyword graphs and TextRank (W7, K13, K14, T3) on ``benchmark``."""

from __future__ import annotations

from pyspark.sql import functions as F

from seedweave.functions.text import ENGLISH_STOP_WORDS, EXTRA_STOP_WORDS
from seedweave.operators import graph as gr
from seedweave.plans.fixtures import sql_str
from seedweave.plans.registry import query
from seedweave.session import table

_STOP_SQL = "[" + ", ".join(sql_str(w) for w in sorted(set(ENGLISH_STOP_WORDS + EXTRA_STOP_WORDS))) + "]"
_SENT_SQL = (r"list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), "
             r"'([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')")

_WORDS_SQL = f"""
s AS (SELECT item_id AS doc, unnest({_SENT_SQL}) AS sentence, unnest(range(len({_SENT_SQL}))) AS sent FROM benchmark),
c AS (SELECT doc, sent, list_filter(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
             lambda w: NOT list_contains({_STOP_SQL}, w) AND length(w) >= 3) AS w FROM s),
words AS (SELECT doc, sent, unnest(w) AS word, unnest(range(len(w))) AS pos FROM c),
pairs AS (SELECT DISTINCT a.doc, a.word AS src, b.word AS dst FROM words a JOIN words b
          ON a.doc = b.doc AND a.sent = b.sent AND b.pos - a.pos BETWEEN 1 AND 3),
both_ AS (SELECT doc, src, dst FROM pairs UNION ALL SELECT doc, dst, src FROM pairs WHERE src <> dst),
g AS (SELECT doc, src, dst, CAST(count(*) AS DOUBLE) AS g FROM both_ GROUP BY doc, src, dst),
edges AS (SELECT doc, src, dst, g / sum(g) OVER (PARTITION BY doc, dst) AS w FROM g),
nodes AS (SELECT DISTINCT doc, word FROM words),
pr1 AS (SELECT n.doc, n.word, 0.15 + 0.85 * coalesce(sum(e.w), 0) AS pr FROM nodes n
        LEFT JOIN edges e ON e.doc = n.doc AND e.src = n.word GROUP BY n.doc, n.word),
pr2 AS (SELECT n.doc, n.word, 0.15 + 0.85 * coalesce(sum(e.w * p.pr), 0) AS pr FROM nodes n
        LEFT JOIN edges e ON e.doc = n.doc AND e.src = n.word
        LEFT JOIN pr1 p ON p.doc = e.doc AND p.word = e.dst GROUP BY n.doc, n.word)
"""


def _words(spark, sf):
    b = table(spark, sf, "benchmark")
    return gr.candidate_words(b, "item_id", "text")


@query("k14_candidate_words", f"""
WITH {_WORDS_SQL}
SELECT doc, CAST(sent AS INT) AS sent, CAST(pos AS INT) AS pos, word FROM words
""")
def k14_candidate_words(spark, sf):
    return _words(spark, sf).select("doc", "sent", "pos", "word")


@query("w7_window_pairs", f"""
WITH {_WORDS_SQL}
SELECT doc, src, dst FROM pairs
""")
def w7_window_pairs(spark, sf):
    return gr.window_pairs(_words(spark, sf), 4)


@query("k13_graph_edges", f"""
WITH {_WORDS_SQL}
SELECT doc, src, dst, round(w, 6) AS w FROM edges
""")
def k13_graph_edges(spark, sf):
    e = gr.graph_edges(gr.window_pairs(_words(spark, sf), 4))
    return e.select("doc", "src", "dst", F.round("w", 6).alias("w"))


@query("k13_textrank_two_steps", f"""
WITH {_WORDS_SQL}
SELECT doc, word, round(round(pr, 9), 4) AS weight FROM pr2
""")
def k13_textrank_two_steps(spark, sf):
    r = gr.textrank(_words(spark, sf), steps=2, stop="fixed")
    # Sums of doubles depend on their order: compare at 4 places (via 9, away from ties).
    return r.select("doc", "word", F.round(F.round("weight", 9), 4).alias("weight"))


@query("k13_textrank", f"""
WITH {_WORDS_SQL}
SELECT doc, word, round(round(pr, 9), 4) AS weight FROM pr2
""")
def k13_textrank(spark, sf):
    """TextRank with the reference's stop test on the weight sum (at most 10 steps).

    Columns are normalised, so from the first update on the sum of a document's
    weights stays the same (nodes without edges have 1 - damping): the test ends
    every document after its second update, which is what the SQL has.
    """
    r = gr.textrank(_words(spark, sf), steps=10, stop="sum")
    return r.select("doc", "word", F.round(F.round("weight", 9), 4).alias("weight"))


@query("t3_top_keywords", f"""
WITH {_WORDS_SQL}
SELECT doc, word, round(pr9, 4) AS weight, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pr9 DESC, word) AS rank
  FROM (SELECT *, round(pr, 9) AS pr9 FROM pr2)) WHERE rank <= 10
""")
def t3_top_keywords(spark, sf):
    """Top 10 keywords per text (two-step weights)."""
    r = gr.textrank(_words(spark, sf), steps=2, stop="fixed")
    top = gr.top_keywords(r.withColumn("weight", F.round("weight", 9)), 10)
    return top.select("doc", "word", F.round("weight", 4).alias("weight"), "rank")
