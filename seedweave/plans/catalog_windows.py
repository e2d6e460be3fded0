"""Queries for windows, ordering and indices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seedweave.functions.text import filter_tokens
from seedweave.operators import vocab as vc
from seedweave.operators import windows as wn
from seedweave.plans.fixtures import ROLE_PRIORITY, sql_filter_tokens, sql_str
from seedweave.plans.registry import query
from seedweave.session import spread_table, table

_VOCAB_SQL = f"""
t AS (SELECT doc_id, unnest({sql_filter_tokens('text')}) AS word,
             unnest(range(len({sql_filter_tokens('text')}))) AS pos FROM documents),
v AS (SELECT word, count(*) AS tf, min({{'d': doc_id, 'p': pos}}) AS first_seen FROM t GROUP BY word),
vi AS (SELECT word, tf, row_number() OVER (ORDER BY tf DESC, first_seen, word) AS idx FROM v)
"""


def _vocab(spark, sf, max_words=None):
    docs = spread_table(spark, sf, "documents", "doc_id", "text")
    return vc.vocabulary(docs, filter_tokens("text"), max_words=max_words)


@query("w1_latest_event", """
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn = 1
""")
def w1_latest_event(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return wn.latest_per_key(e, ["user_id", "event_type"], "ts", tie=["event_id"]).drop("ts")


@query("w1_latest_turn", """
SELECT conv_id, role, turn, length(text) AS n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1
""")
def w1_latest_turn(spark, sf):
    c = table(spark, sf, "conversations")
    out = wn.latest_per_key(c, ["conv_id", "role"], "turn")
    return out.select("conv_id", "role", "turn", F.length("text").cast("long").alias("n_chars"))


@query("w2_first_per_key", """
SELECT source, lang, doc_id FROM (
  SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1
""")
def w2_first_per_key(spark, sf):
    d = table(spark, sf, "documents").select("source", "lang", "doc_id")
    return wn.first_per_key(d, ["source", "lang"], ["doc_id"])


@query("w3_argmax_per_group", """
WITH s AS (SELECT user_id, event_type, round(sum(value), 6) AS total FROM events GROUP BY user_id, event_type)
SELECT user_id, event_type, total FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, event_type) AS rn FROM s) WHERE rn = 1
""")
def w3_argmax_per_group(spark, sf):
    e = table(spark, sf, "events")
    s = e.groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 6).alias("total"))
    return wn.argmax_per_group(s, ["user_id"], "total", "event_type")


@query("w8_vocabulary", f"""
WITH {_VOCAB_SQL}
SELECT word, tf, idx FROM vi
""")
def w8_vocabulary(spark, sf):
    return _vocab(spark, sf).select("word", "tf", "idx")


@query("w9_first_seen_index", f"""
WITH t AS (SELECT doc_id, unnest({sql_filter_tokens('text')}) AS word,
                  unnest(range(len({sql_filter_tokens('text')}))) AS pos FROM documents),
v AS (SELECT word, min({{'d': doc_id, 'p': pos}}) AS first_seen FROM t GROUP BY word)
SELECT word, row_number() OVER (ORDER BY first_seen, word) - 1 AS idx FROM v
""")
def w9_first_seen_index(spark, sf):
    docs = spread_table(spark, sf, "documents", "doc_id", "text")
    return vc.first_seen_index(docs, filter_tokens("text"), start=0).select("word", "idx")


_PRIO_SQL = "[" + ", ".join(sql_str(r) for r in ROLE_PRIORITY) + "]"


@query("t1_priority_order", f"""
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id
       ORDER BY coalesce(list_position({_PRIO_SQL}, role), 1000000), turn) AS rank FROM conversations
""")
def t1_priority_order(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    w = Window.partitionBy("conv_id").orderBy(wn.priority_rank("role", ROLE_PRIORITY), "turn")
    return c.withColumn("rank", F.row_number().over(w))


@query("t4_vocabulary_slice", f"""
WITH {_VOCAB_SQL}
SELECT word, idx FROM vi WHERE idx > 30 AND idx <= 80
""")
def t4_vocabulary_slice(spark, sf):
    """Frequency-rank slice [30:80] of the vocabulary (0-based slice = idx 31..80)."""
    v = _vocab(spark, sf)
    return v.where((F.col("idx") > 30) & (F.col("idx") <= 80)).select("word", "idx")


@query("t6_vocabulary_cut", f"""
WITH {_VOCAB_SQL}
SELECT count(*) AS n_words, CAST(sum(tf) AS BIGINT) AS n_tokens FROM vi WHERE idx < 2000
""")
def t6_vocabulary_cut(spark, sf):
    v = _vocab(spark, sf, max_words=2000)
    return v.agg(F.count(F.lit(1)).alias("n_words"), F.sum("tf").cast("long").alias("n_tokens"))
