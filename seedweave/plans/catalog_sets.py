"""Queries for set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from seedweave.operators.common import local_table

from seedweave.functions.text import ENGLISH_STOP_WORDS, EXTRA_STOP_WORDS, filter_tokens
from seedweave.operators import match
from seedweave.plans.fixtures import SEEDS, seeds_values_sql, sql_filter_tokens, sql_str
from seedweave.plans.registry import query
from seedweave.session import table
from seedweave.sources.dictionaries import seeds_from_dict

_ALL_SEEDS = sorted({w for ws in SEEDS.values() for w in ws})
_ALL_SEEDS_SQL = "[" + ", ".join(sql_str(w) for w in _ALL_SEEDS) + "]"


@query("u1_union_sources", f"""
WITH tok AS (SELECT doc_id, unnest({sql_filter_tokens('text')}) AS word FROM documents),
seeds AS {seeds_values_sql(SEEDS)},
cnt AS (SELECT doc_id, label, count(*) AS n FROM tok JOIN (SELECT DISTINCT label, word FROM seeds) s USING (word)
        GROUP BY doc_id, label),
st AS (SELECT *, n / sum(n) OVER (PARTITION BY doc_id) AS share,
              row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, label) AS rk FROM cnt)
SELECT doc_id, label, 'share' AS predtype FROM st WHERE share >= 0.2
UNION ALL SELECT doc_id, label, 'argmax' AS predtype FROM st WHERE rk = 1
UNION ALL SELECT doc_id, lang AS label, 'truth' AS predtype FROM documents
""")
def u1_union_sources(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    counts = match.label_counts(match.explode_tokens(docs, filter_tokens("text")), seeds_from_dict(spark, SEEDS))
    a = match.share_rule(counts, len(SEEDS), 0.2).select("doc_id", "label", F.lit("share").alias("predtype"))
    b = match.argmax_rule(counts).select("doc_id", "label", F.lit("argmax").alias("predtype"))
    c = docs.select("doc_id", F.col("lang").alias("label"), F.lit("truth").alias("predtype"))
    return a.unionByName(b).unionByName(c)


@query("u2_seed_intersection", f"""
SELECT doc_id, array_to_string(list_sort(list_intersect(list_distinct({sql_filter_tokens('text')}), {_ALL_SEEDS_SQL})), ',') AS hits
FROM documents
""")
def u2_seed_intersection(spark, sf):
    d = table(spark, sf, "documents")
    seeds = F.array(*[F.lit(w) for w in _ALL_SEEDS])
    return d.select("doc_id", F.array_join(F.array_sort(F.array_intersect(filter_tokens("text"), seeds)), ",").alias("hits"))


@query("u3_words_removed", f"""
SELECT DISTINCT unnest({sql_filter_tokens('text')}) AS word FROM documents WHERE lang = 'en'
EXCEPT
SELECT DISTINCT unnest({sql_filter_tokens('text')}) AS word FROM documents WHERE lang = 'fr'
""")
def u3_words_removed(spark, sf):
    """Words of one vocabulary missing from another (distinct set difference)."""
    d = table(spark, sf, "documents")
    en = d.where(F.col("lang") == "en").select(F.explode(filter_tokens("text")).alias("word"))
    fr = d.where(F.col("lang") == "fr").select(F.explode(filter_tokens("text")).alias("word"))
    return en.subtract(fr)


@query("u4_distinct_tag_union", """
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '),
       [lower(p_type), split_part(p_name, ' ', 2)]))), ',') AS tags FROM part
""")
def u4_distinct_tag_union(spark, sf):
    p = table(spark, sf, "part")
    a = F.split("p_name", " ")
    b = F.array(F.lower("p_type"), F.element_at(F.split("p_name", " "), 2))
    return p.select("p_partkey", F.array_join(F.array_sort(F.array_union(a, b)), ",").alias("tags"))


_STOP = ENGLISH_STOP_WORDS + EXTRA_STOP_WORDS
_STOP_SQL = ", ".join(f"({sql_str(w)})" for w in _STOP)


@query("u7_stop_words_plus_frequent", f"""
WITH t AS (SELECT doc_id, unnest(list_distinct({sql_filter_tokens('text')})) AS word FROM documents),
n AS (SELECT count(*) AS n FROM documents),
frequent AS (SELECT word FROM t GROUP BY word HAVING count(*) > 0.5 * (SELECT n FROM n))
SELECT word FROM (VALUES {_STOP_SQL}) s(word) UNION SELECT word FROM frequent
""")
def u7_stop_words_plus_frequent(spark, sf):
    """Stop-word list plus the words found in more than half of all documents."""
    d = table(spark, sf, "documents")
    df = d.select("doc_id", F.explode(F.array_distinct(filter_tokens("text"))).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("df"))
    n = d.agg(F.count(F.lit(1))).scalar()  # scalar subquery: no driver round trip
    frequent = df.where(F.col("df") > 0.5 * n).select("word")
    stop = local_table(spark, [(w,) for w in _STOP], ["word"])
    return stop.union(frequent).distinct()
