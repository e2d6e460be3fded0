"""The library's functions called from SQL text."""

from __future__ import annotations

from seedweave.functions import sql as sw
from seedweave.plans import catalog_joins, catalog_match, catalog_text  # noqa: F401  (their SQL is registered first)
from seedweave.plans.fixtures import SEEDS, sql_filter_tokens, sql_word_tokens
from seedweave.plans.registry import ORACLE_SQL, query
from seedweave.session import spread_table, table
from seedweave.sources.dictionaries import seeds_from_dict


@query("y1_row_functions_sql", f"""
SELECT c.doc_id, c.clean, len({sql_word_tokens('d.text')}) AS n_words, len({sql_filter_tokens('d.text')}) AS n_tokens
FROM ({ORACLE_SQL['x1_small_clean']}) c JOIN documents d USING (doc_id)
""")
def y1_row_functions_sql(spark, sf):
    """Row functions by name."""
    sw.register(spark)
    return spark.sql("""
        SELECT doc_id, sw_small_clean(text) AS clean, size(sw_word_tokens(text)) AS n_words,
               size(sw_filter_tokens(text)) AS n_tokens
        FROM {documents}""", documents=spread_table(spark, sf, "documents", "doc_id", "text"))


@query("y2_group_function_sql", ORACLE_SQL["a18_concat_distinct_lists"])
def y2_group_function_sql(spark, sf):
    """Y2: a group function over the lists of a client's rows."""
    sw.register(spark)
    return spark.sql(r"""
        SELECT conv_id, array_join(words, ',') AS words FROM (
            SELECT conv_id, sw_sorted_union(collect_list(long_words)) AS words FROM (
                SELECT conv_id, regexp_extract_all(lower(text), r'[\p{{L}}]{{9,}}', 0) AS long_words FROM {conversations})
            GROUP BY conv_id)
        WHERE size(words) > 0""", conversations=table(spark, sf, "conversations"))


@query("y3_share_rule_sql", ORACLE_SQL["p2_share_rule"])
def y3_share_rule_sql(spark, sf):
    """Matching and the label rule (P2) by name."""
    sw.register(spark)
    return spark.sql(f"""
        WITH a AS (SELECT doc_id, sw_filter_tokens(text) AS words FROM {{documents}}),
        t AS (SELECT doc_id, explode_outer(words) AS word FROM a),
        n AS (SELECT doc_id, label, count(*) AS n FROM t JOIN {{seeds}} USING (word) GROUP BY doc_id, label),
        c AS (SELECT doc_id, collect_list(named_struct('label', label, 'n', n)) AS counts FROM n GROUP BY doc_id),
        d AS (SELECT doc_id, sw_share_labels(counts, {len(SEEDS)}, 0.2D) AS kept FROM c)
        SELECT doc_id, inline(kept) FROM d""",
        documents=spread_table(spark, sf, "documents", "doc_id", "text"),
        seeds=seeds_from_dict(spark, SEEDS).select("label", "word").distinct())


@query("y6_row_to_many_sql", ORACLE_SQL["x8_word_tokens"])
def y6_row_to_many_sql(spark, sf):
    """One row becomes many."""
    sw.register(spark)
    return spark.sql("""
        WITH a AS (SELECT doc_id, sw_token_rows(text) AS words FROM {documents}),
        t AS (SELECT doc_id, inline_outer(words) FROM a)
        SELECT word, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t WHERE word IS NOT NULL GROUP BY word""",
        documents=spread_table(spark, sf, "documents", "doc_id", "text"))
