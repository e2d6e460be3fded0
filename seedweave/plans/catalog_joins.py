"""Queries for joins and mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from seedweave.operators.common import local_table

from seedweave.functions.text import PUNCTUATION, char_class, strip_punctuation
from seedweave.operators import mapping as mp
from seedweave.plans.fixtures import (TAG_IDS, TAG_LINKS, WORD_CATEGORY, pairs_values_sql)
from seedweave.plans.registry import query
from seedweave.session import table

_WC_SQL = pairs_values_sql(WORD_CATEGORY, "key", "value")
_PUNCT_SQL = char_class(PUNCTUATION).replace("'", "''")


def _word_category(spark):
    return local_table(spark, WORD_CATEGORY, ["key", "value"])


def _part_lists(spark, sf):
    """Part rows as 'companies': a comma list of tags and a 'source' pair."""
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.concat_ws(", ", F.replace("p_name", F.lit(" "), F.lit(", ")), F.lower("p_type")).alias("industry"),
        F.concat_ws(", ", "p_brand", F.lower("p_type")).alias("source"))


_PART_LISTS_SQL = """(SELECT p_partkey AS id, replace(p_name, ' ', ', ') || ', ' || lower(p_type) AS industry,
                      p_brand || ', ' || lower(p_type) AS source FROM part)"""


@query("j1_not_yet_classified", """
SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""")
def j1_not_yet_classified(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return mp.not_yet_done(docs, table(spark, sf, "labels"), "doc_id")


@query("j1_not_in_null_aware", """
SELECT d.doc_id FROM documents d
WHERE d.doc_id NOT IN (SELECT CASE WHEN quality = 1 THEN doc_id END FROM labels)
""")
def j1_not_in_null_aware(spark, sf):
    """SQL ``NOT IN`` over a subquery holding NULLs returns nothing (Q20)."""
    docs = table(spark, sf, "documents").select("doc_id")
    done = table(spark, sf, "labels").select(F.when(F.col("quality") == 1, F.col("doc_id")).alias("doc_id"))
    return mp.not_yet_done(docs, done, "doc_id", null_aware=True)


@query("j2_min_id_per_text", """
SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)
""")
def j2_min_id_per_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "source")
    return mp.min_id_per_key(d, "text", "doc_id").select("doc_id", "source")


@query("j3_explode_map", f"""
WITH t AS (SELECT id, trim(unnest(string_split(industry, ','))) AS key FROM {_PART_LISTS_SQL})
SELECT id, value FROM t JOIN {_WC_SQL} m USING (key)
""")
def j3_explode_map(spark, sf):
    return mp.explode_list_map(_part_lists(spark, sf), "id", "industry", _word_category(spark))


@query("j4_left_join_checked", f"""
WITH t AS (SELECT id, trim(unnest(string_split(industry, ','))) AS key FROM {_PART_LISTS_SQL}),
m AS (SELECT id, value FROM t JOIN {_WC_SQL} m USING (key))
SELECT m.id, m.value, p.p_type, p.p_size FROM m LEFT JOIN part p ON p.p_partkey = m.id
""")
def j4_left_join_checked(spark, sf):
    m = mp.explode_list_map(_part_lists(spark, sf), "id", "industry", _word_category(spark))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_type", "p_size")
    return mp.left_join_checked(m, p, "id").select("id", "value", "p_type", "p_size")


@query("j5_distinct_mapped_list", f"""
WITH t AS (SELECT id, trim(unnest(string_split(industry, ','))) AS key FROM {_PART_LISTS_SQL}),
m AS (SELECT id, string_agg(DISTINCT value, ',' ORDER BY value) AS labels FROM t JOIN {_WC_SQL} m USING (key) GROUP BY id)
SELECT p.id, coalesce(m.labels, '') AS labels FROM {_PART_LISTS_SQL} p LEFT JOIN m USING (id)
""")
def j5_distinct_mapped_list(spark, sf):
    out = mp.distinct_mapped_list(_part_lists(spark, sf), "id", "industry", _word_category(spark))
    return out.select("id", F.array_join("labels", ",").alias("labels"))


@query("j6_join_aggregates", """
WITH a AS (SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id),
b AS (SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT conv_id, n_turns, n_chars FROM a JOIN b USING (conv_id)
""")
def j6_join_aggregates(spark, sf):
    c = table(spark, sf, "conversations")
    a = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    b = c.where(F.col("role") == "user").groupBy("conv_id").agg(F.sum(F.length("text")).cast("long").alias("n_chars"))
    # Both sides are hash-partitioned on conv_id by their aggregates: the join adds no shuffle.
    return a.join(b, "conv_id")


_LINKS_SQL = pairs_values_sql(TAG_LINKS, "src", "dst", types=("int", "int"))


@query("j8_linked_tags", f"""
WITH base AS (SELECT p_partkey, CAST(p_size % 7 AS INT) AS tag_id FROM part),
one AS (SELECT b.p_partkey, l.dst AS tag_id FROM base b JOIN {_LINKS_SQL} l ON l.src = b.tag_id)
SELECT DISTINCT p_partkey, tag_id FROM (SELECT * FROM base UNION ALL SELECT * FROM one)
""")
def j8_linked_tags(spark, sf):
    """One-hop expansion over the tag-link graph (tag of a part := p_size mod 7)."""
    base = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 7).cast("int").alias("tag_id"))
    links = local_table(spark, TAG_LINKS, ["src", "dst"], ["int", "int"])
    return mp.expand_links(base, links, "p_partkey", "tag_id", hops=1)


@query("j9_external_votes", """
WITH c AS (SELECT DISTINCT conv_id FROM conversations),
g AS (SELECT c.conv_id, r.role FROM c CROSS JOIN (SELECT DISTINCT role FROM conversations) r),
e AS (SELECT DISTINCT conv_id, role FROM conversations WHERE turn = 0)
SELECT g.conv_id, g.role, CASE WHEN e.conv_id IS NULL THEN 0 ELSE 5 END AS weight
FROM g LEFT JOIN e USING (conv_id, role)
""")
def j9_external_votes(spark, sf):
    """Dense (client, label) grid with the external weight 5, else 0."""
    c = table(spark, sf, "conversations")
    roles = c.agg(F.array_sort(F.collect_set("role"))).scalar()      # as many as the grid has per client
    grid = c.select("conv_id").distinct().select("conv_id", F.explode(roles).alias("role"))
    ext = c.where(F.col("turn") == 0).select("conv_id", "role")
    return mp.external_votes(grid, ext, "conv_id", "role", 5).withColumn("weight", F.col("weight").cast("int"))


@query("j10_code_lookup", """
SELECT n.n_nationkey, n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
""")
def j10_code_lookup(spark, sf):
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")


@query("j11_keyword_containment", """
WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}]{10,}')) AS kw FROM benchmark)
SELECT d.doc_id, k.kw FROM documents d JOIN k ON contains(lower(d.text), k.kw)
""")
def j11_keyword_containment(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("lt"))
    k = table(spark, sf, "benchmark").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{10,}"), 0)).alias("kw")).distinct()
    return mp.keyword_containment(d, "lt", k, "kw").select("doc_id", "kw")


@query("j15_canonical_word", f"""
WITH w AS (SELECT DISTINCT unnest(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) AS word FROM benchmark),
c AS (SELECT word, regexp_replace(word, '{_PUNCT_SQL}', '', 'g') AS clean FROM w)
SELECT DISTINCT CASE WHEN c.clean <> '' AND c.clean IN (SELECT word FROM w) THEN c.clean ELSE c.word END AS canonical
FROM c WHERE c.clean <> ''
""")
def j15_canonical_word(spark, sf):
    """Use the punctuation-free form of a word when that form also occurs."""
    from seedweave.operators.senses import canonical_words
    w = table(spark, sf, "benchmark").select(F.explode(F.split(F.regexp_replace("text", r"\s+", " "), " ")).alias("word"))
    return canonical_words(w.distinct(), "word", strip_punctuation)


@query("a12_tag_frequency", f"""
SELECT trim(unnest(string_split(industry, ','))) AS tag, count(*) AS n FROM {_PART_LISTS_SQL} GROUP BY 1
""")
def a12_tag_frequency(spark, sf):
    return mp.tag_frequency(_part_lists(spark, sf), "industry")


_CATS_SQL = f"""(SELECT DISTINCT trim(string_split(source, ',')[2]) AS category FROM {_PART_LISTS_SQL}
               WHERE trim(string_split(source, ',')[2]) <> 'All')"""


def _categories(spark, sf):
    p = _part_lists(spark, sf)
    return (p.select(F.trim(F.element_at(F.split("source", ","), 2)).alias("category"))
            .where(F.col("category") != "All").distinct())


@query("a15_source_categories", f"SELECT category FROM {_CATS_SQL}")
def a15_source_categories(spark, sf):
    return _categories(spark, sf)


@query("a13_tag_category_pairs", f"""
WITH r AS (SELECT id, list_transform(string_split(industry, ','), lambda x: trim(x)) AS tags FROM {_PART_LISTS_SQL}),
t AS (SELECT id, unnest(tags) AS tag, tags FROM r),
c AS (SELECT t.id, t.tag, cat.category FROM t JOIN {_CATS_SQL} cat ON list_contains(t.tags, cat.category))
SELECT tag, category, count(*) AS n FROM c GROUP BY tag, category
""")
def a13_tag_category_pairs(spark, sf):
    return mp.tag_category_pairs(_part_lists(spark, sf), "id", "industry", _categories(spark, sf))


@query("a14_unpaired_rest", f"""
WITH f AS (SELECT trim(unnest(string_split(industry, ','))) AS tag, count(*) AS n FROM {_PART_LISTS_SQL} GROUP BY 1),
r AS (SELECT id, list_transform(string_split(industry, ','), lambda x: trim(x)) AS tags FROM {_PART_LISTS_SQL}),
t AS (SELECT id, unnest(tags) AS tag, tags FROM r),
c AS (SELECT t.tag, count(*) AS n FROM t JOIN {_CATS_SQL} cat ON list_contains(t.tags, cat.category) GROUP BY t.tag)
SELECT f.tag, f.n - coalesce(c.n, 0) AS unpaired FROM f LEFT JOIN c USING (tag)
""")
def a14_unpaired_rest(spark, sf):
    p = _part_lists(spark, sf)
    freq = mp.tag_frequency(p, "industry")
    pairs = mp.tag_category_pairs(p, "id", "industry", _categories(spark, sf))
    paired = pairs.groupBy("tag").agg(F.sum("n").alias("paired"))
    return (freq.join(paired, "tag", "left")
            .select("tag", (F.col("n") - F.coalesce("paired", F.lit(0))).cast("long").alias("unpaired")))


@query("a18_concat_distinct_lists", """
WITH t AS (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[\\p{L}]{9,}')) AS w FROM conversations)
SELECT conv_id, string_agg(DISTINCT w, ',' ORDER BY w) AS words FROM t GROUP BY conv_id
""")
def a18_concat_distinct_lists(spark, sf):
    """Per client, the distinct union of per-row lists (long words of each turn)."""
    c = table(spark, sf, "conversations").select(
        "conv_id", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{9,}"), 0).alias("words"))
    out = mp.concat_distinct_lists(c, "conv_id", "words")
    return out.where(F.size("words") > 0).select("conv_id", F.array_join("words", ",").alias("words"))


_ = TAG_IDS
