"""Queries for the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from seedweave.functions import text as tx
from seedweave.operators import vocab as vc
from seedweave.plans.fixtures import (BIGRAMS, ROLE_PRIORITY, SEEDS, WORD_CATEGORY, pairs_values_sql,
                                      seeds_values_sql, sql_filter_tokens, sql_ngrams, sql_str,
                                      sql_word_tokens)
from seedweave.plans.registry import query
from seedweave.session import spread_table, table
from seedweave.sources.dictionaries import seeds_from_dict

PUNCT_CLASS = tx.char_class(tx.PUNCTUATION)
DESC_CLASS = tx.char_class(tx.DESCRIPTION_CHARS)


def _docs(spark, sf):
    return spread_table(spark, sf, "documents", "doc_id", "text")


@query("x1_small_clean", r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'),
         '\S*\p{Nd}\S*', '', 'g'), '^\s+|\s+$', '', 'g'), ' +', ' ', 'g') AS clean
FROM documents
""")
def x1_small_clean(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.small_clean("text").alias("clean"))


@query("x2_description_clean", f"""
SELECT conv_id, turn, replace(regexp_replace(lower(text), '{DESC_CLASS}', ' ', 'g'), chr(10), ' ') AS clean
FROM conversations
""")
def x2_description_clean(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.description_clean("text").alias("clean"))


@query("x2_description_clean_strict", f"""
SELECT conv_id, turn, replace(regexp_replace(lower(text), '{DESC_CLASS}', ' ', 'g'), chr(10), '') AS clean
FROM conversations
""")
def x2_description_clean_strict(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.description_clean("text", strict=True).alias("clean"))


_URL_SQL = tx.URL_PATTERN.replace("'", "''")


@query("x3_web_clean", f"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '{_URL_SQL}', '', 'g'),
         '[?!]', '', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS clean
FROM pages
""")
def x3_web_clean(spark, sf):
    """Urls, ``?!`` and spaces; the oracle has no back-references (see x3_web_clean_runs)."""
    return table(spark, sf, "pages").select("page_id", tx.web_clean("html", remove_runs=False).alias("clean"))


@query("x3_web_clean_runs")
def x3_web_clean_runs(spark, sf):
    """Full web clean including the removal of runs of >= 3 equal characters (P)."""
    return table(spark, sf, "pages").select("page_id", tx.web_clean("html").alias("clean"))


@query("x4_strip_punctuation", f"""
SELECT doc_id, regexp_replace(text, '{PUNCT_CLASS.replace("'", "''")}', '', 'g') AS clean FROM documents
""")
def x4_strip_punctuation(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.strip_punctuation("text").alias("clean"))


@query("x5_punctuation_to_space", f"""
SELECT doc_id, regexp_replace(lower(text), '{PUNCT_CLASS.replace("'", "''")}', ' ', 'g') AS clean FROM documents
""")
def x5_punctuation_to_space(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.punctuation_to_space("text").alias("clean"))


@query("x6_whitespace_tokens", r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS tok FROM documents)
SELECT doc_id, CAST(len(tok) AS INT) AS n_tokens, array_to_string(tok, '|') AS tokens FROM t
""")
def x6_whitespace_tokens(spark, sf):
    t = _docs(spark, sf).select("doc_id", tx.whitespace_tokens("text").alias("tok"))
    return t.select("doc_id", F.size("tok").alias("n_tokens"), F.array_join("tok", "|").alias("tokens"))


@query("x7_filter_tokens", f"""
WITH t AS (SELECT doc_id, {sql_filter_tokens('text')} AS tok FROM documents)
SELECT doc_id, CAST(len(tok) AS INT) AS n_tokens, array_to_string(tok, '|') AS tokens FROM t
""")
def x7_filter_tokens(spark, sf):
    t = _docs(spark, sf).select("doc_id", tx.filter_tokens("text").alias("tok"))
    return t.select("doc_id", F.size("tok").alias("n_tokens"), F.array_join("tok", "|").alias("tokens"))


@query("x8_word_tokens", f"""
WITH t AS (SELECT doc_id, unnest({sql_word_tokens('text')}) AS word FROM documents)
SELECT word, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY word
""")
def x8_word_tokens(spark, sf):
    t = _docs(spark, sf).select("doc_id", tx.word_tokens("text").alias("_t"))
    t = tx.explode_nonempty(t, F.col("_t"), "word", "doc_id")
    return t.groupBy("word").agg(F.countDistinct("doc_id").alias("df"), F.count(F.lit(1)).alias("tf"))


_SENT_SQL = (r"list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), "
             r"'([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')")


@query("x9_sentences", f"""
WITH s AS (SELECT doc_id, {_SENT_SQL} AS sents FROM documents),
u AS (SELECT doc_id, unnest(sents) AS sentence, unnest(range(len(sents))) AS pos FROM s)
SELECT doc_id, CAST(pos AS INT) AS pos, sentence FROM u
""")
def x9_sentences(spark, sf):
    d = _docs(spark, sf)
    return tx.explode_nonempty(d, tx.sentences("text"), "sentence", "doc_id", with_pos="pos").select("doc_id", "pos", "sentence")


@query("x10_tokens_to_indices", f"""
WITH t AS (SELECT doc_id, unnest({sql_filter_tokens('text')}) AS word,
                  unnest(range(len({sql_filter_tokens('text')}))) AS pos FROM documents),
v AS (SELECT word, count(*) AS tf, min({{'d': doc_id, 'p': pos}}) AS first_seen FROM t GROUP BY word),
vi AS (SELECT word, row_number() OVER (ORDER BY tf DESC, first_seen) AS idx FROM v)
SELECT doc_id, string_agg(CAST(idx AS VARCHAR), ' ' ORDER BY pos) AS ids
FROM t JOIN vi USING (word) GROUP BY doc_id
""")
def x10_tokens_to_indices(spark, sf):
    docs = _docs(spark, sf)
    vocab = vc.vocabulary(docs, tx.filter_tokens("text"))
    return vc.to_indices(docs, tx.filter_tokens("text"), vocab).select(
        "doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("x11_doc_tensor", f"""
WITH t AS (SELECT doc_id, unnest({sql_filter_tokens('text')}) AS word,
                  unnest(range(len({sql_filter_tokens('text')}))) AS pos FROM documents),
v AS (SELECT word, count(*) AS tf, min({{'d': doc_id, 'p': pos}}) AS first_seen FROM t GROUP BY word),
vi AS (SELECT word, row_number() OVER (ORDER BY tf DESC, first_seen) AS idx FROM v),
s AS (SELECT doc_id, unnest(sents) AS sentence, unnest(range(len(sents))) AS s
      FROM (SELECT doc_id, {_SENT_SQL.replace("text", "lower(text)")} AS sents FROM documents)),
st AS (SELECT doc_id, s, unnest(tok) AS word, unnest(range(len(tok))) AS pos
       FROM (SELECT doc_id, s, {sql_filter_tokens('sentence')} AS tok FROM s WHERE s < 15)),
ids AS (SELECT doc_id, s, idx, row_number() OVER (PARTITION BY doc_id, s ORDER BY pos DESC) AS r FROM st JOIN vi USING (word))
SELECT d.doc_id, 15 AS n_rows, 1500 AS n_cells, CAST(coalesce(sum(ids.idx), 0) AS BIGINT) AS id_sum
FROM documents d LEFT JOIN (SELECT * FROM ids WHERE r <= 100) ids USING (doc_id) GROUP BY d.doc_id
""")
def x11_doc_tensor(spark, sf):
    """X11: 15 x 100 id tensor per document."""
    docs = _docs(spark, sf)
    vocab = vc.vocabulary(docs, tx.filter_tokens("text"))
    t = vc.doc_tensor(docs, vocab, max_sentences=15, max_len=100)
    return t.select("doc_id", F.size("tensor").alias("n_rows"),
                    F.aggregate(F.transform("tensor", lambda r: F.size(r)), F.lit(0), lambda a, b: a + b).alias("n_cells"),
                    F.aggregate(F.flatten("tensor"), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("id_sum"))


@query("x12_ngrams", f"""
WITH t AS (SELECT item_id, {sql_word_tokens('text')} AS tok FROM benchmark),
g AS (SELECT item_id, 1 AS n, unnest(tok) AS gram FROM t
      UNION ALL SELECT item_id, 2 AS n, unnest({sql_ngrams('tok', 2)}) FROM t
      UNION ALL SELECT item_id, 3 AS n, unnest({sql_ngrams('tok', 3)}) FROM t)
SELECT item_id, n, gram, count(*) AS cnt FROM g GROUP BY item_id, n, gram
""")
def x12_ngrams(spark, sf):
    t = table(spark, sf, "benchmark").select("item_id", tx.word_tokens("text").alias("tok"))
    parts = [t.select("item_id", F.lit(n).alias("n"), F.explode(tx.ngrams("tok", n)).alias("gram")) for n in (1, 2, 3)]
    g = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return g.groupBy("item_id", "n", "gram").agg(F.count(F.lit(1)).alias("cnt"))


_BIGRAMS_SQL = "[" + ", ".join(sql_str(b) for b in BIGRAMS) + "]"


_WB = r"[\p{L}\p{N}_]"


@query("x13_merge_bigrams", f"""
WITH t AS (SELECT p_partkey, upper(p_name[1]) || p_name[2:] || ', ' || lower(p_type) || '  ' || upper(p_name) || '.' AS s FROM part)
SELECT p_partkey, {"regexp_replace(" * len(BIGRAMS)}s{"".join(
    rf", '\b({b.split()[0]})\s+({b.split()[1]})\b', '\1\2', 'gi')" for b in BIGRAMS)} AS merged FROM t
""")
def x13_merge_bigrams(spark, sf):
    """X13 on part names with capitals, punctuation and double spaces (the list has no overlapping pairs)."""
    p = table(spark, sf, "part")
    s = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"), F.lit(", "), F.lower("p_type"), F.lit("  "),
                 F.upper("p_name"), F.lit("."))
    return p.select("p_partkey", tx.merge_bigrams(s, BIGRAMS).alias("merged"))


_SEED_BIGRAMS = {"a": ["red", "red widget", "small ring"], "b": ["hot gear", "small ring", "cold plate now"]}


@query("x14_seed_bigrams", f"""
WITH s AS (SELECT *, len(string_split(word, ' ')) = 2 AS two FROM {seeds_values_sql(_SEED_BIGRAMS)} s),
m AS (SELECT word AS bigram, 'jj' || min(pos) AS mono FROM s WHERE two GROUP BY word),
d AS (SELECT label, CASE WHEN two THEN 'jj' || pos ELSE word END AS word, word AS old FROM s)
SELECT d.label, d.word, CAST(count(p.p_partkey) AS BIGINT) AS n_parts, any_value(m.mono) AS mono
FROM d LEFT JOIN part p ON contains(p.p_name, d.old) LEFT JOIN m ON m.bigram = d.old GROUP BY d.label, d.word, d.old
""")
def x14_seed_bigrams(spark, sf):
    """Two-word seeds become one made-up word; with the number of part names that hold the seed and the word the map gives."""
    from seedweave.operators.mapping import keyword_containment
    from seedweave.sources.dictionaries import seeds_from_dict
    seeds = seeds_from_dict(spark, _SEED_BIGRAMS)
    new, pairs = tx.merge_seed_bigrams(seeds)
    both = seeds.withColumnRenamed("word", "old").join(new, ["label", "pos"])
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    hits = keyword_containment(parts, "p_name", seeds.select(F.col("word").alias("kw")).distinct(), "kw") \
        .groupBy("kw").agg(F.count(F.lit(1)).alias("n"))
    j = both.join(hits, F.col("old") == F.col("kw"), "left").join(pairs.withColumnRenamed("word", "mono"), F.col("old") == F.col("bigram"), "left")
    return j.select("label", "word", F.coalesce("n", F.lit(0)).cast("long").alias("n_parts"), "mono")


@query("x16_join_sentences", f"""
WITH s AS (SELECT doc_id, {_SENT_SQL} AS sents FROM documents)
SELECT doc_id, array_to_string(sents, ' . ') AS text FROM s
""")
def x16_join_sentences(spark, sf):
    """A text's sentences joined again."""
    return _docs(spark, sf).select("doc_id", tx.join_sentences(tx.sentences("text")).alias("text"))


@query("x16_rebuild_text", f"""
WITH t AS (SELECT doc_id, unnest({sql_filter_tokens('text')}) AS word,
                  unnest(range(len({sql_filter_tokens('text')}))) AS pos FROM documents)
SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS sentence FROM t GROUP BY doc_id
""")
def x16_rebuild_text(spark, sf):
    """Token rows back to one string per document, in position order (shuffle by doc)."""
    t = tx.explode_nonempty(_docs(spark, sf), tx.filter_tokens("text"), "word", "doc_id", with_pos="pos")
    agg = t.groupBy("doc_id").agg(F.collect_list(F.struct("pos", F.col("word").alias("text"))).alias("items"))
    return agg.select("doc_id", tx.join_ordered("items").alias("sentence"))


@query("x27_split_trim", r"""
WITH t AS (SELECT p_partkey, list_filter(list_transform(string_split(replace(p_name, ' ', ' , '), ','),
                  lambda p: trim(p)), lambda p: p <> '') AS parts FROM part)
SELECT p_partkey, CAST(pos AS INT) AS pos, part FROM (SELECT p_partkey, unnest(parts) AS part,
       unnest(range(len(parts))) AS pos FROM t)
""")
def x27_split_trim(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit(" , ")).alias("lst"))
    return p.select("p_partkey", F.posexplode(tx.split_trim("lst", ",")).alias("pos", "part"))


_WC_SQL = pairs_values_sql(WORD_CATEGORY, "word", "category")


@query("x28_map_lookup", f"""
WITH t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word,
                  unnest(range(len(string_split(p_name, ' ')))) AS pos FROM part),
m AS (SELECT t.p_partkey, t.pos, c.category FROM t JOIN {_WC_SQL} c USING (word))
SELECT p.p_partkey, coalesce(string_agg(m.category, ',' ORDER BY m.pos, m.category), '') AS categories
FROM part p LEFT JOIN m USING (p_partkey) GROUP BY p.p_partkey
""")
def x28_map_lookup(spark, sf):
    """Map each list item through a lookup map, flatten, unknown items skipped."""
    from seedweave.operators.mapping import lookup_map_column
    m = lookup_map_column(spark, WORD_CATEGORY)
    p = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    cats = F.flatten(F.transform("words", lambda w: F.coalesce(F.array_sort(m[w]), F.array().cast("array<string>"))))
    return p.select("p_partkey", F.array_join(cats, ",").alias("categories"))


_PRIO_SQL = "[" + ", ".join(sql_str(r) for r in ROLE_PRIORITY) + "]"


@query("x29_join_by_priority", f"""
SELECT conv_id, string_agg(text, ' ' ORDER BY coalesce(list_position({_PRIO_SQL}, role), 1000000), turn) AS whole_text
FROM conversations GROUP BY conv_id
""")
def x29_join_by_priority(spark, sf):
    from seedweave.operators.windows import priority_rank
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text", priority_rank("role", ROLE_PRIORITY).alias("prio"))
    agg = c.groupBy("conv_id").agg(F.collect_list(F.struct("prio", "turn", "text")).alias("items"))
    return agg.select("conv_id", tx.join_ordered("items").alias("whole_text"))


@query("x30_default_null_row", f"""
WITH t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part),
m AS (SELECT DISTINCT t.p_partkey, c.category FROM t JOIN {_WC_SQL} c USING (word))
SELECT p.p_partkey, m.category FROM part p LEFT JOIN m USING (p_partkey)
""")
def x30_default_null_row(spark, sf):
    """Empty category list -> one row with a NULL category (``explode_outer``)."""
    from seedweave.operators.mapping import lookup_map_column
    m = lookup_map_column(spark, WORD_CATEGORY)
    p = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    cats = F.array_distinct(F.flatten(F.transform("words", lambda w: F.coalesce(m[w], F.array().cast("array<string>")))))
    return p.select("p_partkey", F.explode_outer(cats).alias("category"))


@query("x31_truncate_tokens", f"""
WITH t AS (SELECT doc_id, {sql_filter_tokens('text')}[1:512] AS tok FROM documents)
SELECT doc_id, CAST(len(tok) AS INT) AS n_tokens, array_to_string(tok, ' ') AS text512 FROM t
""")
def x31_truncate_tokens(spark, sf):
    t = _docs(spark, sf).select("doc_id", tx.truncate_tokens(tx.filter_tokens("text"), 512).alias("tok"))
    return t.select("doc_id", F.size("tok").alias("n_tokens"), F.array_join("tok", " ").alias("text512"))


@query("x32_language_guess", f"""
WITH tok AS (SELECT doc_id, unnest({sql_filter_tokens('text')}) AS word FROM documents),
prof AS {seeds_values_sql(SEEDS)},
cnt AS (SELECT doc_id, label, count(*) AS n FROM tok JOIN (SELECT DISTINCT label, word FROM prof) p USING (word)
        GROUP BY doc_id, label),
best AS (SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, label) AS rk
         FROM cnt) WHERE rk = 1)
SELECT d.doc_id, d.lang, coalesce(b.label, 'error') AS guess FROM documents d LEFT JOIN best b USING (doc_id)
""")
def x32_language_guess(spark, sf):
    """Language guess by a function-word profile vote; ``error`` when nothing hits."""
    from seedweave.operators import match
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    toks = match.explode_tokens(docs, tx.filter_tokens("text"))
    best = match.argmax_rule(match.label_counts(toks, seeds_from_dict(spark, SEEDS)))
    return (docs.select("doc_id", "lang")
            .join(best.select("doc_id", "label"), "doc_id", "left")
            .select("doc_id", "lang", F.coalesce("label", F.lit("error")).alias("guess")))


@query("f15_stop_words", f"""
WITH t AS (SELECT doc_id, list_filter({sql_filter_tokens('text')},
             lambda w: NOT list_contains([{', '.join(sql_str(w) for w in tx.ENGLISH_STOP_WORDS + tx.EXTRA_STOP_WORDS)}], w)
                       AND length(regexp_replace(w, '{PUNCT_CLASS.replace("'", "''")}', '', 'g')) > 0) AS tok FROM documents)
SELECT doc_id, CAST(len(tok) AS INT) AS n_tokens, array_to_string(tok, ' ') AS kept FROM t
""")
def f15_stop_words(spark, sf):
    t = _docs(spark, sf).select("doc_id", tx.remove_stop_words(tx.filter_tokens("text")).alias("tok"))
    return t.select("doc_id", F.size("tok").alias("n_tokens"), F.array_join("tok", " ").alias("kept"))


@query("x15_sense_parts", f"""
WITH t AS (SELECT item_id, unnest({sql_filter_tokens('text')}) AS w, unnest(range(len({sql_filter_tokens('text')}))) AS pos FROM benchmark),
u AS (SELECT item_id, pos, CASE pos % 4 WHEN 0 THEN w WHEN 1 THEN w || '$' || (pos % 7) WHEN 2 THEN w || '$x' ELSE w || '$a$' || (pos % 5) END AS tok
      FROM t)
SELECT item_id, CAST(pos AS INT) AS pos, CASE pos % 4 WHEN 1 THEN string_split(tok, '$')[1] WHEN 3 THEN string_split(tok, '$')[1] || '$a'
         ELSE tok END AS word, CAST(CASE pos % 4 WHEN 1 THEN pos % 7 WHEN 3 THEN pos % 5 END AS VARCHAR) AS sense FROM u
""")
def x15_sense_parts(spark, sf):
    """Word and sense of tokens with a sense, without one, and with several marks."""
    b = table(spark, sf, "benchmark")
    t = tx.explode_nonempty(b, tx.filter_tokens("text"), "w", "item_id", with_pos="pos")
    k = F.col("pos") % 4
    tok = F.when(k == 0, F.col("w")).when(k == 1, F.concat("w", F.lit("$"), F.col("pos") % 7)).when(k == 2, F.concat("w", F.lit("$x"))) \
        .otherwise(F.concat("w", F.lit("$a$"), F.col("pos") % 5))
    return t.select("item_id", "pos", tx.sense_word(tok).alias("word"), tx.sense_index(tok).cast("string").alias("sense"))
