"""Queries for word statistics, ranks and dictionary refinement
(A1-A8, A11, T2, P15, U6, N2, W10, W11, P16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seedweave.functions.text import filter_tokens, ngrams, small_clean, whitespace_tokens
from seedweave.operators import metrics as mt
from seedweave.operators import rank as rk
from seedweave.operators.match import inrow_share_labels
from seedweave.plans.fixtures import SEEDS, seeds_values_sql, sql_filter_tokens, sql_ngrams
from seedweave.plans.registry import query
from seedweave.session import spread_table
from seedweave.sources.dictionaries import seeds_from_dict

# A dictionary with one label that never matches (its old seeds are kept, U6).
SEEDS_U6 = dict(SEEDS, it=["della", "degli"])

_CLEAN_SQL = (r"regexp_replace(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), "
              r"'\S*\p{Nd}\S*', '', 'g'), '^\s+|\s+$', '', 'g'), ' +', ' ', 'g')")


def _corpus_sql(seeds=SEEDS) -> str:
    """Oracle CTEs: cleaned corpus, its two token lists, P2 labels, df, N, label stats."""
    return f"""
c AS (SELECT doc_id, lang, {_CLEAN_SQL} AS s FROM documents),
ct AS (SELECT doc_id, lang, {sql_filter_tokens('s')} AS ftok,
              list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '') AS tokens FROM c),
tok AS (SELECT doc_id, unnest(ftok) AS word FROM ct),
seeds AS {seeds_values_sql(seeds)},
cnt AS (SELECT doc_id, label, count(*) AS n FROM tok JOIN (SELECT DISTINCT label, word FROM seeds) s USING (word)
        GROUP BY doc_id, label),
st AS (SELECT *, n / sum(n) OVER (PARTITION BY doc_id) AS share,
              row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, label) AS rk FROM cnt),
fin AS (SELECT *, max(CAST(share >= 0.2 AS INT)) OVER (PARTITION BY doc_id) AS anyp FROM st),
p2 AS (SELECT doc_id, label FROM fin WHERE share >= 0.2 OR (anyp = 0 AND rk = 1)),
nd AS (SELECT count(*) AS n FROM ct),
dfw AS (SELECT word, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(tokens)) AS word FROM ct) GROUP BY word),
lab AS (SELECT p2.label, ct.tokens FROM p2 JOIN ct USING (doc_id)),
dfl AS (SELECT label, word, count(*) AS df_l FROM (SELECT label, unnest(list_distinct(tokens)) AS word FROM lab) GROUP BY ALL),
tfl AS (SELECT label, word, count(*) AS tf_l FROM (SELECT label, unnest(tokens) AS word FROM lab) GROUP BY ALL),
nl AS (SELECT label, count(*) AS n_l FROM p2 GROUP BY label),
rt AS (SELECT label, word, df_l / df AS reldocfreq, ln((SELECT n FROM nd) / df) AS idf, tanh(tf_l / n_l) AS rel_freq,
              df_l / df * ln((SELECT n FROM nd) / df) * tanh(tf_l / n_l) AS rank
       FROM dfl JOIN tfl USING (label, word) JOIN dfw USING (word) JOIN nl USING (label) WHERE df_l >= 5)
"""


def corpus(spark, sf):
    d = spread_table(spark, sf, "documents", "doc_id", "lang", "text") \
        .select("doc_id", "lang", small_clean("text", squeeze=False).alias("s"))
    return d.select("doc_id", "lang", filter_tokens("s", lower=False).alias("ftok"), whitespace_tokens("s").alias("tokens"))


def labelled(corp, seeds=SEEDS):
    # No filter on the labels: a pushed-down filter would copy the whole label
    # expression below the projection. Empty label arrays vanish in the explodes.
    lab = inrow_share_labels(corp.select("doc_id", "ftok", "tokens"), "ftok", seeds)
    return lab.select("doc_id", "tokens", "labels")


def _r6(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("a1_doc_freq", f"""
WITH {_corpus_sql()}
SELECT word, df FROM dfw UNION ALL SELECT 'UNK' AS word, n AS df FROM nd
""")
def a1_doc_freq(spark, sf):
    return rk.doc_freq_with_unk(corpus(spark, sf))


@query("a2_label_doc_freq", f"""
WITH {_corpus_sql()}
SELECT label, word, df_l FROM dfl
""")
def a2_label_doc_freq(spark, sf):
    ls = rk.label_stats(labelled(corpus(spark, sf)))
    return ls.select("label", "word", "df_l")


@query("a3_idf", f"""
WITH {_corpus_sql()}
SELECT word, round(ln((SELECT n FROM nd) / df), 6) AS idf FROM dfw
""")
def a3_idf(spark, sf):
    c = corpus(spark, sf)
    n = c.agg(F.count(F.lit(1))).scalar()
    return _r6(rk.inverse_doc_freq(rk.doc_freq(c), n).select("word", "idf"), {"idf"})


@query("a4_ngram_doc_freq", f"""
WITH c AS (SELECT doc_id, {_CLEAN_SQL} AS s FROM documents),
ct AS (SELECT doc_id, list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '') AS tok FROM c),
g AS (SELECT doc_id, list_distinct(list_concat(tok, {sql_ngrams('tok', 2)})) AS grams FROM ct)
SELECT gram, count(*) AS df FROM (SELECT doc_id, unnest(grams) AS gram FROM g) GROUP BY gram
""")
def a4_ngram_doc_freq(spark, sf):
    """Document frequency of 1- and 2-grams (clean n-grams, Q7 not replayed)."""
    c = corpus(spark, sf).select("doc_id", "tokens")
    g = c.select(F.concat("tokens", ngrams("tokens", 2)).alias("grams"))
    return rk.doc_freq(g, "grams").withColumnRenamed("word", "gram")


@query("a5_relative_frequency", f"""
WITH {_corpus_sql()}
SELECT label, word, round(tf_l / n_l, 6) AS rel_freq_raw FROM tfl JOIN nl USING (label)
""")
def a5_relative_frequency(spark, sf):
    lab = labelled(corpus(spark, sf))
    counts = rk.word_counts(lab)
    ls = rk.label_stats(lab, counts=counts)
    nl = rk.docs_per_label(lab, counts=counts)
    out = ls.join(nl, "label").select("label", "word", (F.col("tf_l") / F.col("n_l")).alias("rel_freq_raw"))
    return _r6(out, {"rel_freq_raw"})


@query("a6_rank_table", f"""
WITH {_corpus_sql()}
SELECT label, word, round(reldocfreq, 6) AS reldocfreq, round(idf, 6) AS idf, round(rel_freq, 6) AS rel_freq,
       round(rank, 6) AS rank FROM rt
""")
def a6_rank_table(spark, sf):
    r, _ = rk.rank_labelled(labelled(corpus(spark, sf)), min_df=5)
    return _r6(r, {"reldocfreq", "idf", "rel_freq", "rank"})


@query("a7_subset_stats", f"""
WITH c AS (SELECT doc_id, lang, {_CLEAN_SQL} AS s FROM documents),
ct AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '') AS tokens FROM c),
nd AS (SELECT count(*) AS n FROM ct),
dfw AS (SELECT word, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(tokens)) AS word FROM ct) GROUP BY word),
sub AS (SELECT lang AS label, tokens FROM ct),
dfl AS (SELECT label, word, count(*) AS df_l FROM (SELECT label, unnest(list_distinct(tokens)) AS word FROM sub) GROUP BY ALL),
tfl AS (SELECT label, word, count(*) AS tf_l FROM (SELECT label, unnest(tokens) AS word FROM sub) GROUP BY ALL),
nl AS (SELECT label, count(*) AS n_l FROM sub GROUP BY label),
rt AS (SELECT label, word, df_l / df * ln((SELECT n FROM nd) / df) * tanh(tf_l / n_l) AS rank
       FROM dfl JOIN tfl USING (label, word) JOIN dfw USING (word) JOIN nl USING (label)),
top AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY rank DESC, word) AS pos FROM rt)
SELECT label AS lang, word, round(rank, 6) AS rank, pos FROM top WHERE pos <= 80
""")
def a7_subset_stats(spark, sf):
    """Top 80 words of each language against the whole corpus, one pass."""
    r = rk.subset_stats(corpus(spark, sf), group="lang", top=80)
    return _r6(r.select("lang", "word", "rank", "pos"), {"rank"})


_P15_SQL = f"""
{_corpus_sql(SEEDS_U6)},
nlp AS (SELECT label, least(5, CAST(floor(ln(n_l) / ln(1.5)) AS INT)) AS top_n FROM nl WHERE n_l > 0),
top AS (SELECT rt.*, nlp.top_n, row_number() OVER (PARTITION BY rt.label ORDER BY rank DESC, word) AS pos
        FROM rt JOIN nlp USING (label) WHERE rank > 0),
chosen AS (SELECT label, word FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY rank DESC, label) AS rn
           FROM top WHERE pos <= top_n) WHERE rn = 1),
kept AS (SELECT label, word FROM seeds WHERE label NOT IN (SELECT label FROM nlp)),
newd AS (SELECT * FROM chosen UNION ALL SELECT * FROM kept)
"""


def _round1(spark, sf, counts=None):
    """The round-1 dictionary, from the corpus or from its word counts by label."""
    ranks, per_label = rk.rank_labelled(labelled(corpus(spark, sf), SEEDS_U6), min_df=5, counts=counts)
    return rk.expand(ranks, per_label, seeds_from_dict(spark, SEEDS_U6), iteration=1)


@query("p15_expand_round1", f"""
WITH {_P15_SQL}
SELECT label, word FROM newd
""")
def p15_expand_round1(spark, sf):
    """Round 1 of the refinement with the rule-based predictor (W5 + W6 + U6)."""
    return _round1(spark, sf)


@query("u6_keep_old_seeds", f"""
WITH {_P15_SQL}
SELECT label, word FROM kept
""")
def u6_keep_old_seeds(spark, sf):
    new = _round1(spark, sf)
    old = seeds_from_dict(spark, SEEDS_U6).select("label", "word")
    return new.join(old, ["label", "word"], "left_semi").where(F.col("label") == "it")


@query("a11_dictionary_sizes", f"""
WITH {_P15_SQL},
d AS (SELECT 0 AS iteration, label, word FROM seeds UNION ALL SELECT 1 AS iteration, label, word FROM newd)
SELECT coalesce(iteration, -1) AS iteration, coalesce(label, '*') AS label, count(*) AS n_words FROM d GROUP BY ROLLUP (iteration, label)
""")
def a11_dictionary_sizes(spark, sf):
    d0 = seeds_from_dict(spark, SEEDS_U6).select(F.lit(0).alias("iteration"), "label", "word")
    d1 = _round1(spark, sf).select(F.lit(1).alias("iteration"), "label", "word")
    return mt.dictionary_sizes(d0.unionByName(d1))


@query("n2_dictionary_diff", f"""
WITH {_P15_SQL},
b AS (SELECT DISTINCT label, word FROM seeds), a AS (SELECT DISTINCT label, word FROM newd)
SELECT coalesce(b.label, a.label) AS label, coalesce(b.word, a.word) AS word,
       CASE WHEN a.word IS NULL THEN 'removed' WHEN b.word IS NULL THEN 'added' ELSE 'kept' END AS status
FROM b FULL OUTER JOIN a ON a.label = b.label AND a.word = b.word
""")
def n2_dictionary_diff(spark, sf):
    """Words added, removed and kept between the seeds and round 1."""
    return mt.added_removed_kept(seeds_from_dict(spark, SEEDS_U6), _round1(spark, sf))


@query("p16_refine_loop")
def p16_refine_loop(spark, sf):
    """Six rounds of label -> rank -> rewrite dictionary; each round's
    dictionary is written under the checkpoint folder and read back (P)."""
    from seedweave.plans.refine import refine_dictionary
    hist = refine_dictionary(spark, corpus(spark, sf), SEEDS)
    return hist.select("iteration", "label", "word")


@query("p16_refine_loop_trained")
def p16_refine_loop_trained(spark, sf):
    """P16 as in the reference: six rounds of label -> train -> predict -> rank -> rewrite dictionary (P)."""
    from seedweave.plans.refine import refine_dictionary, trained_predictor
    corp = corpus(spark, sf)
    return refine_dictionary(spark, corp, SEEDS, predictor=trained_predictor(corp)).select("iteration", "label", "word")
