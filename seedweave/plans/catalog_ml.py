"""Queries for the learning jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from seedweave.functions.text import (PUNCTUATION, char_class, explode_nonempty, filter_tokens, punctuation_to_space,
                                      word_tokens)
from seedweave.operators import corpus_senses as cs
from seedweave.operators import clusters, factor, linear, ml, packed, skipgram
from seedweave.operators.common import Scratch, cut_lineage, local_table, stored
from seedweave.operators.match import inrow_share_labels
from seedweave.plans.catalog_rank import _corpus_sql, corpus
from seedweave.plans.fixtures import SEEDS, sql_filter_tokens
from seedweave.plans.registry import query
from seedweave.session import spread_table, table

LABELS = sorted(SEEDS)


def _sent_tokens(spark, sf):
    return corpus(spark, sf).select("doc_id", "lang", "tokens", "ftok")


@query("k1_word_vectors")
def k1_word_vectors(spark, sf):
    """K1: skip-gram vectors (size 100, window 5, min count 2), L2-normalised (P)."""
    vecs = skipgram.word_vectors(cs.token_ids(_sent_tokens(spark, sf).select("doc_id", "tokens")))
    from seedweave.functions.vectors import norm
    return vecs.select("word", F.size("vec").alias("dims"), F.round(norm("vec"), 6).alias("norm"))


_MD5_28 = "CAST('0x' || substr(md5({}), 1, 7) AS BIGINT)"


@query("k2_random_vectors", f"""
WITH {_corpus_sql()},
w AS (SELECT DISTINCT unnest(tokens) AS word FROM ct),
x AS (SELECT word, -0.25::DOUBLE + 0.5::DOUBLE * ({_MD5_28.format("word || ':' || i || ':42'")} / 268435455.0::DOUBLE) AS v
      FROM w, range(0, 100) r(i))
SELECT word, round(min(v), 6) AS lo, round(max(v), 6) AS hi FROM x GROUP BY word
""")
def k2_random_vectors(spark, sf):
    """K2: hash-seeded uniform(-0.25, 0.25) vectors for words without one."""
    words = explode_nonempty(_sent_tokens(spark, sf), F.col("tokens"), "word").select("word").distinct()
    v = ml.random_vectors(words)
    return v.select("word", F.round(F.array_min("vec"), 6).alias("lo"), F.round(F.array_max("vec"), 6).alias("hi"))


@query("k3_train_dev_split", f"""
SELECT doc_id, CASE WHEN {_MD5_28.format("CAST(doc_id AS VARCHAR) || ':42'")} % 10 < 1 THEN 'dev' ELSE 'train' END AS split
FROM documents
""")
def k3_train_dev_split(spark, sf):
    """K3: 90/10 split by hash of the document id."""
    d = table(spark, sf, "documents").select("doc_id")
    return ml.train_dev_split(d, "doc_id")


_PUNCT_SQL = char_class(PUNCTUATION).replace("'", "''")


@query("k8_smooth_tfidf", f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(lower(text), '{_PUNCT_SQL}', ' ', 'g'),
                  '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS word FROM benchmark_docs),
tf AS (SELECT doc_id, word, count(*) AS tf FROM t GROUP BY doc_id, word),
n AS (SELECT count(DISTINCT doc_id) AS n FROM t),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
x AS (SELECT doc_id, word, tf * (ln((1 + (SELECT n FROM n)) / (1 + df)) + 1) AS x FROM tf JOIN df USING (word))
SELECT doc_id, word, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM x
""".replace("benchmark_docs", "(SELECT item_id AS doc_id, text FROM benchmark)"))
def k8_smooth_tfidf(spark, sf):
    """K8: smooth idf tf-idf with L2 norm, punctuation-to-space preprocessing (R)."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    t = explode_nonempty(b, word_tokens(punctuation_to_space("text")), "word", "doc_id")
    return ml.smooth_tfidf(t).select("doc_id", "word", F.round("weight", 6).alias("weight"))


def _clustered(spark, sf, k=4):
    """(tokens, cluster) of every row of the documents: k-means of their tf-idf vectors."""
    c = stored(_sent_tokens(spark, sf).select(F.monotonically_increasing_id().alias("doc"), "tokens"), "tokens", "zstd")
    entries = packed.tfidf(c, c.count(), "doc", min_df=2, tokens="tokens")
    matrix = packed.pack(entries, c.select("doc"))
    try:
        return c.join(clusters.kmeans(matrix, k), "doc")
    finally:
        matrix.release()


def _fitted(spark, sf, weights: bool):
    """All labels' classifiers on the pseudo-labels of the documents: the scores or the weights."""
    tables = Scratch(spark)
    lab = inrow_share_labels(_sent_tokens(spark, sf).select("doc_id", "ftok", "tokens"), "ftok", SEEDS)
    c = tables.stored(lab.select("doc_id", "tokens", "labels"), "tokens", "zstd")
    pseudo = stored(c.select(F.col("doc_id").alias("doc"), F.explode_outer("labels").alias("label")).where(F.col("label").isNotNull()), "pseudo")
    entries = linear.smooth_tfidf(c, min_df=2, tokens="tokens")
    matrix = packed.pack(entries, c.select(F.col("doc_id").alias("doc")).distinct(), unit=True)
    tables.drop("tokens")
    try:
        scores, coefficients = linear.fit_packed(matrix, pseudo, LABELS)
        return stored(coefficients(), "weights") if weights else scores
    finally:
        matrix.release()


@query("k5_classifier_scores")
def k5_classifier_scores(spark, sf):
    """K4 + K5: a logistic regression per label on pseudo-labels, all in one optimisation; scores for every document (P)."""
    scores = _fitted(spark, sf, weights=False)
    return scores.select(F.col("doc").alias("doc_id"), "label", F.round("prob", 6).alias("prob"))


@query("k4_label_weights")
def k4_label_weights(spark, sf):
    """K4: the coefficients of every label's classifier, the intercept as the word null (P)."""
    weights = _fitted(spark, sf, weights=True)
    return weights.select(F.col("feature").alias("word"), "label", F.round("weight", 6).alias("weight"))


@query("k6_prediction_distribution")
def k6_prediction_distribution(spark, sf):
    """K6: documents per label with score > 0.5 (P)."""
    s = k5_classifier_scores(spark, sf)
    return s.where(F.col("prob") > 0.5).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _pmi(spark, sf, size=20):
    """The corpus (doc_id, tokens) and its word vectors from the PMI table."""
    c = cut_lineage(_sent_tokens(spark, sf).select("doc_id", "tokens"))
    return c, cut_lineage(factor.pmi_vectors(cs.token_ids(c), size))


def _document_block(spark, sf, size=20):
    c, vecs = _pmi(spark, sf, size)
    words = explode_nonempty(c, F.col("tokens"), "word", "doc_id")
    return factor.document_vectors(words, vecs, size)


@query("k9_doc_vectors")
def k9_doc_vectors(spark, sf):
    """K9: mean word vector per document (P)."""
    block = _document_block(spark, sf)
    return block.select(F.col("key").alias("doc_id"), F.posexplode(F.array(*[f"q{i}" for i in range(20)])).alias("dim", "x")) \
        .withColumn("x", F.round("x", 6))


_PMI_LEAST = 200


@query("k1_pmi_entries", f"""
WITH t AS (SELECT doc_id, unnest({sql_filter_tokens('text')}) AS word,
                  unnest(range(len({sql_filter_tokens('text')}))) AS pos FROM documents),
v AS (SELECT word FROM t GROUP BY word HAVING count(*) >= {_PMI_LEAST}),
k AS (SELECT t.* FROM t SEMI JOIN v USING (word)),
p AS (SELECT a.word AS a, b.word AS b, count(*) AS n FROM k a CROSS JOIN range(-5, 6) r(d)
      JOIN k b ON b.doc_id = a.doc_id AND b.pos = a.pos + r.d AND r.d <> 0 GROUP BY a.word, b.word),
s AS (SELECT a, sum(n) AS n FROM p GROUP BY a), z AS (SELECT sum(n) AS n FROM p),
x AS (SELECT p.a, p.b, ln(p.n * z.n / (s.n * o.n::DOUBLE)) - ln(2.0::DOUBLE) AS x
      FROM p JOIN s ON s.a = p.a JOIN s o ON o.a = p.b CROSS JOIN z)
SELECT a AS word, b AS near, round(x, 6) AS x FROM x WHERE x > 0
""")
def k1_pmi_entries(spark, sf):
    """K1: the shifted positive PMI table of the corpus' frequent words, which the word vectors factorise."""
    d = spread_table(spark, sf, "documents", "doc_id", "text").select("doc_id", filter_tokens("text").alias("tokens"))
    corpus_ = cs.token_ids(d)
    x = factor.shifted_pmi(factor.cooccurrences(corpus_, least=_PMI_LEAST), shift=2.0)
    name = lambda side, to: corpus_.vocabulary.select(F.col("wid").alias(side), F.col("word").alias(to))
    return x.join(name("a", "word"), "a").join(name("b", "near"), "b").select("word", "near", F.round("x", 6).alias("x"))


@query("k1_pmi_vectors")
def k1_pmi_vectors(spark, sf):
    """K1: word vectors of length 1 from the PMI table, by block power iteration (P)."""
    _, vecs = _pmi(spark, sf)
    return vecs.select("word", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query("a26_cluster_sizes")
def a26_cluster_sizes(spark, sf):
    """K10 + A26: k-means (k=4) of tf-idf document vectors, size of each cluster (P)."""
    return _clustered(spark, sf).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("a26_cluster_words")
def a26_cluster_words(spark, sf):
    """The words that mark each k-means cluster (P)."""
    return ml.cluster_words(_clustered(spark, sf)).select("cluster", "word", F.round("rank", 6).alias("rank"), "pos")


@query("k11_pca")
def k11_pca(spark, sf):
    """2-d PCA of the document vectors, and of the centers of four clusters of them (P)."""
    block = cut_lineage(_document_block(spark, sf))
    mean, directions, proj = factor.pca(block, 20, 2)
    from pyspark.ml.functions import array_to_vector
    feats = block.select("key", array_to_vector(F.array(*[f"q{i}" for i in range(20)])).alias("features"))
    km, _ = ml.kmeans_clusters(feats, 4)
    centers = [(-1 - i, *((c - mean) @ directions).tolist()) for i, c in enumerate(km.clusterCenters())]
    both = proj.unionByName(local_table(spark, centers, ["key", "q0", "q1"], ["long", "double", "double"]))
    return both.select(F.col("key").alias("doc_id"), F.round("q0", 6).alias("pc1"), F.round("q1", 6).alias("pc2"))


@query("k12_svd")
def k12_svd(spark, sf):
    """Rows of the tf-idf matrix of ``benchmark`` on its 3 leading directions, with the singular values (P)."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("row"), word_tokens("text").alias("tokens"))
    tf = explode_nonempty(b, F.col("tokens"), "column", "row").groupBy("row", "column").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("column").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((b.agg(F.count(F.lit(1))).scalar() + 1) / (F.col("df") + 1))
    entries = cut_lineage(tf.join(df, "column").select("row", "column", (F.col("tf") * idf).alias("x")))
    sigma, proj = factor.truncated_svd(entries, 3, more=24)
    return proj.select(F.col("key").alias("doc_id"), F.posexplode(F.array("q0", "q1", "q2")).alias("i", "x")) \
        .select("doc_id", "i", F.round("x", 6).alias("x"), F.round(F.array(*[F.lit(float(v)) for v in sigma])[F.col("i")], 6).alias("sigma"))


_SEED_WORDS = sorted({w for ws in SEEDS.values() for w in ws})


@query("k15_similar_words")
def k15_similar_words(spark, sf):
    """The 5 nearest words of each seed word (P)."""
    _, vecs = _pmi(spark, sf)
    return factor.nearest_words(vecs, local_table(spark, [(w,) for w in _SEED_WORDS], ["word"])) \
        .withColumn("similarity", F.round("similarity", 6))


@query("k15_nearest_given_vectors", f"""
WITH {_corpus_sql()},
w AS (SELECT DISTINCT unnest(tokens) AS word FROM ct),
x AS (SELECT word, i, -0.25::DOUBLE + 0.5::DOUBLE * ({_MD5_28.format("word || ':' || i || ':42'")} / 268435455.0::DOUBLE) AS v
      FROM w, range(0, 8) r(i)),
v AS (SELECT word, list(v ORDER BY i) AS vec FROM x GROUP BY word),
p AS (SELECT a.word AS seed, b.word, round(list_cosine_similarity(a.vec, b.vec), 9) AS c FROM v a JOIN v b ON a.word <> b.word
      WHERE a.word IN ({", ".join(f"'{w}'" for w in _SEED_WORDS)}))
SELECT seed, word, round(c, 6) AS similarity FROM p
QUALIFY row_number() OVER (PARTITION BY seed ORDER BY c DESC, word) <= 5
""")
def k15_nearest_given_vectors(spark, sf):
    """K15 with the hash vectors (K2) of all words of the corpus."""
    words = explode_nonempty(_sent_tokens(spark, sf), F.col("tokens"), "word").select("word").distinct()
    vecs = cut_lineage(ml.random_vectors(words, size=8))
    return factor.nearest_words(vecs, local_table(spark, [(w,) for w in _SEED_WORDS], ["word"])) \
        .withColumn("similarity", F.round("similarity", 6))


def _trigram_model():
    """A stand-in external model: hashed letter trigrams of a text against those of each label's seed words (cosines)."""
    import zlib

    import numpy as np
    bins = 512

    def profile(text):
        t = f" {text.lower()} "
        return np.bincount([zlib.crc32(t[i:i + 3].encode()) % bins for i in range(len(t) - 2)], minlength=bins).astype(float)

    weights = np.stack([profile(" ".join(SEEDS[l])) for l in LABELS], 1)
    weights /= np.linalg.norm(weights, axis=0)

    def predict(texts):
        x = np.stack([profile(t) for t in texts])
        return (x @ weights / np.linalg.norm(x, axis=1, keepdims=True)).tolist()
    return predict


@query("k7_external_model_scores")
def k7_external_model_scores(spark, sf):
    """K7: a caller-supplied model scored with mapInPandas, loaded once per task (P)."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    s = ml.score_with_model(d, _trigram_model, "text", "doc_id", LABELS)
    return s.select("doc_id", "label", F.round("score", 6).alias("score"))
