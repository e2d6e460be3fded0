"""Word statistics, label-word ranks and dictionary refinement
(A1-A8, W4-W6, P14, P15, U6, T2).

All statistics come from two token streams per document, both produced inside
the scan stage (no shuffle before aggregation):

* distinct words of a document  -> document frequencies (corpus and per label)
* all word occurrences          -> term frequencies per label

Each aggregation is keyed by ``word`` or ``(label, word)`` with map-side
partial aggregation, so the shuffles carry at most one row per distinct key
and map task. The document's labels travel with its row (an array column), so
a document never has to be shuffled to meet its labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedweave.functions.text import explode_nonempty
from seedweave.operators.common import stored


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doc_freq(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """A1: (word, df) over a tokens column; ``n_docs`` is a separate scalar."""
    return (explode_nonempty(docs, F.array_distinct(tokens), "word")
            .groupBy("word").agg(F.count(F.lit(1)).alias("df")))


def doc_freq_with_unk(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """A1 as in the reference: the corpus size appears as the row ``UNK``."""
    n = docs.agg(F.lit("UNK").alias("word"), F.count(F.lit(1)).alias("df"))
    return doc_freq(docs, tokens).unionByName(n)


def inverse_doc_freq(df: DataFrame, n_docs: Column) -> DataFrame:
    """A3: idf = ln(N / df). ``n_docs`` is a scalar column (e.g. ``DataFrame.scalar()``)."""
    return df.withColumn("idf", F.log(n_docs / F.col("df")))


def explode_labels(labelled: DataFrame, labels: str = "labels", *cols) -> DataFrame:
    """One row per (document, label).

    ``explode_outer`` + a filter on the generated column: a plain ``explode``
    makes Catalyst infer ``size(labels) > 0`` and push it below the projection
    that computes the labels, which would evaluate the labelling twice.
    """
    return (labelled.select(F.explode_outer(labels).alias("label"), *cols)
            .where(F.col("label").isNotNull()))


def label_stats(labelled: DataFrame, tokens: str = "tokens", labels: str = "labels",
                counts: DataFrame | None = None) -> DataFrame:
    """A2 + A5 inputs: (label, word, df_l, tf_l) for documents carrying a labels array.

    ``counts``: their ``word_counts``, where they are there already.
    """
    counts = word_counts(labelled, tokens, labels) if counts is None else counts
    stats = by_label(counts.where(~F.col("marker")), labels)
    return stats.select("label", "word", F.col("df").alias("df_l"), F.col("tf").alias("tf_l"))


def docs_per_label(labelled: DataFrame, labels: str = "labels", counts: DataFrame | None = None) -> DataFrame:
    """(label, n_l); read from the ``word_counts`` where these are given."""
    if counts is not None:
        # One row per set of labels.
        return by_label(counts.where("marker"), labels).select("label", F.col("tf").alias("n_l"))
    return explode_labels(labelled, labels).groupBy("label").agg(F.count(F.lit(1)).alias("n_l"))


def rank_table(corpus: DataFrame, labelled: DataFrame, tokens: str = "tokens", labels: str = "labels",
               min_df: int = 5, vocabulary: DataFrame | None = None) -> DataFrame:
    """(label, word, reldocfreq, idf, rel_freq, rank) for words with df_l >= min_df.

    rank = (df_l / df) * ln(N / df) * tanh(tf_l / n_l). ``corpus`` gives df and
    N, ``labelled`` the documents of each label (a document is in every bucket
    of its labels). ``vocabulary`` (a ``word`` column) restricts the words.
    """
    n_docs = corpus.agg(F.count(F.lit(1))).scalar()
    dfw = inverse_doc_freq(doc_freq(corpus, tokens), n_docs)
    counts = word_counts(labelled, tokens, labels)
    ls = label_stats(labelled, tokens, labels, counts).where(F.col("df_l") >= min_df)
    if vocabulary is not None:
        ls = ls.join(vocabulary.select("word").distinct(), "word", "left_semi")
    nl = docs_per_label(labelled, labels, counts)
    j = ls.join(dfw, "word").join(nl, "label")  # one row per label: bounded
    out = j.select(
        "label", "word",
        (F.col("df_l") / F.col("df")).alias("reldocfreq"),
        F.col("idf"),
        F.tanh(F.col("tf_l") / F.col("n_l")).alias("rel_freq"))
    return out.withColumn("rank", F.col("reldocfreq") * F.col("idf") * F.col("rel_freq"))


# The extra "word" every document has once: its counts are the numbers of documents. No tokenizer yields it.
DOCUMENT = ""


def word_counts(labelled: DataFrame, tokens: str = "tokens", *labels: str) -> DataFrame:
    """(labels, word, df, tf, marker) in one pass: per set of labels, written once.

    A document counts under its whole label array (``labels``, or several such columns), so that
    a token is one row whatever the number of its labels; ``by_label`` turns the few counts into
    those of each label of a column. ``marker`` tells the row that counts documents from those of words.
    A document's tokens are followed by its distinct ones, so that a row counts for the term frequency or, from
    there on, for the document frequency. Everything read from the counts reads the files, so no
    plan on top of them can run the corpus again.
    """
    labels = labels or ("labels",)
    none = F.array().cast("array<string>")
    # Empty or null tokens and labels: the document still counts.
    words = labelled.select(*[F.coalesce(c, none).alias(c) for c in labels],
                            F.concat(F.coalesce(tokens, none), F.array(F.lit(DOCUMENT))).alias("_w"))
    rows = words.select(*labels, F.size("_w").alias("_n"), F.posexplode_outer(F.concat("_w", F.array_distinct("_w"))).alias("_i", "word"))
    distinct = F.col("_i") >= F.col("_n")
    counts = rows.groupBy(*labels, "word").agg(F.count_if(distinct).alias("df"), F.count_if(~distinct).alias("tf"))
    return stored(counts.withColumn("marker", F.col("word") == DOCUMENT), "word-counts")


def by_label(counts: DataFrame, labels: str = "labels") -> DataFrame:
    """(label, word, df, tf, marker) of ``word_counts``; a label that a document has twice counts twice."""
    return explode_labels(counts, labels, "word", "df", "tf", "marker").groupBy("label", "word").agg(
        F.sum("df").alias("df"), F.sum("tf").alias("tf"), F.max("marker").alias("marker"))


def over_corpus(counts: DataFrame) -> DataFrame:
    """(word, df, marker) of ``word_counts`` over all documents."""
    return counts.groupBy("word").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"), F.max("marker").alias("marker"))


def rank_labelled(labelled: DataFrame | None, tokens: str = "tokens", labels: str = "labels", min_df: int = 5,
                  vocabulary: DataFrame | None = None, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A6 where the labelled documents are the whole corpus: (``rank_table``, (label, n_l)).

    One scan and one shuffle of the corpus: both results read the same written counts. With
    ``counts``, the corpus' ``word_counts`` by ``labels``, the corpus isn't read at all.
    """
    counts = word_counts(labelled, tokens, labels) if counts is None else counts
    n_docs = over_corpus(counts.where("marker")).select("tf").scalar()      # one row per set of labels
    sizes = docs_per_label(labelled, labels, counts)                        # one row per label
    words = counts.where(~F.col("marker"))
    # A word has at least as many documents as it has under a label.
    freq = over_corpus(words).where(F.col("df") >= min_df).select("word", F.col("df").alias("_df"))
    ls = by_label(words, labels).where(F.col("df") >= min_df)
    if vocabulary is not None:
        ls = ls.join(vocabulary.select("word").distinct(), "word", "left_semi")
    out = ls.join(freq, "word").join(sizes, "label").select(
        "label", "word", (F.col("df") / F.col("_df")).alias("reldocfreq"), F.log(n_docs / F.col("_df")).alias("idf"),
        F.tanh(F.col("tf") / F.col("n_l")).alias("rel_freq"))
    return out.withColumn("rank", F.col("reldocfreq") * F.col("idf") * F.col("rel_freq")), sizes


def word_bag(tokens) -> Column:
    """The distinct words of a token array with their counts, by word: array<struct<word, n>>, empty for null."""
    t = _c(tokens)
    s = F.sort_array(F.coalesce(t, F.array().cast("array<string>")))
    runs = F.transform(F.array(s), lambda a: F.struct(a.alias("s"), F.filter(
        F.transform(a, lambda w, i: F.when((i == 0) | (F.get(a, i - 1) != w), i)), lambda i: i.isNotNull()).alias("at")))
    return F.transform(runs, lambda r: F.transform(r["at"], lambda i, k: F.struct(
        F.get(r["s"], i).alias("word"), (F.coalesce(F.get(r["at"], k + 1), F.size(r["s"])) - i).alias("n"))))[0]


def bag_doc_freq(bags: DataFrame, bag: str) -> DataFrame:
    """A1 of ``word_bag`` rows: (word, df)."""
    return bags.select(F.explode_outer(F.col(bag)["word"]).alias("word")).where("word IS NOT NULL") \
        .groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def rank_bags(labelled: DataFrame, bag: str, freq: DataFrame, n_docs: int, labels: str = "labels",
              min_df: int = 5) -> tuple[DataFrame, DataFrame]:
    """``rank_labelled`` of ``word_bag`` rows, with the corpus' ``bag_doc_freq`` and number of documents given.

    A row per document, label and distinct word is counted; what doesn't depend on the labels isn't counted again.
    """
    marker = F.array(F.struct(F.lit(DOCUMENT).alias("word"), F.lit(1).alias("n")))
    rows = explode_labels(labelled, labels, F.concat(F.col(bag), marker).alias("_w"))
    rows = rows.select("label", F.explode_outer("_w").alias("x")).select("label", "x.*")
    stats = rows.groupBy("label", "word").agg(F.count(F.lit(1)).alias("df_l"), F.sum("n").alias("tf_l"),
                                              F.max(F.col("word") == DOCUMENT).alias("marker"))
    sizes = stats.groupBy("label").agg(F.max(F.when(F.col("marker"), F.col("df_l"))).alias("n_l"))
    j = stats.where(~F.col("marker") & (F.col("df_l") >= min_df)).join(freq, "word").join(sizes, "label")
    out = j.select("label", "word", (F.col("df_l") / F.col("df")).alias("reldocfreq"),
                   F.log(F.lit(n_docs) / F.col("df")).alias("idf"), F.tanh(F.col("tf_l") / F.col("n_l")).alias("rel_freq"))
    return out.withColumn("rank", F.col("reldocfreq") * F.col("idf") * F.col("rel_freq")), sizes


def subset_stats(corpus: DataFrame, subset: DataFrame | None = None, tokens: str = "tokens", group: str = "label",
                 top: int = 80, counts: DataFrame | None = None) -> DataFrame:
    """Rank of every word of each subset against the whole corpus, top ``top``.

    ``subset`` has a ``group`` column and a tokens column; threshold 0. Without it the
    groups are those of ``corpus`` itself, which is then read once, or not at all with its
    ``word_counts`` by the column ``group`` (one-element arrays) as ``counts``. All
    groups are ranked in one pass (window partitioned by group); ties go to
    the alphabetically first word.
    """
    if subset is None:
        grouped = corpus.select(F.array(F.col(group)).alias(group), tokens) if counts is None else None
        r, _ = rank_labelled(grouped, tokens, group, min_df=0, counts=counts)
    else:
        labelled = subset.select(F.array(F.col(group)).alias("labels"), tokens)
        r = rank_table(corpus, labelled, tokens, "labels", min_df=0)
    w = Window.partitionBy("label").orderBy(F.desc("rank"), F.asc("word"))
    return r.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= top).withColumnRenamed("label", group)


# ---------------------------------------------------------------------------
# Dictionary refinement
# ---------------------------------------------------------------------------
def disambiguate(seeds: DataFrame, ranks: DataFrame) -> DataFrame:
    """W4 / P14 (round 0): keep one sense per seed, the one with the highest rank.

    Seeds without a ``$k`` sense are kept as they are; a seed whose senses all
    lack a rank is dropped (the reference writes an empty string, Q6).
    """
    from seedweave.functions.text import sense_index, sense_word
    s = seeds.select("label", "word", sense_index("word").alias("sense"), sense_word("word").alias("prefix"))
    plain = s.where(F.col("sense").isNull()).select("label", "word")
    multi = s.where(F.col("sense").isNotNull()).join(ranks.select("label", "word", "rank"), ["label", "word"])
    w = Window.partitionBy("label", "prefix").orderBy(F.desc("rank"), F.asc("sense"))
    best = multi.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("label", "word")
    return plain.unionByName(best)


def expand(ranks: DataFrame, n_docs_label: DataFrame, old_seeds: DataFrame, iteration: int,
           words_per_round: int = 5, require_positive: bool = True) -> DataFrame:
    """W5 + W6 + U6 / P15: the new dictionary of round ``iteration`` > 0.

    Per label the top n = min(words_per_round * it, floor(log_1.5(docs of label)))
    words by rank; a word wanted by several labels goes to the highest rank
    (ties: first label). Labels without documents keep their old seeds.
    """
    n = F.least(F.lit(words_per_round * iteration),
                F.floor(F.log(F.col("n_l").cast("double")) / F.log(F.lit(1.5))).cast("int"))
    nl = n_docs_label.where(F.col("n_l") > 0).select("label", n.alias("top_n"))
    r = ranks.where(F.col("rank") > 0) if require_positive else ranks
    w = Window.partitionBy("label").orderBy(F.desc("rank"), F.asc("word"))
    # The literal bound lets Spark keep that many rows per label before it sorts a label's words.
    top = (r.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= words_per_round * iteration)
           .join(nl, "label").where(F.col("pos") <= F.col("top_n")))
    w2 = Window.partitionBy("word").orderBy(F.desc("rank"), F.asc("label"))
    chosen = top.withColumn("rn", F.row_number().over(w2)).where("rn = 1").select("label", "word")
    kept = old_seeds.select("label", "word").join(nl.select("label"), "label", "left_anti")
    return chosen.unionByName(kept)
