"""Seed matching and pseudo-label rules.

Plan shape for every rule (checked with ``explain``):

    scan(text) -> tokenize -> explode            (narrow, no shuffle)
      -> join to the seed table                  (broadcast by Spark while it is small)
      -> count per (doc, label)                  (one shuffle, map-side partial agg)
      -> window / aggregate per doc              (one shuffle of (doc, label) counts)

Only tokens that hit a seed leave the scan stage, so the shuffles carry a small
fraction of the corpus whatever its size. A document is a row, so no group can
grow past the number of labels of the dictionary.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedweave.functions.text import word_tokens

OCCURRENCES = "occurrences"
DISTINCT = "distinct"


def explode_tokens(docs: DataFrame, tokens, id_col: str = "doc_id", distinct: bool = False) -> DataFrame:
    """(doc_id, word) rows, one per token occurrence (or per distinct token)."""
    from seedweave.functions.text import explode_nonempty
    arr = F.array_distinct(tokens) if distinct else tokens
    return explode_nonempty(docs, arr, "word", F.col(id_col).alias("doc_id"))


def seed_hits(tokens: DataFrame, seeds: DataFrame) -> DataFrame:
    """J7 + P1: hits per (doc, label, word). ``seeds`` has (label, word)."""
    s = seeds.select("label", "word").distinct()
    return (tokens.join(s, "word")
            .groupBy("doc_id", "label", "word").agg(F.count(F.lit(1)).alias("n")))


def label_counts(tokens: DataFrame, seeds: DataFrame, *keys: str) -> DataFrame:
    """Hits per (doc, label); ``keys``: columns of ``seeds`` that tell several dictionaries apart."""
    s = seeds.select("label", "word", *keys).distinct()
    return (tokens.join(s, "word")
            .groupBy("doc_id", "label", *keys).agg(F.count(F.lit(1)).alias("n")))


def _with_doc_stats(counts: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id")
    rank_w = Window.partitionBy("doc_id").orderBy(F.desc("n"), F.asc("label"))
    return (counts
            .withColumn("total", F.sum("n").over(w))
            .withColumn("max_n", F.max("n").over(w))
            .withColumn("labels_hit", F.count(F.lit(1)).over(w))
            .withColumn("rank", F.row_number().over(rank_w)))


def share_rule(counts: DataFrame, n_dict_labels: int, threshold: float = 0.2,
               fallback: bool = True) -> DataFrame:
    """Labels whose share of the document's hits reaches ``threshold``.

    A dictionary of fewer than 3 labels keeps every label with a hit (Q1: the
    test is on the dictionary size). With ``fallback`` a document with no label
    over the threshold keeps its best label (ties: first label).
    """
    s = _with_doc_stats(counts)
    if n_dict_labels < 3:
        picked = F.col("n") > 0
    else:
        picked = F.try_divide(F.col("n"), F.col("total")) >= F.lit(threshold)
    s = s.withColumn("picked", picked)
    if fallback:
        any_w = Window.partitionBy("doc_id")
        s = s.withColumn("any_picked", F.max(F.col("picked").cast("int")).over(any_w))
        keep = F.col("picked") | ((F.col("any_picked") == 0) & (F.col("rank") == 1))
    else:
        keep = F.col("picked")
    return s.where(keep).select("doc_id", "label", "n", "total")


def relative_to_max_rule(counts: DataFrame, ratio: float = 0.5, top: int = 3) -> DataFrame:
    """One label hit -> keep it; else among the ``top`` best, count/max > ratio."""
    s = _with_doc_stats(counts)
    keep = (F.col("labels_hit") < 2) | ((F.col("rank") <= top) & (F.col("n") / F.col("max_n") > F.lit(ratio)))
    return s.where(keep).select("doc_id", "label", "n", "total")


def argmax_rule(counts: DataFrame) -> DataFrame:
    """P5: the single best label per document (ties: first label)."""
    s = _with_doc_stats(counts)
    return s.where(F.col("rank") == 1).select("doc_id", "label", "n", "total")


def pseudo_labels(docs: DataFrame, tokens, seeds: DataFrame, n_dict_labels: int,
                  rule: str = "share", threshold: float = 0.2, count: str = OCCURRENCES,
                  id_col: str = "doc_id") -> DataFrame:
    """P2-P6 entry point: (doc_id, label, n, total) for documents with a hit.

    ``tokens`` is a Column over ``docs`` (see ``seedweave.functions.text``);
    ``count`` chooses occurrence counting (training, Q2) or distinct tokens
    (production). ``rule`` is one of share / strict / relative / argmax.
    """
    toks = explode_tokens(docs, tokens, id_col, distinct=(count == DISTINCT))
    counts = label_counts(toks, seeds)
    if rule == "share":
        return share_rule(counts, n_dict_labels, threshold, fallback=True)
    if rule == "strict":
        return share_rule(counts, n_dict_labels, threshold, fallback=False)
    if rule == "relative":
        return relative_to_max_rule(counts, ratio=threshold)
    if rule == "argmax":
        return argmax_rule(counts)
    raise ValueError(f"unknown rule {rule!r}")


def production_labels(docs: DataFrame, text_col: str, seeds: DataFrame, n_dict_labels: int,
                      threshold: float = 0.2, id_col: str = "doc_id", max_n: int = 4,
                      tokenizer: Callable[[str], Column] = word_tokens) -> DataFrame:
    """Distinct n-grams 1..4 of the ``tokenizer``'s words, share rule; no match -> no label.

    Returns (doc_id, label) with a NULL label for documents without a hit
    (the reference's zero vector); documents without any token are dropped.
    """
    from seedweave.functions.text import ngrams_upto

    from seedweave.functions.text import WORD_RE
    # A document without any token is dropped; tested on the raw text where the tokenizer's pattern is
    # known, so that no filter on a derived array is pushed below (and re-runs) the tokenizer.
    has_tok = docs.where(F.col(text_col).rlike(WORD_RE) if tokenizer is word_tokens else F.size(tokenizer(text_col)) > 0)
    toks = has_tok.select(F.col(id_col).alias("doc_id"), tokenizer(text_col).alias("tok"))
    grams = toks.select("doc_id", F.array_distinct(ngrams_upto("tok", max_n)).alias("grams"))
    # Broadcast semi join before any shuffle: only n-grams that are seeds move.
    from seedweave.functions.text import explode_nonempty
    toks = explode_nonempty(grams, F.col("grams"), "word", "doc_id")
    counts = label_counts(toks, seeds)
    picked = share_rule(counts, n_dict_labels, threshold, fallback=True)
    return (grams.select("doc_id")
            .join(picked.select("doc_id", "label"), "doc_id", "left"))


def tag_matches(docs: DataFrame, text_col: str, synonyms: DataFrame, tag_ids: DataFrame,
                links: DataFrame, id_col: str = "doc_id", min_hits: int = 1, hops: int = 1,
                max_n: int = 4, tokenizer: Callable[[str], Column] = word_tokens) -> DataFrame:
    """Tags with >= ``min_hits`` synonym hits, plus linked tags, known ids only.

    ``synonyms``: (tag, word); ``tag_ids``: (tag, tag_id); ``links``:
    (src, dst) tag-id edges. Returns distinct (doc_id, tag_id).
    """
    from seedweave.functions.text import ngrams_upto

    toks = docs.select(F.col(id_col).alias("doc_id"), tokenizer(text_col).alias("tok"))
    from seedweave.functions.text import explode_nonempty
    grams = explode_nonempty(toks, F.array_distinct(ngrams_upto("tok", max_n)), "word", "doc_id")
    counts = label_counts(grams, synonyms.withColumnRenamed("tag", "label"))
    hit = (counts.where(F.col("n") >= min_hits)
           .join(tag_ids.withColumnRenamed("tag", "label"), "label")
           .select("doc_id", "tag_id"))
    from seedweave.operators.mapping import expand_links
    expanded = expand_links(hit, links, key="doc_id", node="tag_id", hops=hops)
    known = tag_ids.select("tag_id").distinct()
    return expanded.join(known, "tag_id", "left_semi").select("doc_id", "tag_id").distinct()


# ---------------------------------------------------------------------------
# In-row labelling for small dictionaries (no explode, no shuffle)
# ---------------------------------------------------------------------------
MAX_INROW_SEED_WORDS = 5_000


def joined_share_labels(df: DataFrame, tokens: str, seeds: DataFrame, id_col: str = "doc_id", threshold: float = 0.2,
                        out: str = "labels") -> DataFrame:
    """The result of ``inrow_share_labels`` for dictionaries of any size, by joins (ids are unique)."""
    n_labels = seeds.select("label").distinct().count()
    picked = pseudo_labels(df, F.col(tokens), seeds, n_labels, threshold=threshold, id_col=id_col)
    per_doc = picked.groupBy(F.col("doc_id").alias(id_col)).agg(F.array_sort(F.collect_set("label")).alias(out))
    none = F.array().cast("array<string>")
    return df.join(per_doc, id_col, "left").withColumn(out, F.coalesce(out, none))


def inrow_label_counts(tokens, seeds: dict) -> Column:
    """Hits per label (sorted label order) computed inside the row."""
    found = F.filter(tokens, lambda t: t.isin(sorted({w for ws in seeds.values() for w in ws})))

    def hits(found_words, words):
        arr = F.lit(sorted(set(words)))  # one constant, not an array built per token
        return F.size(F.filter(found_words, lambda t: F.array_contains(arr, t)))

    # One element, so that the few seeds found are computed once for all labels.
    return F.transform(F.array(found), lambda f: F.array(*[hits(f, seeds[label]) for label in sorted(seeds)]))[0]


def bag_label_counts(bag, seeds: dict) -> Column:
    """``inrow_label_counts`` of a ``rank.word_bag``: each distinct word is looked up once, in the set of all seeds."""
    words = sorted({w for ws in seeds.values() for w in ws})
    found = F.filter(bag, lambda b: b["word"].isin(words))

    def hits(found_words, mine):
        arr = F.lit(sorted(set(mine)))
        return F.aggregate(found_words, F.lit(0), lambda n, b: n + F.when(F.array_contains(arr, b["word"]), b["n"]).otherwise(0))

    # One element, so that the few words found are computed once for all labels.
    return F.transform(F.array(found), lambda f: F.array(*[hits(f, seeds[label]) for label in sorted(seeds)]))[0]


def inrow_share_labels(df: DataFrame, tokens: str, seeds: dict, threshold: float = 0.2,
                       out: str = "labels", count: Callable[[Column, dict], Column] = inrow_label_counts) -> DataFrame:
    """P2 inside the row: adds ``out``, the label array of each document (empty: no hit).

    Used by the refinement loop, where the dictionary is small and known on the
    driver: the whole labelling is one narrow stage, no explode and no shuffle.
    The counts are projected once, then read by the rule (no recomputation). ``count``
    makes them from ``tokens`` and the dictionary.
    """
    labels = sorted(seeds)
    if not labels:
        return df.withColumn(out, F.array().cast("array<string>"))
    lab = F.lit(labels)
    with_counts = df.withColumn("_cnt", count(F.col(tokens), seeds))
    with_counts = with_counts.withColumn("_tot", F.aggregate("_cnt", F.lit(0), lambda a, b: a + b))
    pairs = F.arrays_zip(lab.alias("l"), F.col("_cnt").alias("n"))
    if len(labels) < 3:
        picked = F.filter(pairs, lambda p: p["n"] > 0)
    else:
        picked = F.filter(pairs, lambda p: F.try_divide(p["n"], F.col("_tot")) >= F.lit(threshold))
    with_picked = with_counts.withColumn("_pick", F.transform(picked, lambda p: p["l"]))
    best = F.array(F.element_at(lab, F.array_position("_cnt", F.array_max("_cnt")).cast("int")))
    label_col = (F.when(F.col("_tot") == 0, F.array().cast("array<string>"))
                 .when(F.size("_pick") > 0, F.col("_pick")).otherwise(best))
    return with_picked.withColumn(out, label_col).drop("_cnt", "_tot", "_pick")
