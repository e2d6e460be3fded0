"""Keyword graphs and TextRank (W7, K13, K14, T3), all documents at once.

Every document's word graph lives in one edge table keyed by document; one
TextRank step is a join of edges to the current weights, a sum per (document,
node) and a window per document for the stop test. Edges and each step's weights
are checkpointed in the shared folder; the loop ends when no document is active.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedweave.functions.text import ENGLISH_STOP_WORDS, EXTRA_STOP_WORDS, explode_nonempty, sentences, word_tokens
from seedweave.operators.common import cut_lineage


def candidate_words(docs: DataFrame, doc: str, text: str, stop_words=None, min_len: int = 3) -> DataFrame:
    """(doc, sent, pos, word) of candidate words: not a stop word, length >= min_len.

    Positions count candidates only, so windows run over the selected words as
    in the reference (which windows over its part-of-speech selection).
    """
    stop = F.lit(sorted(set(stop_words if stop_words is not None else ENGLISH_STOP_WORDS + EXTRA_STOP_WORDS)))
    s = explode_nonempty(docs, sentences(text), "sentence", F.col(doc).alias("doc"), with_pos="sent")
    toks = s.select("doc", "sent", F.filter(word_tokens("sentence"),
                                            lambda w: (~F.array_contains(stop, w)) & (F.length(w) >= min_len)).alias("w"))
    return explode_nonempty(toks, F.col("w"), "word", "doc", "sent", with_pos="pos")


def window_pairs(words: DataFrame, window: int = 4) -> DataFrame:
    """Distinct directed pairs (word, next word) within ``window`` words of a sentence."""
    w = Window.partitionBy("doc", "sent").orderBy("pos")
    nxt = [F.lead("word", k).over(w) for k in range(1, window)]
    pairs = words.select("doc", F.col("word").alias("src"), F.array(*nxt).alias("nx"))
    return explode_nonempty(pairs, F.col("nx"), "dst", "doc", "src").distinct()


def graph_edges(pairs: DataFrame) -> DataFrame:
    """Symmetrised, column-normalised weights: (doc, src, dst, w).

    A pair seen in both directions weighs 2, one direction 1, a self loop 1;
    each column (dst) is divided by its sum.
    """
    both = pairs.select("doc", "src", "dst").unionByName(
        pairs.where(F.col("src") != F.col("dst")).select("doc", F.col("dst").alias("src"), F.col("src").alias("dst")))
    g = both.groupBy("doc", "src", "dst").agg(F.count(F.lit(1)).cast("double").alias("g"))
    col = Window.partitionBy("doc", "dst")
    return g.select("doc", "src", "dst", (F.col("g") / F.sum("g").over(col)).alias("w"))


def textrank(words: DataFrame, window: int = 4, damping: float = 0.85, steps: int = 10,
             min_diff: float = 1e-5, stop: str = "sum") -> DataFrame:
    """(doc, word, weight) after at most ``steps`` updates.

    ``stop="sum"`` replays the reference test (|change of the weight sum| <
    min_diff, previous sum starting at 0); ``stop="l1"`` tests the L1 change of
    the weights; ``stop="fixed"`` runs exactly ``steps`` updates. Nodes without
    edges get 1 - damping after the first update.
    """
    edges = cut_lineage(graph_edges(window_pairs(words, window)))
    doc = Window.partitionBy("doc")
    pr = words.select("doc", "word").distinct().select(
        "doc", "word", F.lit(1.0).alias("pr"), F.lit(0.0).alias("prev"), F.lit(True).alias("active"))
    for _ in range(steps):
        # Only documents that still change are worked on; the others keep their rows.
        weights = pr.where("active").select("doc", F.col("word").alias("dst"), "pr")
        contrib = (edges.join(weights, ["doc", "dst"]).groupBy("doc", "src").agg(F.sum(F.col("w") * F.col("pr")).alias("c"))
                   .withColumnRenamed("src", "word"))
        new = F.lit(1 - damping) + F.lit(damping) * F.coalesce("c", F.lit(0.0))
        upd = pr.join(contrib, ["doc", "word"], "left").withColumn("new", F.when(F.col("active"), new).otherwise(F.col("pr")))
        total = F.sum("new").over(doc)
        change = {"sum": F.abs(F.col("prev") - total), "l1": F.sum(F.abs(F.col("new") - F.col("pr"))).over(doc)}.get(stop)
        still = F.col("active") if change is None else F.col("active") & (change >= min_diff)
        pr = cut_lineage(upd.select("doc", "word", F.col("new").alias("pr"), total.alias("prev"), still.alias("active")))
        if stop != "fixed" and pr.where("active").isEmpty():
            break
    return pr.select("doc", "word", F.col("pr").alias("weight"))


def top_keywords(ranks: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best words per document (ties: alphabetical)."""
    w = Window.partitionBy("doc").orderBy(F.desc("weight"), F.asc("word"))
    return ranks.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
