"""Voting over weak predictors and the company classification job
(U1, A16, A17, U4, P8, P10, S16).

The per-company loop of the reference becomes one job: every text of every
company is labelled at once, votes are summed per (company, label) with one
shuffle, and the adaptive pick is a window over each company's label row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedweave.functions.labels import decode_prefixed, labels_array
from seedweave.functions.text import description_clean
from seedweave.operators import match
from seedweave.operators.windows import latest_per_key, priority_rank


def vote_sum(votes: DataFrame, key: str) -> DataFrame:
    """(key, label, votes) = weighted sum over all predictors."""
    return votes.groupBy(key, "label").agg(F.sum("weight").cast("long").alias("votes"))


def dense_votes(sums: DataFrame, clients: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """The full (client, label) grid with 0 where no predictor voted."""
    grid = clients.select(key).distinct().select(key, F.explode(labels_array(labels)).alias("label"))
    return grid.join(sums, [key, "label"], "left").select(key, "label", F.coalesce("votes", F.lit(0)).cast("long").alias("votes"))


def adaptive_pick(dense: DataFrame, key: str) -> DataFrame:
    """Labels whose votes exceed the company's mean over all labels + 1."""
    w = Window.partitionBy(key)
    return (dense.withColumn("mean", F.avg("votes").over(w))
            .where(F.col("votes") > F.col("mean") + 1).select(key, "label", "votes"))


def company_texts(texts: DataFrame, key: str, source: str, date: str, text: str,
                  priority: list[str]) -> DataFrame:
    """W1 + T1 + X2: latest text per (company, source), priority rank, cleaned.

    Sources outside the priority list come last and are told apart by their name:
    (``prio``, source) is a total order of a company's texts. Of texts with equal
    dates the alphabetically first counts.
    """
    latest = latest_per_key(texts.select(key, source, date, text), [key, source], date, tie=[text])
    return latest.select(key, priority_rank(source, priority).alias("prio"), source,
                         description_clean(text).alias("clean"))


def without_duplicates(ct: DataFrame, key: str, source: str, rule: str | None) -> DataFrame:
    """P9 on a company's texts: ``indel`` (ratio over 80.5), ``levenshtein`` (similarity over 0.8), ``exact`` or None."""
    from seedweave.operators import dedup

    drop = {"indel": dedup.drop_near_duplicates, "levenshtein": dedup.drop_levenshtein_duplicates,
            "exact": dedup.drop_exact_duplicates}
    return ct if rule is None else drop[rule](ct, key, ["prio", source], "clean")


def text_votes(ct: DataFrame, key: str, source: str, seeds: DataFrame, n_labels: int, predtype: str,
               weight: int = 1) -> DataFrame:
    """Pseudo-label votes (P6) of every text: (key, predtype, label, weight)."""
    docs = ct.select(F.struct(key, source).alias("doc_id"), "clean")
    picked = match.production_labels(docs, "clean", seeds, n_labels).where(F.col("label").isNotNull())
    return picked.select(F.col("doc_id")[key].alias(key), F.lit(predtype).alias("predtype"), "label",
                         F.lit(weight).alias("weight"))


def model_votes(predictions: DataFrame, key: str, names: str, confidences: str, labels: list[str], predtype: str,
                threshold: float = 0.5, weight: int = 1) -> DataFrame:
    """Votes of an external model: per text the lists of ``__label__`` names and confidences."""
    hot = decode_prefixed(names, confidences, labels, threshold)
    at = F.arrays_zip(labels_array(labels).alias("label"), hot.alias("hot"))
    rows = predictions.select(key, F.explode_outer(at).alias("x")).where("x.hot = 1")
    return rows.select(key, F.lit(predtype).alias("predtype"), F.col("x.label").alias("label"), F.lit(weight).alias("weight"))


def external_vertical_votes(external: DataFrame, key: str, labels: list[str], weight: int = 5) -> DataFrame:
    """Votes of an external source (one per company and label): (key, predtype, label, weight)."""
    known = external.select(key, "label").where(F.col("label").isin(labels)).distinct()
    return known.select(key, F.lit("ext").alias("predtype"), "label", F.lit(weight).alias("weight"))


def classify_companies(descriptions: DataFrame, pitches: DataFrame, seeds: DataFrame, labels: list[str], key: str,
                       source: str, predictions: list[DataFrame] = (), external: DataFrame | None = None,
                       duplicates: str | None = "indel") -> tuple[DataFrame, DataFrame, DataFrame]:
    """P10 vertical part: (votes by predictor, votes per company and label, picked labels).

    ``descriptions`` and ``pitches`` are ``company_texts``; near-duplicates are
    dropped among the descriptions of a company only. ``predictions`` are vote
    tables of further models, ``external`` has (key, label). Companies without any
    text of the two kinds are not classified.
    """
    votes = text_votes(without_duplicates(descriptions, key, source, duplicates), key, source, seeds, len(labels), "pseudo_descr")
    votes = votes.unionByName(text_votes(pitches, key, source, seeds, len(labels), "pseudo_pitch"))
    for p in predictions:
        votes = votes.unionByName(p)
    if external is not None:
        votes = votes.unionByName(external_vertical_votes(external, key, labels))
    clients = descriptions.select(key).unionByName(pitches.select(key)).distinct()
    votes = votes.join(clients, key, "left_semi")
    dense = dense_votes(vote_sum(votes, key), clients, key, labels)
    return votes, dense, adaptive_pick(dense, key)


def append_rows(rows: DataFrame, path: str, batch: str) -> None:
    """Append a batch's classified rows; running the batch again replaces its rows, so nothing is written twice."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def vertical_rows(picked: DataFrame, clients: DataFrame, key: str, labels: list[str],
                  acq_date: str) -> DataFrame:
    """One row per (company, vertical id); a NULL id when nothing was picked."""
    idx = F.array_position(labels_array(labels), F.col("label")).cast("int") - 1
    ids = picked.select(key, idx.alias("vertical_id"))
    out = clients.select(key).distinct().join(ids, key, "left")
    return out.select(F.col(key).alias("client_id"), "vertical_id",
                      F.lit(acq_date).cast("timestamp").alias("acq_date"))


def whole_texts(texts: list[DataFrame], key: str, source: str) -> DataFrame:
    """All cleaned texts of a company, kind after kind, each in priority order."""
    all_ = None
    for i, ct in enumerate(texts):
        t = ct.select(key, F.struct(F.lit(i).alias("kind"), "prio", F.col(source).alias("source"), F.col("clean").alias("text")).alias("x"))
        all_ = t if all_ is None else all_.unionByName(t)
    agg = all_.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("items"))
    return agg.select(key, F.array_join(F.transform("items", lambda x: x["text"]), " ").alias("whole_text"))


def tag_rows(texts: list[DataFrame], key: str, source: str, synonyms: DataFrame, tag_ids: DataFrame, links: DataFrame,
             external: DataFrame | None, acq_date: str) -> DataFrame:
    """P7 on the whole text + external tags (key, tag_id), distinct (U4); NULL tag when none."""
    wt = whole_texts(texts, key, source)
    tags = match.tag_matches(wt.withColumnRenamed(key, "doc_id"), "whole_text", synonyms, tag_ids, links)
    tags = tags.select(F.col("doc_id").alias(key), "tag_id")
    if external is not None:
        tags = tags.unionByName(external.select(key, "tag_id"))
    out = wt.select(key).join(tags.distinct(), key, "left")
    return out.select(F.col(key).alias("client_id"), "tag_id", F.lit(acq_date).cast("timestamp").alias("acq_date"))
