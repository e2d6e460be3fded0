"""Distributions, quality metrics and reports.

Metrics are conditional sums over a (doc, label) grid: one shuffle by label
with map-side partial aggregation; the per-label rows are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_distribution(pred: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents per label; labels without any document keep a 0 row."""
    counts = pred.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return labels.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def labels_per_doc_histogram(docs: DataFrame, pred: DataFrame, max_k: int = 4) -> DataFrame:
    """A10: how many documents have 0..max_k labels."""
    per_label = pred.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
    per_doc = docs.join(per_label, "doc_id", "left").select(F.coalesce("k", F.lit(0)).alias("k"))
    hist = per_doc.groupBy("k").agg(F.count(F.lit(1)).alias("n_docs"))
    buckets = docs.sparkSession.range(0, max_k + 1).select(F.col("id").alias("k"))
    return (buckets.join(hist, "k", "left")
            .select(F.col("k").cast("int").alias("n_labels"), F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs")))


def dictionary_sizes(dicts: DataFrame) -> DataFrame:
    """Words per (iteration, label), per iteration and overall (rollup)."""
    r = dicts.rollup("iteration", "label").agg(F.count(F.lit(1)).alias("n_words"))
    return r.select(F.coalesce(F.col("iteration").cast("int"), F.lit(-1)).alias("iteration"),
                    F.coalesce("label", F.lit("*")).alias("label"), "n_words")


def confusion(pred: DataFrame, truth: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Tp, fp, fn, support, precision, recall, f1 per label (multi-label).

    ``pred`` and ``truth`` are long (doc_id, label); ``docs`` the evaluated set.
    NULL where a ratio has a zero denominator.
    """
    p = pred.select("doc_id", "label", F.lit(1).alias("p")).distinct()
    t = truth.select("doc_id", "label", F.lit(1).alias("t")).distinct()
    d = docs.select("doc_id").distinct()
    pt = p.join(t, ["doc_id", "label"], "full_outer").join(d, "doc_id", "left_semi")
    agg = pt.groupBy("label").agg(
        F.sum(F.when((F.col("p") == 1) & (F.col("t") == 1), 1).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("p") == 1) & F.col("t").isNull(), 1).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("p").isNull() & (F.col("t") == 1), 1).otherwise(0)).alias("fn"))
    out = labels.join(agg, "label", "left").select(
        "label", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    out = out.withColumn("support", F.col("tp") + F.col("fn"))
    prec = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    rec = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    out = out.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", F.when(F.col("precision").isNotNull() & F.col("recall").isNotNull(),
                                       F.coalesce(f1, F.lit(0.0))))


AVERAGES = ("accuracy", "macro avg", "weighted avg")


def report(conf: DataFrame, accuracy: DataFrame | None = None) -> DataFrame:
    """Per-label rows plus macro and weighted averages, and with ``subset_accuracy`` rows an accuracy row."""
    per_label = conf.select("label", "precision", "recall", "f1", "support")
    filled = per_label.select("label", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")],
                              "support")
    tot = F.sum("support")
    macro = filled.agg(F.lit("macro avg").alias("label"),
                       F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                       F.avg("f1").alias("f1"), tot.alias("support"))
    weighted = filled.agg(F.lit("weighted avg").alias("label"),
                          F.try_divide(F.sum(F.col("precision") * F.col("support")), tot).alias("precision"),
                          F.try_divide(F.sum(F.col("recall") * F.col("support")), tot).alias("recall"),
                          F.try_divide(F.sum(F.col("f1") * F.col("support")), tot).alias("f1"),
                          tot.alias("support"))
    out = per_label.unionByName(macro).unionByName(weighted)
    if accuracy is None:
        return out
    a = F.col("subset_accuracy")
    return out.unionByName(accuracy.select(F.lit("accuracy").alias("label"), a.alias("precision"), a.alias("recall"),
                                           a.alias("f1"), F.col("n_docs").alias("support")))


def averages_per_round(history: DataFrame) -> DataFrame:
    """Accuracy, macro F1 and weighted F1 of every (run, iteration) of a report history."""
    value = lambda label: F.max(F.when(F.col("label") == label, F.col("f1")))
    return history.groupBy("run", "iteration").agg(value("accuracy").alias("accuracy"), value("macro avg").alias("macro_f1"),
                                                   value("weighted avg").alias("weighted_f1"))


def _labels_only(history: DataFrame, metric: str) -> DataFrame:
    rows = history.where(~F.col("label").isin(*AVERAGES))
    return rows.select("run", "iteration", "label", F.coalesce(metric, F.lit(0.0)).alias("value"))


def compare_runs(history: DataFrame, runs: list[str], metric: str = "f1") -> DataFrame:
    """(iteration, label, one column per run)."""
    rows = _labels_only(history, metric).where(F.col("run").isin(*runs))
    return rows.groupBy("iteration", "label").pivot("run", runs).agg(F.max("value"))


def metric_per_round(history: DataFrame, metric: str, rounds: int) -> DataFrame:
    """(label, round_0 .. , change_1 ..) of one run's history."""
    cols = [F.max(F.when(F.col("iteration") == i, F.col("value"))).alias(f"round_{i}") for i in range(rounds)]
    wide = _labels_only(history, metric).groupBy("label").agg(*cols)
    return wide.select("*", *[(F.col(f"round_{i}") - F.col(f"round_{i - 1}")).alias(f"change_{i}") for i in range(1, rounds)])


def threshold_sweep(scores: DataFrame, truth: DataFrame, true_col: str, labels: list[str], steps: int = 100) -> DataFrame:
    """(i, accuracy) of the share rule at thresholds i / steps, for documents with one true label.

    ``scores`` is (doc_id, label, score); missing pairs are 0. A document is right at
    a threshold if its true label reaches it and no other does, or if none does and
    the best (on ties the first) label is the true one. The sums over documents
    are taken per threshold in one aggregate: one row leaves each task.
    """
    m = scores.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "score"))).alias("m"))
    j = m.join(truth.select("doc_id", F.col(true_col).alias("t")), "doc_id")
    s = {l: F.coalesce(F.col("m")[l], F.lit(0.0)) for l in labels}
    best = F.lit(labels[-1])
    own, other = F.lit(None).cast("double"), F.lit(-1.0)
    for l in reversed(labels):
        own = F.when(F.col("t") == l, s[l]).otherwise(own)
        other = F.greatest(other, F.when(F.col("t") != l, s[l]).otherwise(F.lit(-1.0)))
    top = F.greatest(*s.values()) if len(labels) > 1 else s[labels[0]]
    for l in reversed(labels):
        best = F.when(s[l] == top, F.lit(l)).otherwise(best)
    j = j.select(own.alias("own"), other.alias("other"), (best == F.col("t")).alias("best"))

    def right(i):
        th = F.lit(i / float(steps))
        over = (F.col("own") >= th) & (F.col("other") < th)
        none = (F.coalesce("own", F.lit(-1.0)) < th) & (F.col("other") < th)
        return F.avg((F.coalesce(over, F.lit(False)) | (none & F.col("best"))).cast("int")).alias(f"a{i}")

    wide = j.agg(*[right(i) for i in range(steps)])
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"a{i}").alias("accuracy")) for i in range(steps)])
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def subset_accuracy(pred: DataFrame, truth: DataFrame, docs: DataFrame) -> DataFrame:
    """Share of documents whose whole predicted label set equals the true set."""
    def sets(df, name):
        return df.groupBy("doc_id").agg(F.array_sort(F.collect_set("label")).alias(name))
    d = docs.select("doc_id").distinct()
    j = d.join(sets(pred, "p"), "doc_id", "left").join(sets(truth, "t"), "doc_id", "left")
    empty = F.array().cast("array<string>")
    eq = (F.coalesce("p", empty) == F.coalesce("t", empty)).cast("int")
    return j.agg(F.avg(eq).alias("subset_accuracy"), F.count(F.lit(1)).alias("n_docs"))


def top_k_accuracy(scores: DataFrame, truth: DataFrame, ks=(1, 2, 3)) -> DataFrame:
    """Share of documents whose first true label is among the k best scores.

    ``scores``: (doc_id, label, score) long form; ties broken by label.
    """
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.asc("label"))
    ranked = scores.withColumn("rank", F.row_number().over(w))
    first_true = truth.groupBy("doc_id").agg(F.min("label").alias("label"))
    j = first_true.join(ranked.select("doc_id", "label", "rank"), ["doc_id", "label"], "left")
    return j.agg(*[F.avg(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))).alias(f"top{k}") for k in ks])


def added_removed_kept(before: DataFrame, after: DataFrame, keys=("label", "word")) -> DataFrame:
    """Words added, removed or kept between two dictionaries."""
    b = before.select(*keys, F.lit(1).alias("b")).distinct()
    a = after.select(*keys, F.lit(1).alias("a")).distinct()
    j = b.join(a, list(keys), "full_outer")
    status = F.when(F.col("a").isNull(), "removed").when(F.col("b").isNull(), "added").otherwise("kept")
    return j.select(*keys, status.alias("status"))
