"""Queries for quality metrics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from seedweave.functions.text import filter_tokens
from seedweave.operators import match
from seedweave.operators import metrics as mt
from seedweave.operators import rank as rk
from seedweave.operators.common import local_table, stored
from seedweave.operators.match import inrow_share_labels
from seedweave.plans.catalog_labels import _P2_SQL, _SHARES_SQL, _p2, _shares
from seedweave.plans.catalog_rank import SEEDS_U6, _P15_SQL, _corpus_sql, _round1, corpus, labelled
from seedweave.plans.fixtures import SEEDS, seeds_values_sql, sql_filter_tokens, sql_str
from seedweave.plans.registry import query
from seedweave.session import spread_table, table
from seedweave.sources.dictionaries import seeds_from_dict
from seedweave.sources.runs import new_history, read_runs, write_round

LABELS = sorted(SEEDS)
_LBL_SQL = "(SELECT unnest([" + ", ".join(sql_str(l) for l in LABELS) + "]) AS label)"
_CONF_SQL = f"""
{_P2_SQL},
t AS (SELECT doc_id, lang AS label FROM documents),
pt AS (SELECT coalesce(p.label, t.label) AS label, p.doc_id IS NOT NULL AS ip, t.doc_id IS NOT NULL AS it
       FROM p2 p FULL OUTER JOIN t ON p.doc_id = t.doc_id AND p.label = t.label),
agg AS (SELECT label, sum(CASE WHEN ip AND it THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN ip AND NOT it THEN 1 ELSE 0 END) AS fp,
               sum(CASE WHEN it AND NOT ip THEN 1 ELSE 0 END) AS fn FROM pt GROUP BY label),
c0 AS (SELECT l.label, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(fp, 0) AS BIGINT) AS fp,
              CAST(coalesce(fn, 0) AS BIGINT) AS fn FROM {_LBL_SQL} l LEFT JOIN agg USING (label)),
c1 AS (SELECT *, tp + fn AS support, CASE WHEN tp + fp = 0 THEN NULL ELSE tp / (tp + fp) END AS precision,
              CASE WHEN tp + fn = 0 THEN NULL ELSE tp / (tp + fn) END AS recall FROM c0),
conf AS (SELECT *, CASE WHEN precision IS NULL OR recall IS NULL THEN NULL WHEN precision + recall = 0 THEN 0.0
                   ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM c1)
"""


def _confusion(spark, sf):
    truth = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label"))
    labels = local_table(spark, [(l,) for l in LABELS], ["label"])
    return mt.confusion(_p2(spark, sf), truth, truth, labels)


def _r(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("a21_confusion", f"""
WITH {_CONF_SQL}
SELECT label, tp, fp, fn, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM conf
""")
def a21_confusion(spark, sf):
    return _r(_confusion(spark, sf), {"precision", "recall", "f1"})


@query("a22_report", f"""
WITH {_CONF_SQL},
ps AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS p FROM p2 GROUP BY doc_id),
exact AS (SELECT avg(CASE WHEN coalesce(ps.p, '') = d.lang THEN 1 ELSE 0 END) AS acc, count(*) AS n
          FROM documents d LEFT JOIN ps USING (doc_id)),
f AS (SELECT label, coalesce(precision, 0) AS p, coalesce(recall, 0) AS r, coalesce(f1, 0) AS f, support FROM conf),
rep AS (SELECT label, precision, recall, f1, support FROM conf
        UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM exact
        UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM f
        UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
                         sum(f * support) / sum(support), sum(support) FROM f)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM rep
""")
def a22_report(spark, sf):
    truth = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label"))
    r = mt.report(_confusion(spark, sf), mt.subset_accuracy(_p2(spark, sf), truth, truth))
    return _r(r.withColumn("support", F.col("support").cast("long")), {"precision", "recall", "f1"})


@query("a23_subset_accuracy", f"""
WITH {_P2_SQL},
ps AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS p FROM p2 GROUP BY doc_id)
SELECT round(avg(CASE WHEN coalesce(ps.p, '') = d.lang THEN 1 ELSE 0 END), 6) AS subset_accuracy, count(*) AS n_docs
FROM documents d LEFT JOIN ps USING (doc_id)
""")
def a23_subset_accuracy(spark, sf):
    truth = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label"))
    out = mt.subset_accuracy(_p2(spark, sf), truth, truth)
    return out.select(F.round("subset_accuracy", 6).alias("subset_accuracy"), "n_docs")


@query("a24_top_k_accuracy", f"""
WITH {_SHARES_SQL},
rk AS (SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, label) AS r FROM sh),
j AS (SELECT d.doc_id, rk.r FROM documents d LEFT JOIN rk ON rk.doc_id = d.doc_id AND rk.label = d.lang)
SELECT round(avg(CASE WHEN r <= 1 THEN 1 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN r <= 2 THEN 1 ELSE 0 END), 6) AS top2,
       round(avg(CASE WHEN r <= 3 THEN 1 ELSE 0 END), 6) AS top3 FROM j
""")
def a24_top_k_accuracy(spark, sf):
    truth = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label"))
    out = mt.top_k_accuracy(_shares(spark, sf).withColumnRenamed("share", "score"), truth)
    return out.select(*[F.round(c, 6).alias(c) for c in ("top1", "top2", "top3")])


@query("a25_threshold_sweep", f"""
WITH {_SHARES_SQL},
docs AS (SELECT DISTINCT doc_id FROM sh),
grid AS (SELECT d.doc_id, l.label, coalesce(sh.share, 0.0) AS share FROM docs d CROSS JOIN {_LBL_SQL} l
         LEFT JOIN sh ON sh.doc_id = d.doc_id AND sh.label = l.label),
th AS (SELECT unnest(range(0, 100)) AS i),
g2 AS (SELECT th.i, grid.*, grid.share >= th.i / 100.0 AS pk,
              row_number() OVER (PARTITION BY th.i, grid.doc_id ORDER BY grid.share DESC, grid.label) AS rk
       FROM grid CROSS JOIN th),
g3 AS (SELECT *, max(CAST(pk AS INT)) OVER (PARTITION BY i, doc_id) AS anyp FROM g2),
sel AS (SELECT i, doc_id, string_agg(label, ',' ORDER BY label) AS p FROM g3 WHERE pk OR (anyp = 0 AND rk = 1) GROUP BY i, doc_id)
SELECT CAST(sel.i AS INT) AS i, round(avg(CASE WHEN sel.p = d.lang THEN 1 ELSE 0 END), 6) AS accuracy
FROM sel JOIN documents d USING (doc_id) GROUP BY sel.i
""")
def a25_threshold_sweep(spark, sf):
    """Subset accuracy of the share rule for thresholds 0.00..0.99 on the dense
    (document, label) grid (at 0.00 every label qualifies, Q22)."""
    truth = table(spark, sf, "documents").select("doc_id", "lang")
    sweep = mt.threshold_sweep(_shares(spark, sf).withColumnRenamed("share", "score"), truth, "lang", LABELS)
    return sweep.select("i", F.round("accuracy", 6).alias("accuracy"))


_LBL_U6_SQL = "(SELECT unnest([" + ", ".join(sql_str(l) for l in sorted(SEEDS_U6)) + "]) AS label)"


@query("a27_label_audit", f"""
WITH {_P2_SQL.replace(seeds_values_sql(SEEDS), seeds_values_sql(SEEDS_U6))},
np AS (SELECT label, count(*) AS n FROM p2 GROUP BY label),
nt AS (SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang)
SELECT l.label, CAST(coalesce(np.n, 0) AS BIGINT) AS n_pred, CAST(coalesce(nt.n, 0) AS BIGINT) AS n_true,
       coalesce(np.n, 0) = 0 AS never_predicted, coalesce(nt.n, 0) = 0 AS no_true_rows
FROM {_LBL_U6_SQL} l LEFT JOIN np USING (label) LEFT JOIN nt USING (label)
""")
def a27_label_audit(spark, sf):
    """Labels never predicted and labels without true rows (dense label grid)."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    pred = match.pseudo_labels(docs, filter_tokens("text"), seeds_from_dict(spark, SEEDS_U6), len(SEEDS_U6))
    np_ = pred.groupBy("label").agg(F.count(F.lit(1)).alias("n_pred"))
    nt = docs.groupBy(F.col("lang").alias("label")).agg(F.count(F.lit(1)).alias("n_true"))
    labels = local_table(spark, [(l,) for l in sorted(SEEDS_U6)], ["label"])
    j = labels.join(np_, "label", "left").join(nt, "label", "left")
    return j.select("label", F.coalesce("n_pred", F.lit(0)).cast("long").alias("n_pred"),
                    F.coalesce("n_true", F.lit(0)).cast("long").alias("n_true"),
                    (F.coalesce("n_pred", F.lit(0)) == 0).alias("never_predicted"),
                    (F.coalesce("n_true", F.lit(0)) == 0).alias("no_true_rows"))


@query("n1_dictionary_report", f"""
WITH {_corpus_sql()}
SELECT s.label, s.word, round(rt.rank, 6) AS rank, round(rt.idf, 6) AS idf, round(rt.reldocfreq, 6) AS reldocfreq,
       round(rt.rel_freq, 6) AS rel_freq FROM seeds s LEFT JOIN rt USING (label, word)
""")
def n1_dictionary_report(spark, sf):
    """Each seed word with its four rank components (NULL when it has none)."""
    r, _ = rk.rank_labelled(labelled(corpus(spark, sf)), min_df=5)
    s = seeds_from_dict(spark, SEEDS).select("label", "word")
    j = s.join(r, ["label", "word"], "left")
    return _r(j.select("label", "word", "rank", "idf", "reldocfreq", "rel_freq"), {"rank", "idf", "reldocfreq", "rel_freq"})


@query("n3_best_dictionary_coverage", f"""
WITH {_P15_SQL},
c2 AS (SELECT doc_id, lang, tokens FROM ct),
sub AS (SELECT lang AS label, tokens FROM c2),
dfl2 AS (SELECT label, word, count(*) AS df_l FROM (SELECT label, unnest(list_distinct(tokens)) AS word FROM sub) GROUP BY ALL),
tfl2 AS (SELECT label, word, count(*) AS tf_l FROM (SELECT label, unnest(tokens) AS word FROM sub) GROUP BY ALL),
nl2 AS (SELECT label, count(*) AS n_l FROM sub GROUP BY label),
rt2 AS (SELECT label, word, df_l / df * ln((SELECT n FROM nd) / df) * tanh(tf_l / n_l) AS rank
        FROM dfl2 JOIN tfl2 USING (label, word) JOIN dfw USING (word) JOIN nl2 USING (label)),
best AS (SELECT label, word FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY rank DESC, word) AS pos FROM rt2)
         WHERE pos <= 80)
SELECT b.label, round(avg(CASE WHEN n.word IS NULL THEN 0 ELSE 1 END), 6) AS coverage
FROM best b LEFT JOIN newd n ON n.label = b.label AND n.word = b.word GROUP BY b.label
""")
def n3_best_dictionary_coverage(spark, sf):
    """Share of each label's 80 best words (by true label) found in the round-1 dictionary."""
    c = corpus(spark, sf)
    # One pass counts the words by pseudo-labels and by true label; both rankings read its files.
    lab = inrow_share_labels(c, "ftok", SEEDS_U6).select("tokens", "labels", F.array("lang").alias("lang"))
    counts = rk.word_counts(lab, "tokens", "labels", "lang")
    best = rk.subset_stats(c, group="lang", top=80, counts=counts).select(F.col("lang").alias("label"), "word")
    last = _round1(spark, sf, counts).select("label", "word", F.lit(1).alias("hit"))
    j = best.join(last, ["label", "word"], "left")
    return j.groupBy("label").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("coverage"))


@query("n6_unmatched_seeds", f"""
WITH {_corpus_sql(SEEDS_U6)},
v AS (SELECT DISTINCT unnest({sql_filter_tokens('text')}) AS word FROM documents)
SELECT s.label, s.word, CASE WHEN s.word NOT IN (SELECT word FROM v) THEN 'not in corpus'
         WHEN s.label NOT IN (SELECT label FROM nl) THEN 'label without documents' ELSE 'below the document frequency' END AS reason
FROM seeds s LEFT JOIN rt USING (label, word) WHERE rt.rank IS NULL
""")
def n6_unmatched_seeds(spark, sf):
    """Seeds without a rank, with the reason."""
    d = spread_table(spark, sf, "documents", "doc_id", "text")
    s = seeds_from_dict(spark, SEEDS_U6).select("label", "word")
    # Only the words of the dictionary are looked for: no other leaves the scan.
    v = match.explode_tokens(d, filter_tokens("text")).join(s.select("word").distinct(), "word", "left_semi")
    v = v.select("word").distinct().withColumn("seen", F.lit(True))
    ranks, sizes = rk.rank_labelled(labelled(corpus(spark, sf), SEEDS_U6), min_df=5)
    j = s.join(ranks.select("label", "word"), ["label", "word"], "left_anti").join(v, "word", "left").join(sizes, "label", "left")
    reason = F.when(F.col("seen").isNull(), "not in corpus").when(F.col("n_l").isNull(), "label without documents") \
        .otherwise("below the document frequency")
    return j.select("label", "word", reason.alias("reason"))


@query("n6_dropped_rows", """
SELECT CASE WHEN text IS NULL OR trim(text) = '' THEN 'no text' WHEN length(text) <= 20 THEN 'too short'
            WHEN lang <> 'en' THEN 'other language' END AS reason, count(*) AS n
FROM documents GROUP BY 1 HAVING reason IS NOT NULL
""")
def n6_dropped_rows(spark, sf):
    """Rows that corpus preparation drops, counted by reason."""
    reason = F.when(F.col("text").isNull() | (F.trim("text") == ""), "no text").when(F.length("text") <= 20, "too short") \
        .when(F.col("lang") != "en", "other language")
    d = table(spark, sf, "documents").select(reason.alias("reason")).where("reason IS NOT NULL")
    return d.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# --- runs and rounds -----------------------------------------------------------
# Two runs (thresholds) of two rounds (the seeds, then the round-1 dictionary).
RUNS = {"share20": 0.2, "share40": 0.4}


def _history_sql() -> str:
    out = f"""WITH {_P15_SQL},
base_tok AS (SELECT doc_id, unnest({sql_filter_tokens('text')}) AS word FROM documents),
dicts AS (SELECT 0 AS iteration, label, word FROM (SELECT DISTINCT label, word FROM seeds)
          UNION ALL SELECT 1, label, word FROM newd),
h_cnt AS (SELECT iteration, doc_id, label, count(*) AS n FROM base_tok JOIN dicts USING (word) GROUP BY ALL),
h_st AS (SELECT *, n / sum(n) OVER (PARTITION BY iteration, doc_id) AS share,
                row_number() OVER (PARTITION BY iteration, doc_id ORDER BY n DESC, label) AS rk FROM h_cnt),
runs AS (SELECT * FROM (VALUES {", ".join(f"('{r}', {t})" for r, t in RUNS.items())}) AS r(run, th)),
h_fin AS (SELECT run, h_st.*, share >= th AS pk, max(CAST(share >= th AS INT)) OVER (PARTITION BY run, iteration, doc_id) AS anyp
          FROM h_st, runs),
pred AS (SELECT run, iteration, doc_id, label FROM h_fin WHERE pk OR (anyp = 0 AND rk = 1)),
keys AS (SELECT run, iteration FROM runs, (SELECT unnest([0, 1]) AS iteration)),
truth AS (SELECT run, iteration, doc_id, lang AS label FROM documents, keys),
pt AS (SELECT coalesce(p.run, t.run) AS run, coalesce(p.iteration, t.iteration) AS iteration, coalesce(p.label, t.label) AS label,
              p.doc_id IS NOT NULL AS ip, t.doc_id IS NOT NULL AS it
       FROM pred p FULL OUTER JOIN truth t ON p.run = t.run AND p.iteration = t.iteration AND p.doc_id = t.doc_id AND p.label = t.label),
agg AS (SELECT run, iteration, label, sum(CAST(ip AND it AS INT)) AS tp, sum(CAST(ip AND NOT it AS INT)) AS fp,
               sum(CAST(it AND NOT ip AS INT)) AS fn FROM pt GROUP BY ALL),
per_label AS (SELECT run, iteration, label, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
               CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall, tp + fn AS support FROM agg
               WHERE label IN ({", ".join(sql_str(l) for l in LABELS)})),
hist AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM per_label),
sets AS (SELECT run, iteration, doc_id, string_agg(label, ',' ORDER BY label) AS p FROM pred GROUP BY ALL),
acc AS (SELECT k.run, k.iteration, avg(CASE WHEN coalesce(s.p, '') = d.lang THEN 1 ELSE 0 END) AS accuracy
        FROM documents d CROSS JOIN keys k LEFT JOIN sets s ON s.run = k.run AND s.iteration = k.iteration AND s.doc_id = d.doc_id
        GROUP BY ALL)"""
    return out


def _history(spark, sf):
    """The runs' reports, written by run and round and read back."""
    docs = spread_table(spark, sf, "documents", "doc_id", "text")
    truth = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label"))
    labels = local_table(spark, [(l,) for l in LABELS], ["label"])
    path = new_history(spark)
    seeds = seeds_from_dict(spark, SEEDS_U6).select("label", "word")
    # Both dictionaries are matched in one pass; the second is read from a file, whose size Spark knows.
    dicts = [d.withColumn("iteration", F.lit(it)) for it, d in enumerate((seeds, stored(_round1(spark, sf), "dictionary")))]
    tokens = match.explode_tokens(docs, filter_tokens("text"))
    hits = stored(match.label_counts(tokens, dicts[0].unionByName(dicts[1]), "iteration"), "label-counts")
    for it in range(len(dicts)):
        counts = hits.where(F.col("iteration") == it).drop("iteration")
        for run, threshold in RUNS.items():
            pred = match.share_rule(counts, len(SEEDS_U6), threshold)
            conf = mt.confusion(pred, truth, truth, labels)
            write_round(mt.report(conf, mt.subset_accuracy(pred, truth, truth)), path, run, it)
    return read_runs(spark, path)


@query("n4_averages_per_round", f"""
{_history_sql()}
SELECT run, iteration, round(any_value(accuracy), 6) AS accuracy, round(avg(f1), 6) AS macro_f1,
       round(sum(f1 * support) / sum(support), 6) AS weighted_f1
FROM hist JOIN acc USING (run, iteration) GROUP BY run, iteration
""")
def n4_averages_per_round(spark, sf):
    """N4 + S9: accuracy, macro and weighted F1 of every round of every run."""
    return _r(mt.averages_per_round(_history(spark, sf)), {"accuracy", "macro_f1", "weighted_f1"})


@query("n5_compare_runs", f"""
{_history_sql()}
SELECT iteration, label, round(max(CASE WHEN run = 'share20' THEN f1 END), 6) AS share20,
       round(max(CASE WHEN run = 'share40' THEN f1 END), 6) AS share40 FROM hist GROUP BY iteration, label
""")
def n5_compare_runs(spark, sf):
    """A label's F1 in the runs named, side by side."""
    return _r(mt.compare_runs(_history(spark, sf), list(RUNS), "f1"), set(RUNS))


@query("w11_metric_per_round", f"""
{_history_sql()}
SELECT label, round(max(CASE WHEN iteration = 0 THEN recall END), 6) AS round_0,
       round(max(CASE WHEN iteration = 1 THEN recall END), 6) AS round_1,
       round(max(CASE WHEN iteration = 1 THEN recall END) - max(CASE WHEN iteration = 0 THEN recall END), 6) AS change_1
FROM hist WHERE run = 'share20' GROUP BY label
""")
def w11_metric_per_round(spark, sf):
    """A metric per label across the rounds of a run, pivoted, with the change from round to round."""
    hist = _history(spark, sf).where("run = 'share20'")
    return _r(mt.metric_per_round(hist, "recall", 2), {"round_0", "round_1", "change_1"})
