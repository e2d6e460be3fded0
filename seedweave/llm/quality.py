"""Quality rules with risk-controlled thresholds.

Every rule compares a share (symbols, repeated lines, repeated words) with a
cutoff. The cutoffs of a stratum (language) are chosen together, on labelled
documents: a triple (one cutoff per rule, or none) is admissible if the exact
binomial test rejects "more than ``alpha`` of the good documents fail any of its
rules" at level ``delta / tests``, where ``tests`` counts every triple of every
stratum (Bonferroni). That is the Clopper-Pearson upper bound of the joint
rejection being at most ``alpha``. Of the admissible triples the one with the most
rejected bad less rejected good documents is taken, the mildest on ties; a triple
that gains nothing is not used. A stratum with too few labels certifies nothing
and loses no document to the method.

Everything is DataFrame functions; the words of a text stay inside its row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedweave.llm.shared import SPACE, WORD, written
from seedweave.operators.common import local_table

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

# Cutoffs tried for each rule, in percent: a document fails if its share is above.
GRID = {
    "symbols": (1, 2, 4, 6, 8, 10, 15, 20, 30),
    "lines": (5, 10, 20, 30, 40, 50, 60, 80),
    "repeats": (2, 4, 6, 8, 10, 12, 15, 18),
}
TRIPLES = math.prod(len(cuts) + 1 for cuts in GRID.values())      # a cutoff of every rule, or none
ALPHA = 0.02      # tolerated share of good documents that the rules together reject, per stratum
DELTA = 0.05      # probability that the promise is broken in any stratum
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _share(part: Column, whole: Column) -> Column:
    return 100.0 * part / F.greatest(whole, F.lit(1))


SHARES = {
    "symbols": ("n_symbols", "word_chars"),
    "lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the base measures and ``base_failed``; a null text has no words and no lines.

    Columns of ``df`` with the name of a measure are replaced; helper columns
    start with ``_q_``. Repeated words are found with 64-bit hashes of the
    five-word windows inside one text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    out = df.withColumn("_q_words", F.regexp_extract_all(t, F.lit(WORD), F.lit(0))).withColumn("_q_lines", lines)
    out = out.withColumns({
        "n_words": F.size("_q_words").cast("long"),
        "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_q_lines").cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "_q_hash": F.transform("_q_words", lambda w: F.xxhash64(w)),
    }).drop("_q_words", "_q_lines")
    no_longs = F.array().cast("array<bigint>")
    window = lambda i: F.xxhash64(*[F.get(F.col("_q_hash"), i + k) for k in range(WINDOW)])
    out = out.withColumn("_q_grams", F.when(F.size("_q_hash") >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size("_q_hash") - WINDOW), window)).otherwise(no_longs)).drop("_q_hash")
    # Only texts in which some window repeats are sorted: equal windows become neighbours.
    out = out.withColumn("_q_sorted", F.when(
        F.size(F.array_distinct("_q_grams")) < F.size("_q_grams"),
        F.sort_array(F.transform("_q_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    same = lambda x, j: (x["g"] == F.get(F.col("_q_sorted"), j)["g"])
    out = out.withColumn("_q_at", F.sort_array(F.filter(F.transform(
        "_q_sorted", lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"])), lambda i: i.isNotNull())))
    covered = F.aggregate(F.transform("_q_at", lambda p, k: F.least(
        F.lit(WINDOW), F.coalesce(F.get(F.col("_q_at"), k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                         | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return out.drop("_q_grams", "_q_sorted", "_q_at")


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed term by term in logarithms."""
    odds = math.log(p / (1 - p))
    start = F.struct((n * math.log1p(-p)).alias("t"), F.exp(n * math.log1p(-p)).alias("s"))

    def add(acc, j):
        t = acc["t"] + F.log((n - j + 1) / j) + F.lit(odds)
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, add)["s"]


def risk_controlled_cutoffs(measured: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang",
                            alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Rows (stratum, rule, cutoff) chosen on the labelled rows of ``measured``.

    The bound holds for the rules of a stratum together. Several labels of one key count as good only if all are 1; null labels and
    keys are ignored, as are documents that the base rules reject anyway. Output
    has at most strata x rules rows. Without labels it is empty.
    """
    spark = measured.sparkSession
    told = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()) \
        .groupBy(F.col(key).alias("_q_key")).agg(F.min("quality").alias("good"))
    rows = measured.where(~F.col("base_failed")).select(
        F.col(key).alias("_q_key"), F.coalesce(F.col(stratum), F.lit("")).alias("stratum"),
        *[_share(F.col(a), F.col(b)).alias(rule) for rule, (a, b) in SHARES.items()])
    rows = rows.join(told, "_q_key")
    # A rule's level is how many of its cutoffs the document fails; a triple keeps what is on or below its three places.
    levels = [f"level_{rule}" for rule in GRID]
    level = [sum((F.col(rule) > c).cast("int") for c in cuts).alias(f"level_{rule}") for rule, cuts in GRID.items()]
    cells = rows.select("stratum", "good", *level).groupBy("stratum", *levels).agg(
        *[F.count(F.when(F.col("good") == g, 1)).alias(name) for g, name in ((1, "good"), (0, "bad"))])
    cells = written(cells, "quality-counts")      # at most TRIPLES rows per stratum
    total = cells.groupBy("stratum").agg(F.sum("good").alias("n"), F.sum("bad").alias("n_bad"))
    tests = total.count() * TRIPLES
    if not tests:
        return local_table(spark, [], ["stratum", "rule", "cutoff"], ["string", "string", "double"])
    kept = cells
    for rule, cuts in GRID.items():
        kept = kept.withColumn(f"at_{rule}", F.explode(F.sequence(F.col(f"level_{rule}"), F.lit(len(cuts)))))
    places = [f"at_{rule}" for rule in GRID]
    lost = kept.groupBy("stratum", *places).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")) \
        .join(total, "stratum").withColumns({"good": F.col("n") - F.col("good"), "bad": F.col("n_bad") - F.col("bad")})
    lost = lost.where(F.col("bad") > F.col("good"))
    sound = lost.where((F.col("n") > 0) & (binomial_tail(F.col("n"), F.col("good"), alpha) <= delta / tests))
    best = F.max(F.struct((F.col("bad") - F.col("good")).alias("gain"), sum(F.col(p) for p in places).alias("mild"), *places))
    chosen = sound.groupBy("stratum").agg(best.alias("best"))
    # The place behind the last cutoff means that the rule is not used.
    cutoffs = [F.struct(F.lit(rule).alias("rule"), F.get(F.array(*[F.lit(float(c)) for c in cuts]), F.col(f"best.at_{rule}"))
                        .alias("cutoff")) for rule, cuts in GRID.items()]
    return chosen.select("stratum", F.explode(F.array(*cutoffs)).alias("x")).select("stratum", "x.*").where("cutoff IS NOT NULL")


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``measured`` with ``failed_rules`` (list) and ``kept``; a stratum without cutoffs fails none."""
    wide = cutoffs.groupBy(F.col("stratum").alias("_q_stratum")).pivot("rule", list(SHARES)).agg(F.first("cutoff"))
    wide = wide.select("_q_stratum", *[F.col(r).alias(f"_q_cut_{r}") for r in SHARES])
    # A row per stratum; Spark broadcasts it only if it is small.
    out = measured.join(wide, F.coalesce(F.col(stratum), F.lit("")) == F.col("_q_stratum"), "left")
    failed = F.filter(F.array(*[F.when(_share(F.col(a), F.col(b)) > F.col(f"_q_cut_{rule}"), F.lit(rule))
                                for rule, (a, b) in SHARES.items()]), lambda r: r.isNotNull())
    out = out.withColumn("failed_rules", failed)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return out.drop("_q_stratum", *[f"_q_cut_{r}" for r in SHARES])


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: the base measures, ``base_failed``, ``kept`` and the rules it failed."""
    measured = written(with_measures(docs.select("doc_id", "text", "lang")).drop("text"), "quality-measures")
    out = judge(measured, risk_controlled_cutoffs(measured, labels))
    return out.select("doc_id", *BASE, "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``.

    Texts and measures are written once to the shared folder, so that the cutoffs
    and the filter read them without measuring twice and no text is shuffled.
    """
    measured = written(with_measures(docs.withColumnsRenamed({c: f"_in_{c}" for c in docs.columns}).withColumns(
        {"doc_id": F.col("_in_doc_id"), "lang": F.col("_in_lang")}), "_in_text"), "quality-docs")
    out = judge(measured, risk_controlled_cutoffs(measured, labels)).where("kept")
    return out.select(*[F.col(f"_in_{c}").alias(c) for c in docs.columns])
