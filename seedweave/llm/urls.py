"""URL filter: rules by host and path, and a character language-model ratio for the rest.

Two smoothed variable-order Markov models (contexts of 3, 2, 1 and 0 characters,
each falling back on the next shorter one) are counted over URLs that the rules
allow and over URLs that they block. A URL without a rule is judged by the
log-likelihood difference per character; the cutoff has the best balanced accuracy
on hosts that were left out of the counts, and of equally good ones is nearest to 0.

Characters are mapped to ``ALPHABET`` (33 signs), so a table over all four-character
grams has at most 33**4 = 1,185,921 rows whatever the input: it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedweave.llm.shared import written

ORDER = 4
ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.-_^$"      # ^ start, $ end, 0 any digit, _ anything else
TAU = 4.0                                            # weight of the shorter context
SCALE = 1_000_000                                    # log ratios are added as whole millionths
BINS = 400                                           # calibration histogram: +-BINS steps
STEP = 20_000                                        # of so many millionths per character
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# (host, path, verdict): fits the host, its subdomains and every path that starts so.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):     # the longest is tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def signs(host: Column, path: Column) -> Column:
    """The URL in the model's alphabet, padded with starts and one end."""
    s = F.translate(F.concat(host, path), UPPER, LOWER)
    s = F.regexp_replace(F.regexp_replace(s, "[0-9]", "0"), "[^a-z0/.-]", "_")
    return F.concat(F.lit("^" * (ORDER - 1)), s, F.lit("$"))


def _grams(df: DataFrame, *keep: str) -> DataFrame:
    """One row per character: the gram that ends with it."""
    n = F.length("signs") - ORDER
    grams = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring("signs", i + 1, F.lit(ORDER)))
    return df.select(*keep, F.explode(grams).alias("gram"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio): ln p(accepted) - ln p(rejected) of the last sign, in whole millionths.

    ``counts`` has gram, acc, rej for every gram seen anywhere; shorter contexts
    are sums over it. p_k(c | context) = (n(context c) + TAU p_{k-1}) / (n(context) + TAU),
    and p_0 is even over the alphabet.
    """
    shorter = None
    for k in range(1, ORDER + 1):
        tail = F.substring("gram", ORDER - k + 1, k)
        n = counts.groupBy(tail.alias("tail")).agg(F.sum("acc").alias("acc"), F.sum("rej").alias("rej"))
        of = n.groupBy(F.substring("tail", 1, k - 1).alias("of")).agg(F.sum("acc").alias("of_acc"),
                                                                      F.sum("rej").alias("of_rej"))
        p = n.join(of, F.substring("tail", 1, k - 1) == F.col("of")).drop("of")
        if shorter is None:
            p = p.withColumns({f"below_{c}": F.lit(1.0 / len(ALPHABET)) for c in ("acc", "rej")})
        else:
            p = p.join(shorter, F.substring("tail", 2, k - 1) == F.col("short")).drop("short")
        p = p.select("tail", *[((F.col(c) + TAU * F.col(f"below_{c}")) / (F.col(f"of_{c}") + TAU)).alias(f"p_{c}")
                               for c in ("acc", "rej")])
        shorter = p.select(F.col("tail").alias("short"), F.col("p_acc").alias("below_acc"), F.col("p_rej").alias("below_rej"))
    ratio = F.round(SCALE * (F.log("p_acc") - F.log("p_rej"))).cast("long")
    return p.select(F.col("tail").alias("gram"), ratio.alias("ratio"))


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and ``score`` (millionths per character; null where a rule decides).

    One row per input row; null URLs and URLs without ``://`` have an empty host
    and path and are judged by the model. Repeated URLs are scored once. Without
    holdout URLs of both kinds the cutoff is 0; a URL on the cutoff is allowed.
    Only ``page_id`` and ``url`` are read.
    """
    base = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "ruled": verdict, "signs": signs(F.col("host"), F.col("path"))})
    # Equal URLs are counted and scored once, with their number of rows.
    urls = base.groupBy("host", "path").agg(F.first("signs").alias("signs"), F.first("ruled").alias("ruled"),
                                            F.count(F.lit(1)).alias("n"))
    held = F.substring(F.md5(F.col("host").cast("binary")), 1, 1).isin("0", "1", "2")
    urls = urls.withColumn("held", held)
    weight = lambda v: F.when((F.col("ruled") == v) & ~F.col("held"), F.col("n")).otherwise(0)
    seen = _grams(urls.withColumns({"acc": weight("allow"), "rej": weight("block")}), "acc", "rej")
    counts = written(seen.groupBy("gram").agg(F.sum("acc").alias("acc"), F.sum("rej").alias("rej")), "url-grams")
    ratios = F.broadcast(log_ratios(counts))         # at most len(ALPHABET) ** ORDER rows

    wanted = urls.where(F.col("ruled").isNull() | F.col("held"))
    scored = _grams(wanted, "host", "path", "ruled", "n").join(ratios, "gram") \
        .groupBy("host", "path", "ruled", "n").agg(F.floor(F.sum("ratio") / F.count(F.lit(1))).alias("score"))
    cutoff = calibrated_cutoff(scored.where("ruled IS NOT NULL"))
    own = scored.where("ruled IS NULL").select(F.col("host").alias("s_host"), F.col("path").alias("s_path"), "score")
    out = base.join(own, (F.col("host") == F.col("s_host")) & (F.col("path") == F.col("s_path")), "left")
    return out.select("page_id", "host", "path", "rule",
                      F.coalesce("ruled", F.when(F.col("score") >= cutoff, "allow").otherwise("block")).alias("verdict"),
                      "score")


def calibrated_cutoff(held: DataFrame) -> int:
    """The cutoff with the best balanced accuracy on holdout rows (ruled, n, score); of equally good ones that nearest to 0."""
    step = F.least(F.greatest(F.floor(F.col("score") / STEP), F.lit(-BINS)), F.lit(BINS))
    hist = held.groupBy(step.alias("step")).agg(
        F.sum(F.when(F.col("ruled") == "allow", F.col("n")).otherwise(0)).alias("acc"),
        F.sum(F.when(F.col("ruled") == "block", F.col("n")).otherwise(0)).alias("rej"))
    # At most 2 * BINS + 1 rows: cumulative sums over them in one window.
    order = Window.orderBy("step")
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    gain = F.coalesce(F.sum("rej").over(below), F.lit(0)) / F.sum("rej").over(whole) \
        - F.coalesce(F.sum("acc").over(below), F.lit(0)) / F.sum("acc").over(whole)
    # Every cutoff after the step before, up to this step, splits the holdout in the same way.
    cutoff = F.least(F.greatest(F.lit(0), (F.coalesce(F.lag("step").over(order), F.lit(-BINS)) + 1) * STEP), F.col("step") * STEP)
    rates = hist.select(cutoff.cast("long").alias("cutoff"), F.round(gain, 9).alias("gain")).where("gain IS NOT NULL")
    best = rates.orderBy(F.desc("gain"), F.abs("cutoff"), "cutoff").limit(1).collect()
    return best[0]["cutoff"] if best else 0
