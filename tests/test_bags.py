"""Word bags give what the token arrays give."""

from collections import Counter

from pyspark.sql import functions as F

from seedweave.operators import match, rank

ROWS = [(1, ["b", "a", "b", "c"], ["x"]), (2, ["a", "a"], ["x", "y"]), (3, [], ["y"]), (4, None, ["x"]), (5, ["c", "b"], []),
        (6, ["a"] * 50 + ["é", "b"], ["y"]), (7, ["a", "b"], ["x"])]


def _docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, tokens array<string>, labels array<string>")


def test_word_bag(spark):
    got = {r.doc_id: [(b.word, b.n) for b in r.bag] for r in _docs(spark).select("doc_id", rank.word_bag("tokens").alias("bag")).collect()}
    assert got == {i: sorted(Counter(t or []).items()) for i, t, _ in ROWS}


def test_ranks_of_bags(spark):
    docs = _docs(spark)
    bags = docs.select("doc_id", "labels", rank.word_bag("tokens").alias("bag"))
    a, na = rank.rank_labelled(docs, min_df=1)
    b, nb = rank.rank_bags(bags, "bag", rank.bag_doc_freq(bags, "bag"), docs.count(), min_df=1)

    def rows(df):
        return sorted((r.label, r.word, round(r["rank"], 12)) for r in df.collect())
    assert rows(a) == rows(b) and rows(a)
    assert {tuple(r) for r in na.collect()} == {tuple(r) for r in nb.collect()}


def test_labels_of_bags(spark):
    docs = _docs(spark).drop("labels")
    for seeds in ({"p": ["a"], "q": ["b", "c"], "r": ["a", "z"]}, {"p": ["a"], "q": ["b"]}, {}):
        want = match.inrow_share_labels(docs, "tokens", seeds).where("tokens IS NOT NULL")
        bags = docs.withColumn("bag", rank.word_bag(F.col("tokens")))
        got = match.inrow_share_labels(bags, "bag", seeds, count=match.bag_label_counts).where("tokens IS NOT NULL")
        assert {r.doc_id: r.labels for r in want.collect()} == {r.doc_id: r.labels for r in got.collect()}
