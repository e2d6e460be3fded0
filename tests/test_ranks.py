"""Cleaning and label-word counts: odd rows against plain Python, and one pass over the corpus."""

import glob
import re

from pyspark.sql import functions as F

from seedweave.functions import text as tx
from seedweave.operators import match, rank
from seedweave.operators.common import checkpoint_dir

TEXTS = ["1 2 3", "a1 b  c\t2d e\n9", " x٣y z", "", None, "12", "no digits  here ", "a 1 b c", "é1 é", "\n7\n8 a", "a" * 5000 + " 1" * 50]


def test_words_with_digits_go(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i long, t string")
    got = {r.i: r.c for r in df.select("i", tx.small_clean("t").alias("c")).collect()}

    def clean(t):
        t = re.sub(r"[^ \t\n\x0B\f\r]*\d[^ \t\n\x0B\f\r]*", "", t.lower().replace("ß", "ss"))
        return re.sub(" +", " ", re.sub(r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "", t))
    assert got == {i: None if t is None else clean(t) for i, t in enumerate(TEXTS)}


def test_stop_words_and_punctuation(spark):
    rows = [(["the", "cat", "--", "-a-", "'", "a", "$x"],), ([],), (None,)]
    df = spark.createDataFrame(rows, "t array<string>").select(tx.remove_stop_words("t").alias("t"))
    assert [r.t for r in df.collect()] == [["cat", "-a-", "$x"], [], None]


def test_seed_counts_in_the_row(spark):
    df = spark.createDataFrame([(["a", "b", "a", "z"],), ([],), (None,)], "t array<string>")
    seeds = {"p": ["a", "b"], "q": ["b", "c"], "r": []}
    got = [r.c for r in df.select(match.inrow_label_counts(F.col("t"), seeds).alias("c")).collect()]
    assert got[:2] == [[3, 1, 0], [0, 0, 0]]


def test_counts_by_set_of_labels(spark):
    """A label set is counted once per word, whatever its labels; odd rows count as documents."""
    rows = [(["b", "a", "b"], ["x", "y"]), (["a"], ["x", "x"]), ([], ["y"]), (None, ["x"]), (["c"], None), (["a"], [])]
    df = spark.createDataFrame(rows, "tokens array<string>, labels array<string>")
    counts = rank.word_counts(df)
    assert {(*r.labels, r.word): (r.df, r.tf) for r in counts.where(F.size("labels") == 2).collect()} == {
        ("x", "y", "a"): (1, 1), ("x", "y", "b"): (1, 2), ("x", "y", ""): (1, 1), ("x", "x", "a"): (1, 1), ("x", "x", ""): (1, 1)}
    stats = {(r.label, r.word): (r.df_l, r.tf_l) for r in rank.label_stats(df).collect()}
    assert stats == {("x", "a"): (3, 3), ("x", "b"): (1, 2), ("y", "a"): (1, 1), ("y", "b"): (1, 2)}
    ranks, sizes = rank.rank_labelled(df, min_df=1)
    assert {tuple(r) for r in sizes.collect()} == {("x", 4), ("y", 2)}
    got = {(r.label, r.word): round(r.reldocfreq, 6) for r in ranks.collect()}
    assert got == {("x", "a"): 1.0, ("x", "b"): 1.0, ("y", "a"): round(1 / 3, 6), ("y", "b"): 1.0}


def test_ranks_read_the_corpus_once(spark):
    """Whatever is joined to them, the results are read from counts that were written once."""
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = len(glob.glob(f"{folder}/word-counts-*"))
    df = spark.createDataFrame([(["a", "b"], ["x"])], "tokens array<string>, labels array<string>")
    ranks, sizes = rank.rank_labelled(df, min_df=1)
    files = ranks.where("rank > 0").join(sizes, "label").inputFiles()
    assert files and all("/word-counts-" in f for f in files)
    assert len(glob.glob(f"{folder}/word-counts-*")) == before + 1


def test_white_space_at_the_ends(spark):
    rows = ["", " ", "\t a b \r\n", " a \u0085", "a  ", "a ", " \u0085 ", "\x0b\fa  ", None, "a \u0085\n", "\u0085 a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i long, t string")
    old = F.regexp_replace("t", r"^\s+|\s+$", "")
    assert df.where(~tx.strip_ws("t").eqNullSafe(old)).count() == 0


def test_tokens_of_odd_texts(spark):
    rows = ["", " ", "a,b  c\r d\x0be", "--a--", "\ta\n", "A'B$1 ß", None, "a b"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    keep = lambda parts: F.filter(parts, lambda t: t != "")
    words = keep(F.split(F.regexp_replace(F.lower("t"), tx.char_class(tx.TOKENIZER_FILTERS), " "), " "))
    assert df.where(~tx.filter_tokens("t").eqNullSafe(words)).count() == 0
    assert df.where(~tx.whitespace_tokens("t").eqNullSafe(keep(F.split("t", r"\s+")))).count() == 0
    a, b = tx.small_clean("t"), tx.small_clean("t", squeeze=False)
    assert df.where(~tx.filter_tokens(a).eqNullSafe(tx.filter_tokens(b, lower=False))).count() == 0


def test_subsets_that_are_the_corpus(spark):
    """Without a subset the corpus is counted once, with the same ranks as a subset of all its rows."""
    rows = [("x", ["b", "a", "b"]), ("x", ["a"]), ("y", []), ("y", None), (None, ["c", "a"]), ("y", ["c", "d"])]
    c = spark.createDataFrame(rows, "lang string, tokens array<string>")
    folder = checkpoint_dir(spark).removeprefix("file:")
    want = {tuple(r) for r in rank.subset_stats(c, c.select("lang", "tokens"), group="lang").select("lang", "word", "rank", "pos").collect()}
    before = len(glob.glob(f"{folder}/word-counts-*"))
    got = rank.subset_stats(c, group="lang").select("lang", "word", "rank", "pos")
    assert {tuple(r) for r in got.collect()} == want and want
    assert len(glob.glob(f"{folder}/word-counts-*")) == before + 1


def test_two_kinds_of_labels_in_one_pass(spark):
    rows = [(["b", "a", "b"], ["x", "y"], ["p"]), (["a"], ["x", "x"], [None]), ([], ["y"], ["p"]), (None, ["x"], ["q"]), (["c"], None, ["q"])]
    df = spark.createDataFrame(rows, "tokens array<string>, labels array<string>, lang array<string>")
    counts = rank.word_counts(df, "tokens", "labels", "lang")
    for labels in ("labels", "lang"):
        (a, na), (b, nb) = rank.rank_labelled(df, "tokens", labels, min_df=1), rank.rank_labelled(None, "tokens", labels, min_df=1, counts=counts)
        assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}
        assert {tuple(r) for r in na.collect()} == {tuple(r) for r in nb.collect()}
        assert {tuple(r) for r in rank.docs_per_label(df, labels).where("label IS NOT NULL").collect()} == {tuple(r) for r in nb.collect()}


def test_several_dictionaries_in_one_pass(spark):
    tokens = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "b"), (2, "z")], "doc_id long, word string")
    dicts = spark.createDataFrame([("p", "a", 0), ("p", "b", 1), ("q", "b", 0), ("q", "b", 0)], "label string, word string, iteration int")
    got = {tuple(r) for r in match.label_counts(tokens, dicts, "iteration").select("iteration", "doc_id", "label", "n").collect()}
    assert got == {(0, 1, "p", 2), (0, 1, "q", 1), (1, 1, "p", 1), (0, 2, "q", 1), (1, 2, "p", 1)}
    for i in (0, 1):
        one = match.label_counts(tokens, dicts.where(F.col("iteration") == i))
        assert {(i, *r) for r in one.select("doc_id", "label", "n").collect()} == {r for r in got if r[0] == i}
