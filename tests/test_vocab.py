"""Vocabulary and token indices: odd rows against plain Python, and no sort of all tokens."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from seedweave.operators import vocab

BIG = 1 << 62
IDS = {"near": [3, 1, 2, 1], "far": [-BIG, BIG, 5, 5], "null": [None, 4, 4, None]}
TOKENS = [["b", "a", "b"], ["c", "b", "a"], [], ["a", "d"]]


def _docs(spark, ids):
    return spark.createDataFrame(list(zip(ids, TOKENS)), "doc_id long, tokens array<string>")


def _vocabulary(ids):
    """Words in order: frequency, then the least (doc_id, pos), null ids first."""
    place = lambda d, p: (d is not None, d or 0, p)
    seen = [(w, place(d, p)) for d, ws in zip(ids, TOKENS) for p, w in enumerate(ws)]
    tf, first = Counter(w for w, _ in seen), {w: min(p for v, p in seen if v == w) for w, _ in seen}
    return tf, first, {w: i + 1 for i, w in enumerate(sorted(tf, key=lambda w: (-tf[w], first[w], w)))}


@pytest.mark.parametrize("kind", IDS)
def test_vocabulary_of_odd_ids(spark, kind):
    tf, first, idx = _vocabulary(IDS[kind])
    docs = _docs(spark, IDS[kind])
    got = {r.word: r for r in vocab.vocabulary(docs, F.col("tokens")).collect()}
    assert {w: (r.tf, r.idx) for w, r in got.items()} == {w: (tf[w], idx[w]) for w in tf}
    assert {w: (r.first_seen.doc_id is not None, r.first_seen.doc_id or 0, r.first_seen.pos) for w, r in got.items()} == first
    order = {r.word: r.idx for r in vocab.first_seen_index(docs, F.col("tokens")).collect()}
    assert order == {w: i for i, w in enumerate(sorted(first, key=lambda w: (first[w], w)))}


def test_indices_of_frequent_and_other_words(spark, monkeypatch):
    monkeypatch.setattr(vocab, "FREQUENT_WORDS", 2)
    for ids in IDS.values():
        _, _, idx = _vocabulary(ids)
        docs, want = _docs(spark, ids), {}
        for d, ws in zip(ids, TOKENS):
            want.setdefault(d, []).extend((p, idx[w]) for p, w in enumerate(ws))
        got = {r.doc_id: r.ids for r in vocab.to_indices(docs, F.col("tokens"), vocab.vocabulary(docs, F.col("tokens"))).collect()}
        assert got == {d: [i for _, i in sorted(v)] for d, v in want.items() if v}


def test_tokens_are_not_sorted(spark):
    """Integer ids: words are counted in a hash table; only words outside the frequent ones are shuffled by word."""
    docs = _docs(spark, IDS["near"])
    plan = vocab._first_seen(docs, F.col("tokens"), "doc_id")._jdf.queryExecution().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    v = vocab.vocabulary(docs, F.col("tokens"))
    assert "BroadcastHashJoin" in vocab.to_indices(docs, F.col("tokens"), v)._jdf.queryExecution().executedPlan().toString()
