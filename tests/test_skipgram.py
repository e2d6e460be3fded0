"""Skip-gram vectors trained in groups: planted topics, the words that get one, gradients, no vocabulary on the driver."""

import numpy as np

from seedweave.operators import corpus_senses as cs
from seedweave.operators import skipgram


def test_planted_topics(spark, monkeypatch):
    rnd = np.random.default_rng(8)
    topics = [[f"{t}{i}" for i in range(8)] for t in "abcd"]
    docs = [(d, [str(w) for w in rnd.choice(topics[d % 4], 40)]) for d in range(1600)] + [(1600, ["once", "a0", "twice", "twice"]), (1601, []), (1602, ["alone", "last"]), (1603, ["alone"])]
    corpus = cs.token_ids(spark.createDataFrame(docs, "doc_id long, tokens array<string>"))
    for passes, groups in ((3, 2), (1, 1)):
        got = {r["word"]: np.array(r["vec"]) for r in skipgram.word_vectors(corpus, 20, passes=passes, groups=groups).collect()}
        assert set(got) == {w for t in topics for w in t} | {"twice", "alone"}      # at least two occurrences
        assert {w: float(np.linalg.norm(v)) for w, v in got.items() if not abs(np.linalg.norm(v) - 1) < 1e-6} == {}
        m = np.array([got[w] for t in topics for w in t])
        cos, same = m @ m.T, np.equal.outer(np.arange(32) // 8, np.arange(32) // 8)
        assert cos[same & ~np.eye(32, dtype=bool)].mean() > cos[~same].mean() + 0.3


def test_places_that_come_often_move_as_if_they_came_at_most_so_often():
    m = np.zeros((3, 2), np.float32)
    skipgram._add(m, np.array([1] * 97 + [0] * 3), np.ones((100, 2), np.float32), np.ones(100), 0.5)
    assert np.allclose(m, [[-1.5, -1.5], [-0.5 * skipgram.MOST] * 2, [0, 0]])


def test_few_very_frequent_words_stay_finite():
    rng = np.random.default_rng(1)
    words, ids = np.unique(np.minimum(rng.zipf(1.2, 60_000), 2_000), return_inverse=True)
    near, other = skipgram.first_vectors(words, 30, 42), np.zeros((len(words), 30), np.float32)
    skipgram.train(ids, np.full(60, 1000), near, other, 5, rng, (0, 1))
    assert np.isfinite(near).all() and np.abs(near).max() < 10 and np.abs(other).max() < 10


def test_query(spark, monkeypatch):
    from pyspark.ml.feature import Word2Vec
    import __spark_entry__ as entry
    from seedweave.functions.text import explode_nonempty
    from seedweave.plans.catalog_rank import corpus
    from tests.conftest import SMALL
    monkeypatch.setattr(Word2Vec, "fit", lambda *_: (_ for _ in ()).throw(AssertionError("Spark ML holds the vocabulary on the driver")))
    rows = entry.queries()["k1_word_vectors"](spark, SMALL).collect()
    counts = explode_nonempty(corpus(spark, SMALL), "tokens", "word").groupBy("word").count().where("count > 1").collect()
    assert {r["word"] for r in rows} == {r["word"] for r in counts} and all(r["dims"] == 100 and r["norm"] == 1 for r in rows)
