"""Keywords in texts by automata against plain containment."""

import random

import pytest

from seedweave.operators.mapping import keyword_containment


@pytest.mark.parametrize("most", [1 << 20, 12])
def test_equals_plain_containment(spark, most):
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abé中") for _ in range(n))
    texts = [(i, word(rnd.randint(0, 60))) for i in range(50)] + [(90, None), (91, ""), (92, "ab" * 5000), (92, "ab" * 5000)]
    kws = [(word(rnd.randint(1, 5)), k) for k in range(40)] + [("", -1), (None, -2), ("ab", 100), ("ab", 101)]
    got = keyword_containment(spark.createDataFrame(texts, "id int, t string"), "t", spark.createDataFrame(kws, "kw string, k int"),
                              "kw", most_chars=most)
    assert got.columns == ["id", "t", "kw", "k"]
    assert sorted((r.id, r.kw, r.k) for r in got.collect()) == sorted((i, w, k) for i, t in texts if t for w, k in kws if w and w in t)


def test_no_keywords(spark):
    texts = spark.createDataFrame([(1, "a")], "id int, t string")
    assert keyword_containment(texts, "t", spark.createDataFrame([], "kw string"), "kw").count() == 0
