"""Near-duplicates by classes of length and blocks against all pairs."""

import random

import pytest

from seedweave.operators.dedup import drop_near_duplicates, indel_ratio, similarities


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(21)
    out = []
    for g in (1, 2, None):
        bases = ["".join(rnd.choice("abcdeé 😀") for _ in range(n)) for n in (1, 2, 3, 5, 8, 13, 40, 41, 58, 60, 90, 200)]
        for i in range(90 if g == 1 else 12):
            t = list(rnd.choice(bases))
            for _ in range(rnd.randrange(0, 1 + len(t) // 4)):
                k = rnd.randrange(len(t) + 1)
                t[k:k + rnd.choice([0, 1])] = rnd.choice(["", "a", "xy"])
            out.append((g, i // 7, i, "".join(t) if rnd.random() > 0.05 else rnd.choice([None, ""])))
    return out


@pytest.mark.parametrize("block", [2048, 3])
def test_same_rows_as_all_pairs(spark, rows, block):
    df = spark.createDataFrame(rows, "g int, day int, o int, t string")
    got = {(r.g, r.o) for r in drop_near_duplicates(df, "g", ["day", "o"], "t", block=block).collect()}
    want = set()
    for g, d, o, t in rows:
        if g is None:
            continue
        earlier = [u or "" for g2, d2, o2, u in rows if g2 == g and (d2, o2) < (d, o)]
        if not any(u == (t or "") or indel_ratio(u, t or "") > 80.5 for u in earlier):
            want.add((g, o))
    assert {x for x in got if x[0] is not None} == want


@pytest.mark.parametrize("block", [2048, 2])
def test_every_pair_within_reach_is_scored_once(spark, rows, block):
    rows = [(g, o, t or "") for g, _, o, t in rows if g is not None]
    got = sorted(tuple(r) for r in similarities(spark.createDataFrame(rows, "g int, o int, t string"), "g", "o", "t", block=block).collect())
    want = sorted((g, a, b, indel_ratio(t, u)) for g, a, t in rows for g2, b, u in rows
                  if g == g2 and a < b and 400 * min(len(t), len(u)) > 161 * (len(t) + len(u)))
    assert got == want


def test_a_large_group_is_spread(spark):
    """No place holds more than two blocks, and no row repeats a text for blocks out of reach."""
    from seedweave.operators.dedup import _PLACE, _meeting
    df = spark.range(3000).selectExpr("1 AS g", "id AS o", "repeat('x', int(1 + id % 300)) AS t")
    met = _meeting(df, "g", ["o"], "t", 100)
    assert met.groupBy("g", *_PLACE).count().agg({"count": "max"}).first()[0] < 350
    assert met.count() < 3000 * 30
    assert drop_near_duplicates(df.limit(0), "g", ["o"], "t").count() == 0
