"""The functions by name in SQL give what the column functions give; nulls and odd inputs."""

from pyspark.sql import functions as F

from seedweave.functions import sql as sw
from seedweave.functions import text as tx

TEXTS = [None, "", "   ", "Ab1 über-STRASSE Straße\n x yz", "it's \"q\" a_b\tc, d 2nd"]


def test_row_functions(spark):
    sw.register(spark)
    sw.register(spark)                                         # may be repeated
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    got = spark.sql("SELECT i, sw_small_clean(text) c, sw_word_tokens(text) w, sw_filter_tokens(text) f FROM {d}", d=df).collect()
    want = df.select("i", tx.small_clean("text").alias("c"), tx.word_tokens("text").alias("w"), tx.filter_tokens("text").alias("f"))
    assert sorted(got) == sorted(want.collect())


def test_row_to_many(spark):
    sw.register(spark)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    rows = spark.sql("WITH a AS (SELECT i, sw_token_rows(text) AS words FROM {d}), t AS (SELECT i, inline_outer(words) FROM a) "
                     "SELECT * FROM t WHERE word IS NOT NULL", d=df)
    want = df.select("i", F.posexplode(tx.word_tokens("text")).alias("pos", "word")).collect()
    assert sorted(rows.collect()) == sorted(want) and want
    plan = rows._jdf.queryExecution().toString().split("Physical Plan")[1]
    assert "Join" not in plan and "Exchange" not in plan                    # a narrow stage


def test_share_labels(spark):
    sw.register(spark)

    def kept(counts, labels, threshold):
        arr = ", ".join(f"named_struct('label', '{l}', 'n', {n}L)" for l, n in counts)
        row = spark.sql(f"SELECT sw_share_labels(array({arr}), {labels}, {threshold}D) AS k").first()
        return [(r.label, r.n, r.total) for r in row.k]
    assert kept([("b", 2), ("a", 2), ("c", 6)], 3, 0.2) == [("c", 6, 10), ("a", 2, 10), ("b", 2, 10)]
    assert kept([("b", 2), ("a", 2), ("c", 6)], 3, 0.7) == [("c", 6, 10)]
    assert kept([("b", 1), ("a", 1)], 3, 0.9) == [("a", 1, 2)]
    assert kept([("b", 9), ("a", 1)], 2, 0.9) == [("b", 9, 10), ("a", 1, 10)]
    assert spark.sql("SELECT sw_share_labels(NULL, 3, 0.2D) AS k").first().k is None
    assert spark.sql("SELECT sw_sorted_union(array(array('b', 'a'), array('a'))) AS u").first().u == ["a", "b"]
