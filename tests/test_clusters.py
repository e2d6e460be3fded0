"""k-means on a packed matrix: a fixed point of Lloyd's step, planted groups, few documents, the words of clusters."""

import numpy as np
from pyspark.sql import functions as F

from seedweave.operators import clusters, packed


def test_planted_groups_and_fixed_point(spark, monkeypatch):
    monkeypatch.setattr(packed, "CHUNK", 100)
    rng = np.random.default_rng(6)
    x = np.zeros((90, 40))
    for i in range(80):                                       # ten documents without entries
        x[i, rng.choice(np.arange(10) + 10 * (i % 4), 5, replace=False)] = rng.random(5) + 1
    x[7, 33] = 0.5
    entries = spark.createDataFrame([(int(i), str(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "doc long, feature string, x double")
    m = packed.pack(entries, spark.range(90).select(F.col("id").alias("doc")))
    assert m.chunks > 3
    got = {r.doc: r.cluster for r in clusters.kmeans(m, 5).collect()}
    assert set(got) == set(range(90))
    mine = np.array([got[i] for i in range(90)])
    centers = np.stack([x[mine == j].mean(0) for j in sorted(set(mine))])
    far = ((x[:, None] - centers) ** 2).sum(2)
    assert (np.array(sorted(set(mine)))[far.argmin(1)] == mine).all()
    again = {r.doc: r.cluster for r in clusters.kmeans(m, 5).collect()}
    assert again == got
    m.rows.unpersist()


def test_fewer_documents_than_clusters(spark):
    entries = spark.createDataFrame([(0, "a", 1.0), (1, "b", 2.0), (2, "b", 2.0)], "doc long, feature string, x double")
    m = packed.pack(entries, spark.range(3).select(F.col("id").alias("doc")))
    got = {r.doc: r.cluster for r in clusters.kmeans(m, 4).collect()}
    assert got[1] == got[2] != got[0]
    m.rows.unpersist()


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc long, feature string, x double")
    assert clusters.kmeans(packed.pack(none, none.select("doc")), 4).count() == 0


def test_queries_need_no_vocabulary_on_the_driver(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import CountVectorizer
    import __spark_entry__ as entry
    from tests.conftest import SMALL
    for c in (KMeans, CountVectorizer):
        monkeypatch.setattr(c, "fit", lambda *_: (_ for _ in ()).throw(AssertionError("Spark ML holds the vocabulary on the driver")))
    sizes = {r["cluster"]: r["n"] for r in entry.queries()["a26_cluster_sizes"](spark, SMALL).collect()}
    assert sum(sizes.values()) == 200 and set(sizes) <= set(range(4))
    words = entry.queries()["a26_cluster_words"](spark, SMALL).collect()
    assert {r["cluster"] for r in words} <= set(sizes) and max(r["pos"] for r in words) <= 10
