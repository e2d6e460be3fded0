"""Core queries against the DuckDB oracle (same comparison as the driver's)."""

import hashlib
import math

import duckdb
import pytest

from tests.conftest import SF

CORE = ["p2_share_rule", "p4_relative_to_max_rule", "p6_production_rule", "a6_rank_table", "p15_expand_round1",
        "p10_company_labels", "p7_tag_matches", "k13_textrank_two_steps", "w8_vocabulary", "a21_confusion",
        "x13_merge_bigrams", "a19_sense_threshold", "d1_one_vs_all", "j1_not_in_null_aware"]
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if hasattr(v, "item"):
        return _canon(v.item())
    return str(v)


def _digest(pdf):
    cols = sorted(pdf.columns)
    rows = sorted(tuple(_canon(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None))
    return cols, len(rows), hashlib.sha1(repr(rows).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", CORE)
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as entry
    q = entry.queries()[name]
    sql = entry.oracle_sql()[name]
    assert _digest(q(spark, SF).toPandas()) == _digest(con.sql(sql).df())


def test_every_query_has_a_callable_and_sql_keys_are_queries():
    import __spark_entry__ as entry
    qs, sqls = entry.queries(), entry.oracle_sql()
    assert len(qs) >= 100
    assert set(sqls) <= set(qs)


def test_negative_control_changed_threshold_fails(spark, con):
    """A query with one changed constant must not match its oracle."""
    import __spark_entry__ as entry
    from seedweave.operators import match
    from seedweave.plans.catalog_match import _counts
    from seedweave.plans.fixtures import SEEDS
    changed = match.share_rule(_counts(spark, SF), len(SEEDS), 0.25)
    assert _digest(changed.toPandas()) != _digest(con.sql(entry.oracle_sql()["p2_share_rule"]).df())


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "label", "n", "total"]
    assert df.count() > 0
