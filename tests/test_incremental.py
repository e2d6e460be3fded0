"""G1: documents that arrive in files, with state per id."""

import glob
import os

from seedweave.operators import match
from seedweave.plans.fixtures import SEEDS
from seedweave.session import table
from seedweave.sources.dictionaries import seeds_from_dict
from seedweave.streaming.incremental import run_incremental_labels
from tests.conftest import SMALL


def rows(df):
    return sorted((r.doc_id, r.label or "") for r in df.select("doc_id", "label").collect())


def test_calls_with_overlapping_ids_and_a_replayed_batch(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    into, sink, progress = (str(tmp_path / x) for x in ("in", "sink", "progress"))
    ids = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    first, second = docs.where(docs.doc_id <= ids[120]), docs.where(docs.doc_id >= ids[80])
    os.mkdir(into)
    first.toPandas().to_parquet(f"{into}/documents-1.parquet")
    label = lambda df: match.production_labels(df.select("doc_id", "text"), "text", seeds_from_dict(spark, SEEDS), len(SEEDS))
    assert rows(run_incremental_labels(spark, into, sink, progress)) == rows(label(first))
    second.toPandas().to_parquet(f"{into}/documents-2.parquet")
    first.limit(30).toPandas().to_parquet(f"{into}/documents-3.parquet")
    got = rows(run_incremental_labels(spark, into, sink, progress, batch_bytes=1000))
    assert got == rows(label(docs))
    # A crash after the write and before the commit: the last batch runs again, on the state before it.
    last = max(glob.glob(f"{progress}/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(last)
    os.remove(f"{progress}/commits/.{os.path.basename(last)}.crc")
    assert rows(run_incremental_labels(spark, into, sink, progress)) == got
    # Nothing new: nothing happens.
    assert rows(run_incremental_labels(spark, into, sink, progress)) == got


def test_a_table_that_is_a_folder_of_part_files(spark, tmp_path):
    from seedweave.plans.catalog_sampling import g1_incremental_labels
    text = ["the cat and of", "der und des", None, "nothing here"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(text * 3)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs.limit(2).write.parquet(f"{tmp_path}/pages.parquet")               # another table beside it
    want = match.production_labels(docs.select("doc_id", "text"), "text", seeds_from_dict(spark, SEEDS), len(SEEDS))
    assert rows(g1_incremental_labels(spark, str(tmp_path))) == rows(want)
