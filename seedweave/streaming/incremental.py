"""G1: incremental classification as Structured Streaming.

New documents are read with the file source (``trigger(availableNow=True)``
processes whatever is there and stops), in micro-batches of about ``batch_bytes`` of files.
Ids that have arrived before are told apart by keyed state (``dropDuplicates`` on the
stream, dealt by id over the state store's partitions), so the sink is never read: the
first row of an id counts, also among several in one batch. Each micro-batch is labelled
with the production rule (P6, a stream-static join to the seed table) and written to the
sink's folder ``epoch=<id>``, replacing what an earlier attempt at the same epoch left: a
replayed batch starts from the state before it and writes nothing twice. Sink and progress
folder (which holds the state) are the caller's and are kept between runs, so a later call
only sees new files. The state has one entry per id that ever arrived; it is kept in RocksDB,
not in the executors' heap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seedweave.operators import match
from seedweave.plans.fixtures import SEEDS
from seedweave.sources.dictionaries import seeds_from_dict

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SINK_SCHEMA = "doc_id bigint, label string, epoch bigint"


def label_batch(batch: DataFrame, seeds: DataFrame, n_labels: int) -> DataFrame:
    return match.production_labels(batch.select("doc_id", "text"), "text", seeds, n_labels)


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_incremental_labels(spark: SparkSession, in_dir: str, sink: str, progress: str, seeds: dict | None = None,
                           table_name: str = "documents", batch_bytes: int = 16 << 30) -> DataFrame:
    """Label the new files of ``in_dir``; return all rows (doc_id, label) of the sink."""
    seeds = seeds or SEEDS
    seeds_df = seeds_from_dict(spark, seeds)
    # A pattern in the path, not a filter on file names: a table may be a file or a folder of part files.
    stream = (spark.readStream.schema(DOC_SCHEMA).option("maxBytesPerTrigger", batch_bytes)
              .parquet(f"{in_dir.rstrip('/')}/{table_name}*.parquet"))
    stream = stream.select("doc_id", "text").dropDuplicates(["doc_id"])

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        batch.persist()                        # the rule reads the batch twice; the state must move once
        out = label_batch(batch, seeds_df, len(seeds)).select("doc_id", "label")
        out.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/epoch={epoch_id}")
        batch.unpersist()

    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKSDB)           # read when the query starts
    try:
        q = (stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", progress)
             .trigger(availableNow=True).start())
    finally:
        spark.conf.set(_STORE, before)
    q.awaitTermination()
    return spark.read.schema(SINK_SCHEMA).parquet(sink).select("doc_id", "label")
