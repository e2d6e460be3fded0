"""Token ids in Arrow files of equal-length sequences and masks.

The documents, in ascending id order, are dealt to shards by one range partitioning.
A shard is one file in the Arrow IPC file format (the stream of record batches with a
footer that says where each begins), written by one task while it encodes: the ids of
all its documents run on over fixed-size lists of ``LENGTH`` ids, the last one filled up.
Every batch holds ``BATCH`` sequences (the last one the rest) and isn't compressed, so a
mapped file gives sequence ``i`` and its mask as views of the file's own bytes.

Columns of a file: ``ids`` (fixed-size list of uint16, or uint32 for larger vocabularies),
``mask`` (fixed-size list of bits, set for an id, not for filling), ``ends`` (list of the
documents that end in the sequence: their id and the place after their last token).

A file belongs to the data set only if the table of shards names it. That table has
one row per finished task, so files of lost or repeated tasks are never read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from seedweave.llm.bpe import LEAF_CHARS, ByteBpe, byte_bpe, halves
from seedweave.llm.shared import parts_for, shuffle_partitions, text_bytes, written
from seedweave.session import ensure_checkpoint_dir

LENGTH = 2048
BATCH = 64
END_ID = 0
SHARD_BYTES = 128 << 20        # text per shard


def file_schema(id_type: pa.DataType, most: int, length: int) -> pa.Schema:
    token = pa.uint16() if most < 1 << 16 else pa.uint32()
    ends = pa.list_(pa.struct([("doc_id", id_type), ("end", pa.int32())]))
    return pa.schema([("ids", pa.list_(token, length)), ("mask", pa.list_(pa.bool_(), length)), ("ends", ends)])


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a path or a URI (``file:/x`` included)."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Appends documents to one file; holds the ids of one batch."""

    def __init__(self, sink, schema: pa.Schema, batch: int):
        self.schema, self.batch, self.length = schema, batch, schema.field("ids").type.list_size
        self.dtype = schema.field("ids").type.value_type.to_pandas_dtype()
        self.writer = ipc.new_file(sink, schema)
        self.ids = np.zeros(batch * self.length, self.dtype)
        self.filled = self.docs = self.tokens = self.sequences = 0
        self.ended: list[tuple[int, object]] = []          # (place after the last id in this batch, document)

    def append(self, doc, ids: np.ndarray) -> None:
        self.docs, self.tokens, at = self.docs + 1, self.tokens + len(ids), 0
        while at < len(ids):
            if self.filled == len(self.ids):
                self.flush()
            n = min(len(ids) - at, len(self.ids) - self.filled)
            self.ids[self.filled:self.filled + n] = ids[at:at + n]
            self.filled, at = self.filled + n, at + n
        self.ended.append((self.filled, doc))

    def flush(self) -> None:
        n = -(-self.filled // self.length)
        if not n:
            return
        ids, mask = self.ids[:n * self.length].copy(), np.zeros(n * self.length, bool)
        ids[self.filled:], mask[:self.filled] = 0, True
        places = np.array([p for p, _ in self.ended], np.int64)
        row = (places - 1) // self.length                   # the sequence that holds the last id
        offsets = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
        docs = pa.array([d for _, d in self.ended], self.schema.field("ends").type.value_type.field(0).type)
        ends = pa.StructArray.from_arrays([docs, pa.array((places - row * self.length).astype(np.int32))], ["doc_id", "end"])
        self.writer.write_batch(pa.record_batch([
            pa.FixedSizeListArray.from_arrays(pa.array(ids), type=self.schema.field("ids").type),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), type=self.schema.field("mask").type),
            pa.ListArray.from_arrays(pa.array(offsets), ends, type=self.schema.field("ends").type)], schema=self.schema))
        self.sequences, self.filled, self.ended = self.sequences + n, 0, []

    def close(self) -> None:
        self.flush()
        self.writer.close()


class Shard:
    """Random access to a written file: ``shard.ids(i)`` and ``shard.mask(i)`` are views, nothing is copied if it is mapped."""

    def __init__(self, uri: str):
        folder, path = open_folder(uri)
        local = isinstance(folder, fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else folder.open_input_file(path)
        self.reader = ipc.open_file(self.source)
        n = self.reader.num_record_batches
        self.batch = self.reader.get_batch(0).num_rows if n else 0
        self.count = (n - 1) * self.batch + self.reader.get_batch(n - 1).num_rows if n else 0

    def __len__(self) -> int:
        return self.count

    def _list(self, column: str, i: int) -> pa.Array:
        if not 0 <= i < self.count:
            raise IndexError(i)
        lists = self.reader.get_batch(i // self.batch).column(column)
        size, row = lists.type.list_size, i % self.batch
        return lists.values.slice((lists.offset + row) * size, size)

    def ids(self, i: int) -> np.ndarray:
        return self._list("ids", i).to_numpy(zero_copy_only=True)

    def mask(self, i: int) -> pa.BooleanArray:
        return self._list("mask", i)

    def documents(self):
        """(doc_id, ids) of all documents in order; holds one batch and the document being read."""
        begun: list[np.ndarray] = []
        for k in range(self.reader.num_record_batches):
            batch = self.reader.get_batch(k)
            lists, ends = batch.column("ids"), batch.column("ends")
            size = lists.type.list_size
            ids, filled = lists.flatten().to_numpy(), batch.column("mask").flatten().true_count
            docs = ends.flatten()
            rows = np.repeat(np.arange(len(ends)), np.diff(ends.offsets.to_numpy()))
            at = 0
            for doc, stop in zip(docs.field("doc_id").to_pylist(), (rows * size + docs.field("end").to_numpy()).tolist()):
                yield doc, np.concatenate([*begun, ids[at:stop]]) if begun else ids[at:stop]
                begun, at = [], stop
            rest = ids[at:filled]                             # filling stands only at the file's end
            if len(rest):
                begun.append(rest)

    def close(self) -> None:
        self.source.close()


def whole_ids(bpe: ByteBpe, text: str) -> list[int]:
    """Ids of a text of any length; long ones in parts that are joined."""
    if len(text) <= LEAF_CHARS:
        return bpe.encode(text)
    return bpe.join_all([bpe.encode(t) for t in halves(text, LEAF_CHARS)])


def write_sequences(docs: DataFrame, tokenizer: str, folder: str | None = None, length: int = LENGTH, batch: int = BATCH,
                    shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the files; the table of shards: shard (ascending ids), file, n_docs, n_tokens, n_sequences.

    Documents ascend by ``doc_id`` (null first), those of one id by a hash of their text.
    Equal rows are documents of their own and can be dealt to several shards. A null text
    is empty, so its only id is the end id. ``folder`` (default: a new one in the session's
    shared folder) and ``tokenizer`` must be reachable by every worker. More columns are
    not read. An empty table writes no file.
    """
    spark = docs.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark)}/sequences-{uuid.uuid4().hex}"
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"),
                       F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    order = ["id", "hash", "salt"]
    shards = parts_for(text_bytes(docs, "text"), shard_bytes, shuffle_partitions(spark))
    rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order) \
        .select("id", "text", F.spark_partition_id().alias("shard"))

    def write_shard(batches):
        bpe, writer = byte_bpe(tokenizer), None
        for rows in batches:
            if not rows.num_rows:
                continue
            if writer is None:
                shard = rows.column("shard")[0].as_py()
                name = f"shard-{shard:06d}-{uuid.uuid4().hex}.arrow"
                place, path = open_folder(folder)
                place.create_dir(path, recursive=True)
                sink = place.open_output_stream(f"{path}/{name}")
                writer = ShardWriter(sink, file_schema(id_type, len(bpe.bytes_of) - 1, length), batch)
            for doc, text in zip(rows.column("id").to_pylist(), rows.column("text").to_pylist()):
                writer.append(doc, np.array([*whole_ids(bpe, text), END_ID], writer.dtype))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{
                "shard": shard, "file": f"{folder}/{name}", "n_docs": writer.docs, "n_tokens": writer.tokens,
                "n_sequences": writer.sequences}], schema=made)

    made = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
                      ("n_sequences", pa.int64())])
    return written(rows.mapInArrow(write_shard, "shard int, file string, n_docs long, n_tokens long, n_sequences long"),
                   "shards")


def read_documents(shards: DataFrame, rows_of, fields: list[StructField], id_field: StructField) -> DataFrame:
    """The documents' id, ``start`` (ids of all documents before) and what ``rows_of(ids)`` gives, from the files of ``shards``.

    A task reads one file, batch by batch.
    """
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    # One row per file, sorted in one task: a table of file names, not of data.
    named = shards.select("shard", "file", F.coalesce(before, F.lit(0)).alias("start"))
    n = max(1, shards.count())
    schema = StructType([StructField("doc_id", id_field.dataType), StructField("start", LongType()), *fields])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def read(batches):
        for rows in batches:
            for uri, start in zip(rows.column("file").to_pylist(), rows.column("start").to_pylist()):
                shard, out = Shard(uri), []
                for doc, ids in shard.documents():
                    out.append((doc, start, *rows_of(ids)))
                    start += len(ids)
                    if len(out) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)
                shard.close()

    return named.repartitionByRange(n, "shard").mapInArrow(read, schema)


def ids_crc(ids: np.ndarray) -> tuple[int, int]:
    """Number of ids and the CRC-32 of them as little-endian unsigned 32-bit integers."""
    return len(ids), zlib.crc32(ids.astype("<u4").tobytes())


def round_trip(docs: DataFrame, tokenizer: str, **kw) -> DataFrame:
    """Files written and read back: doc_id, start, n_tokens, ids_crc32 of every row; rules as in ``write_sequences``."""
    shards = write_sequences(docs, tokenizer, **kw)
    fields = [StructField("n_tokens", LongType()), StructField("ids_crc32", LongType())]
    return read_documents(shards, ids_crc, fields, docs.schema["doc_id"])
