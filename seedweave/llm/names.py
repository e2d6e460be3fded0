"""Names of text windows, and their exchange between documents and counting tasks.

Documents are compressed and written once with a number per row; a hash of that
number deals them to chunks, so copies and repeated rows spread, and names go to buckets (by their value). A task that reads documents sends one row per
bucket with the packed names of what it has seen, each name once per chunk; the
task of a bucket sorts them, decides, and answers one row per chunk. Rows therefore
carry plain 64-bit words, a name that is everywhere costs one entry per chunk, and
neither side ever holds more than its chunk or bucket, whose number grows with the
input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from seedweave.llm.shared import parts_for, text_bytes, written

CHUNK_BYTES = 4 << 20        # text bytes of a chunk; there are as many buckets as chunks
SEGMENT = 1 << 20            # units of a text that are named at once, to bound memory
FLUSH = 1 << 21              # names a task gathers before it sends them

A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASES = int(A) | 1, pow(int(A) | 1, -1, 1 << 64)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or those of the inverse."""
    if len(_POWERS[inverse]) < n:
        p = np.full(max(n, 1 << 12), _BASES[inverse], np.uint64)
        p[0] = 1
        _POWERS[inverse] = np.multiply.accumulate(p)
    return _POWERS[inverse][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * B
    x = (x ^ (x >> np.uint64(27))) * C
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of two neighbours from their names."""
    return mix(a * A + b)


def sliding_argmin(v: np.ndarray, width: int) -> np.ndarray:
    """For every s the place of the (first) smallest of v[s : s + width]."""
    low, at, k = v, np.arange(len(v)), 1
    while k < width:
        step = min(k, width - k)
        right = low[step:] < low[:-step]
        low = np.where(right, low[step:], low[:-step])
        at = np.where(right, at[step:], at[:-step])
        k += step
    return at


def found_in(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Place of each x in the sorted array, -1 if absent."""
    if not len(ordered):
        return np.full(len(x), -1, np.int64)
    p = np.searchsorted(ordered, x)
    p[p == len(ordered)] = 0
    return np.where(ordered[p] == x, p, -1)


def runs(mask: np.ndarray, first: int = 0) -> np.ndarray:
    """Rows (start, end) of the stretches of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    return edge.reshape(-1, 2) + first


def covered(starts: np.ndarray, length: int, n: int, stretches: np.ndarray | None = None) -> np.ndarray:
    """Mask of the n units that windows of that length cover which begin at ``starts`` or anywhere in ``stretches``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    if stretches is not None:
        np.add.at(change, stretches[:, 0], 1)
        np.add.at(change, stretches[:, 1] - 1 + length, -1)
    return np.cumsum(change[:-1]) > 0


def repeated(side_type: str):
    """The decision that tells every chunk which of its names (with their sides) came up more than once."""
    def decide(table: pa.Table) -> pa.Table:
        chunk, more, name, side = unpacked(table, side_type)
        at = first_of_group(name, side)
        often = np.repeat(np.add.reduceat(1 + more.astype(np.int64), at) > 1, np.diff(np.append(at, len(name))))
        entry = np.unique(np.rec.fromarrays((chunk[often], name[often])))
        return answers(entry.f0, entry.f1, np.ones(len(entry)))
    return decide


def chunked_documents(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int | None) -> tuple[DataFrame, int]:
    """(id, data, chunk), written, and the number of chunks.

    data is the compressed text (null: empty). The row number that decides the
    chunk is fixed by the write, so a task that runs again finds the same chunks.
    """
    def press(batches):
        import zstandard
        z = zstandard.ZstdCompressor()
        for b in batches:
            data = [z.compress(t.encode()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary()), b.column(2)], ["id", "data", "row"])

    n = parts_for(text_bytes(docs, text_col), chunk_bytes or CHUNK_BYTES, 1)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.monotonically_increasing_id().alias("row"))
    schema = StructType([StructField("id", docs.schema[id_col].dataType), StructField("data", BinaryType()),
                         StructField("row", LongType())])
    fixed = written(base.mapInArrow(press, schema), "documents")
    return fixed.select("id", "data", F.pmod(F.xxhash64("row"), F.lit(n)).cast("long").alias("chunk")), n


def columns_of(rows: list[tuple], types: list[pa.DataType]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)]


class Outbox:
    """Gathers columns of names and packs them into one row per bucket.

    The first column is the name that decides the bucket; with ``chunk`` it comes
    to entries, which are sent once, ``more`` telling whether one came up again.
    """

    SCHEMA = StructType([StructField("bucket", LongType()), StructField("chunk", BinaryType()),
                         StructField("more", BinaryType()), StructField("name", BinaryType()),
                         StructField("side", BinaryType())])

    def __init__(self, buckets: int, side_type: str):
        self.buckets, self.side_type, self.parts, self.size = buckets, side_type, [], 0

    def put(self, chunk: int, name: np.ndarray, side: np.ndarray) -> None:
        self.parts.append((np.full(len(name), chunk, np.uint32), name, side.astype(self.side_type)))
        self.size += len(name)

    def flush(self):
        """Record batches of what was gathered."""
        if not self.size:
            return
        chunk, name, side = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.size = [], 0
        # Low bits decide the bucket: names sampled as minima crowd at small values.
        bucket = ((name & np.uint64(0xFFFFFFFF)) * np.uint64(self.buckets)) >> np.uint64(32)
        order = np.lexsort((chunk, side, name, bucket))
        chunk, name, side, bucket = chunk[order], name[order], side[order], bucket[order]
        new = np.concatenate(([True], (name[1:] != name[:-1]) | (side[1:] != side[:-1]) | (chunk[1:] != chunk[:-1])))
        at = np.flatnonzero(new)
        more = (np.diff(np.concatenate((at, [len(new)]))) > 1).astype(np.uint8)
        chunk, name, side, bucket = chunk[at], name[at], side[at], bucket[at]
        edge = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]].astype(np.int64)), cut(chunk), cut(more), cut(name),
                                          cut(side)], self.SCHEMA.names)


def unpacked(table: pa.Table, side_type: str) -> tuple[np.ndarray, ...]:
    """(chunk, more, name, side) of all rows of a bucket, sorted by name and side."""
    read = lambda c, t: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)])
    chunk, more, name, side = read("chunk", np.uint32), read("more", np.uint8), read("name", np.uint64), read("side", side_type)
    order = np.lexsort((side, name))
    return chunk[order], more[order], name[order], side[order]


ANSWER = StructType([StructField("chunk", LongType()), StructField("names", BinaryType()), StructField("states", BinaryType())])


def answers(chunk: np.ndarray, name: np.ndarray, state: np.ndarray) -> pa.Table:
    """One row per chunk: its names and their states (of equal names the highest state first)."""
    order = np.lexsort((-state.astype(np.int64), name, chunk))
    chunk, name, state = chunk[order], name[order], state[order]
    edge = np.concatenate(([0], np.flatnonzero(chunk[1:] != chunk[:-1]) + 1, [len(chunk)])) if len(chunk) else np.zeros(1, int)
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary())
    return pa.table([pa.array(chunk[edge[:-1]].astype(np.int64)), cut(name), cut(state.astype(np.uint8))], ANSWER.names)


def told(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(sorted names, their states) of a chunk's answers."""
    read = lambda c, t: np.concatenate([np.zeros(0, t), *(np.frombuffer(x.as_buffer(), t) for x in table.column(c))])
    name, state = read("names", np.uint64), read("states", np.uint8)
    order = np.argsort(name, kind="stable")
    return name[order], state[order]


def ask(rows: DataFrame, decide) -> DataFrame:
    """Answers of ``decide(table)`` for every bucket of packed ``rows``."""
    return rows.groupBy("bucket").applyInArrow(decide, ANSWER)


def first_of_group(*keys: np.ndarray) -> np.ndarray:
    """Places where a new group of equal keys begins in sorted columns."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)
