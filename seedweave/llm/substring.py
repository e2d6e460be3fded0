"""Substring deduplication by level-wise doubling.

Windows of ``words`` consecutive words that occur anywhere else are removed. A
window can only repeat if its halves do, so the first level counts windows of half
the length, and only those that repeat are extended to twice that length, which is
the length asked for; at a level without candidates nothing goes on. Of the first
level one window per stretch is enough: the one with the smallest name among the
half-length windows inside a window, which equal windows have in common.

Names of length 2k are made from two names of length k (overlapping at the ends
where the length is odd). The last level compares 96 bits of name.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from seedweave.llm import names as N
from seedweave.llm.shared import written

# The bytes that separate words.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_names(data: bytes) -> np.ndarray:
    """A 64-bit name of every word, made block by block."""
    out, at = [], 0
    while at < len(data):
        end = min(at + N.SEGMENT, len(data))
        while end < len(data) and not SEPARATOR[data[end]]:
            end += 1
        d = np.frombuffer(data, np.uint8, end - at, at)
        at = end
        inside = ~SEPARATOR[d]
        start, stop = N.runs(inside).T
        if not len(start):
            continue
        place = np.arange(len(d)) - np.repeat(start, np.diff(np.append(start, len(d)))) if start[0] == 0 else \
            np.concatenate((np.zeros(start[0], np.int64),
                            np.arange(start[0], len(d)) - np.repeat(start, np.diff(np.append(start, len(d))))))
        place[~inside] = 0
        value = (d.astype(np.uint64) + np.uint64(1)) * N.powers(int(place.max()) + 1)[place] * inside
        out.append(N.mix(np.add.reduceat(value, start) + (stop - start).astype(np.uint64) * N.C))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def window_names(units: np.ndarray, length: int) -> np.ndarray:
    """Names of all windows of ``length`` units, by doubling."""
    name, k = units, 1
    while k < length:
        step = min(k, length - k)
        name = N.pair(name[:-step], name[step:])
        k += step
    return name


def _levels(units: np.ndarray, length: int):
    """For every segment: its first window, the half-length names, and for each window the place of its sample."""
    half = (length + 1) // 2
    for at in range(0, max(len(units) - length + 1, 0), N.SEGMENT):
        part = units[at:at + N.SEGMENT + length - 1]
        names = window_names(part, half)
        yield at, part, names, N.sliding_argmin(names, length - half + 1)


def digest_of_kept(words: list[bytes], removed: np.ndarray | None):
    kept = words if removed is None else [w for w, r in zip(words, removed.tolist()) if not r]
    return (sha256(b" ".join(kept)).hexdigest(),)


def text_of_kept(words: list[bytes], removed: np.ndarray | None):
    kept = words if removed is None else [w for w, r in zip(words, removed.tolist()) if not r]
    return (b" ".join(kept).decode(),)


def remove_repeated_windows(docs: DataFrame, words: int = 35, id_col: str = "doc_id", text_col: str = "text",
                            finish=digest_of_kept, column: str = "kept_sha256", chunk_bytes: int | None = None) -> DataFrame:
    """id, n_words, n_removed and ``column`` of every row of ``docs``.

    ``finish(words, removed)`` makes the column (a string) from the words and the
    mask of the removed ones (None: none): their digest, or ``text_of_kept``.
    Null and empty texts have no words. Every row is a document of its own, also
    if ids repeat or are null: repeated rows remove each other's windows. Windows never
    cross documents. Very long texts are named ``SEGMENT`` words at a time, without a
    limit. Other columns of ``docs`` are not read, whatever their names. An empty table
    gives an empty table with the same columns.
    """
    length = words
    base, n_chunks = N.chunked_documents(docs, id_col, text_col, chunk_bytes)
    id_type = base.schema["id"].dataType

    def half_windows(batches):
        plain = zstandard.ZstdDecompressor()
        box = N.Outbox(n_chunks, "u1")
        for b in batches:
            for z, chunk in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for _, _, names, sample in _levels(word_names(plain.decompress(z)), length):
                    name = names[np.unique(sample)]
                    box.put(chunk, name, np.zeros(len(name)))
                    if box.size >= N.FLUSH:
                        yield from box.flush()
        yield from box.flush()

    counted = StructType([StructField("id", id_type), StructField("n_words", LongType()), StructField("n_removed", LongType()),
                          StructField(column, StringType())])
    split = StructType([StructField("open", BooleanType()), *counted, StructField("chunk", LongType()),
                        StructField("data", BinaryType()), StructField("candidates", BinaryType())])

    def extend(docs_table: pa.Table, answer: pa.Table) -> pa.Table:
        """Documents without a repeated half-length window are done; the others keep their candidate windows."""
        plain = zstandard.ZstdDecompressor()
        known, _ = N.told(answer)
        rows = []
        for z, chunk in zip(docs_table.column("data").to_pylist(), docs_table.column("chunk").to_pylist()):
            data = plain.decompress(z)
            units = word_names(data)
            found = [N.runs(N.found_in(names[sample], known) >= 0, at) for at, _, names, sample in _levels(units, length)] \
                if len(known) else []
            found = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            if len(found):
                rows.append((True, len(units), None, None, chunk, z, found.astype("<i8").tobytes()))
            else:
                rows.append((False, len(units), 0, *finish(data.split(), None), None, None, None))
        ids = docs_table.column("id").combine_chunks()
        types = [pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
        cols = N.columns_of(rows, types)
        return pa.table([cols[0], ids, *cols[1:]], split.names)

    def candidate_names(data: bytes, candidates: bytes):
        """Starts and 96-bit names of a document's candidate windows."""
        units = word_names(data)
        for a, b in np.frombuffer(candidates, "<i8").reshape(-1, 2).tolist():
            name = window_names(units[a:b + length - 1], length)
            side = window_names(units[a:b + length - 1] ^ N.B, length)
            yield a, len(units), name, side >> np.uint64(32)

    def full_windows(batches):
        plain = zstandard.ZstdDecompressor()
        box = N.Outbox(n_chunks, "u4")
        for b in batches:
            for z, cand, chunk in zip(*(c.to_pylist() for c in b.columns)):
                for _, _, name, side in candidate_names(plain.decompress(z), cand):
                    box.put(chunk, name, side)
                    if box.size >= N.FLUSH:
                        yield from box.flush()
        yield from box.flush()

    def remove(docs_table: pa.Table, answer: pa.Table) -> pa.Table:
        plain = zstandard.ZstdDecompressor()
        known, _ = N.told(answer)
        rows = []
        for z, cand, n in zip(*(docs_table.column(c).to_pylist() for c in ("data", "candidates", "n_words"))):
            data = plain.decompress(z)
            starts = np.concatenate([a + np.flatnonzero(N.found_in(name, known) >= 0)
                                     for a, _, name, _ in candidate_names(data, cand)])
            mask = N.covered(starts, length, n)
            rows.append((n, int(mask.sum()), *finish(data.split(), mask if len(starts) else None)))
        cols = N.columns_of(rows, [pa.int64(), pa.int64(), pa.string()])
        return pa.table([docs_table.column("id").combine_chunks(), *cols], counted.names)

    halves = N.ask(base.select("data", "chunk").mapInArrow(half_windows, N.Outbox.SCHEMA), N.repeated("u1"))
    level = written(base.groupBy("chunk").cogroup(halves.groupBy("chunk")).applyInArrow(extend, split), "substring")
    waiting = level.where("open")
    full = N.ask(waiting.select("data", "candidates", "chunk").mapInArrow(full_windows, N.Outbox.SCHEMA), N.repeated("u4"))
    removed = waiting.select("id", "n_words", "chunk", "data", "candidates").groupBy("chunk") \
        .cogroup(full.groupBy("chunk")).applyInArrow(remove, counted)
    out = level.where("NOT open").select(*counted.names).unionByName(removed)
    return out.withColumnRenamed("id", id_col)
