"""Document fingerprints by content-defined chunking.

A text's UTF-8 bytes are cut where a gear hash of the last 32 bytes is small:
rarely below ``NORMAL`` bytes of chunk, more easily beyond (normalised chunking), so
an insertion moves only the cuts beside it. The fingerprint is the set of the
chunks' 64-bit digests with their lengths; likeness is the length of the shared
chunks against the shorter set (containment).

``neighbour_fingerprints`` compares every document with the next one. Ids are cut
into ranges by quantiles; a range's rows meet in one sorted stream, and the first
document of the following range is sent along, so no order is ever global.
"""

from __future__ import annotations

from bisect import bisect_left
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from seedweave.llm.shared import shuffle_partitions

MIN, NORMAL, MAX = 32, 64, 256            # bytes of a chunk; MIN is the gear hash's reach
STRICT, LOOSE = 1 << 25, 1 << 27          # one in 128 and one in 32 hashes is below


def _gear_table() -> np.ndarray:
    """256 words of SplitMix64 (seed 0), upper halves."""
    out, state, full = [], 0, (1 << 64) - 1
    for _ in range(256):
        state = (state + 0x9E3779B97F4A7C15) & full
        z = (state ^ state >> 30) * 0xBF58476D1CE4E5B9 & full
        z = (z ^ z >> 27) * 0x94D049BB133111EB & full
        out.append((z ^ z >> 31) >> 32)
    return np.array(out, np.uint32)


GEAR = _gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - k]] << k over k < 32, by doubling the reach five times."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``."""
    n, start, out = len(data), 0, []
    if n > MIN:
        h = gear_hashes(np.frombuffer(data, np.uint8))
        loose = np.flatnonzero(h < LOOSE)
        strict = (loose[h[loose] < STRICT] + 1).tolist()
        loose = (loose + 1).tolist()
        s = e = 0
        while n - start > MIN:
            s = bisect_left(strict, start + MIN, s)
            if s < len(strict) and strict[s] < start + NORMAL:
                start = strict[s]
            else:
                e = bisect_left(loose, start + NORMAL, e)
                start = min(loose[e] if e < len(loose) else n, start + MAX, n)
            out.append(start)
    if start < n:
        out.append(n)
    return out


def fingerprint(text: str) -> dict[int, int]:
    """Digest -> length of the chunks of ``text``; empty for an empty text."""
    from xxhash import xxh3_64_intdigest

    data = text.encode()
    ends = cuts(data)
    return {xxh3_64_intdigest(data[a:b]): b - a for a, b in zip([0, *ends], ends)}


def shown(chunks: dict[int, int]) -> str:
    """The set as text: 16 hex digits of digest and 2 of length - 1 for each chunk, sorted."""
    row = np.empty(len(chunks), [("digest", ">u8"), ("length", "u1")])
    digests = np.fromiter(chunks.keys(), np.uint64, len(chunks))
    order = digests.argsort()
    row["digest"] = digests[order]
    row["length"] = (np.fromiter(chunks.values(), np.int64, len(chunks)) - 1)[order]
    return row.tobytes().hex()


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Length of the shared chunks over that of the shorter set; two empty sets are alike."""
    if not a or not b:
        return float(len(a) == len(b))
    shared = sum(a[x] for x in a.keys() & b.keys())
    return shared / min(sum(a.values()), sum(b.values()))


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of the following text."""
    n = len(text) // 2
    return text[:len(text) - n] + following[:n]


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The next document is the one with the next smaller id, after the last the
    first; rows of one id follow each other by the MD5 of their texts, null ids
    come last. A document that is alone is its own neighbour. Null texts are
    empty. Ids are numbers.
    """
    import zstandard

    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).alias("id"))
    parts = shuffle_partitions(spark)
    n_ranges = 4 * parts
    bounds = ids.agg(F.percentile_approx("id", [k / n_ranges for k in range(1, n_ranges)], 100 * n_ranges).alias("q")).first()["q"]
    bounds = sorted(set(bounds or []))
    n_ranges = len(bounds) + 1

    def range_of(values: pa.Array) -> np.ndarray:
        """0 for the largest ids; null ids have a range of their own."""
        known = np.asarray(values.is_valid())
        out = np.full(len(values), n_ranges, np.int64)
        numbers = values.drop_null().to_numpy(zero_copy_only=False)
        out[known] = len(bounds) - np.searchsorted(bounds, numbers, "left")
        return out

    def with_range(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(range_of(b.column(0))), b.column(0)], ["rng", "id"])

    id_type = docs.schema[id_col].dataType
    # A row for each range: at most 4 x shuffle partitions.
    found = ids.mapInArrow(with_range, StructType([StructField("rng", LongType()), StructField("id", id_type)])) \
        .groupBy("rng").agg(F.max("id").alias("head")).orderBy("rng").collect()
    ranges = [(r["rng"], r["head"]) for r in found]
    before = {head: ranges[i - 1][0] for i, (_, head) in enumerate(ranges)}     # the head also goes to the range before

    def deal(batches):
        pressed = zstandard.ZstdCompressor()
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            own = range_of(b.column(0)).tolist()
            order, packed = [], []
            for t in texts:
                data = (t or "").encode()
                order.append(md5(data).hexdigest())
                packed.append(pressed.compress(data))
            copies = [i for i, k in enumerate(keys) if k in before]
            index = pa.array([*range(len(keys)), *copies], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([*own, *(before[keys[i]] for i in copies)], pa.int64()),
                 pa.array([0] * len(keys) + [1] * len(copies), pa.int32()), b.column(0).take(index),
                 pa.array(order).take(index), pa.array(packed, pa.binary()).take(index)],
                ["rng", "foreign", "id", "md5", "data"])

    def compare(batches):
        plain = zstandard.ZstdDecompressor()
        last = None                               # (range, foreign, id, text, fingerprint)
        for b in batches:
            out = []
            for rng, foreign, key, _, data in zip(*(c.to_pylist() for c in b.columns)):
                if foreign and (last is None or last[0] != rng or last[1]):
                    continue                      # only the first of the following range is wanted
                text = plain.decompress(data).decode()
                mine = fingerprint(text)
                if last is not None and last[0] == rng and not last[1]:
                    out.append(result(*last[2:], text, mine))
                last = (rng, foreign, key, text, mine)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def result(key, text, mine, following, other):
        changed = edited(text, following)
        theirs = fingerprint(changed)
        return (key, len(text), sha256(changed.encode()).hexdigest(), shown(mine), shown(theirs),
                likeness(mine, theirs), likeness(mine, other))

    from pyspark.sql.pandas.types import to_arrow_type
    schema = StructType([StructField("id", id_type), StructField("n_chars", LongType()),
                         *[StructField(c, StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")],
                         *[StructField(c, DoubleType()) for c in ("near_edited", "near_next")]])
    types, names = [to_arrow_type(f.dataType) for f in schema], schema.names
    dealt = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) \
        .mapInArrow(deal, StructType().add("rng", "long").add("foreign", "integer").add("id", id_type)
                    .add("md5", "string").add("data", "binary"))
    streams = dealt.repartition(parts, "rng").sortWithinPartitions("rng", "foreign", F.desc_nulls_last("id"), "md5")
    return streams.mapInArrow(compare, schema).withColumnRenamed("id", id_col)
