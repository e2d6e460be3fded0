"""Best-fit packing of token pieces into sequences by the sum of squares.

A piece goes into the open sequence (or a new one) for which the sum over gaps g
of N(g)^2 becomes smallest, N(g) being the number of open sequences with g tokens
left. Pieces as long as a sequence are sequences of their own; only shorter ones
are placed. A hash of their row number deals them into groups of about ``GROUP`` pieces,
each packed by one task; a group leaves a handful of sequences open, so groups cost a
share of sequences that does not depend on the size of the input.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField

from seedweave.llm.bpe import map_ids
from seedweave.llm.shared import written

LENGTH = 2048
END_ID = 0
GROUP = 100_000


def sum_of_squares(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every length in the order given; ties go to the smallest gap, and to an open bin."""
    n_open = np.zeros(room + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(room + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    never, made = np.iinfo(np.int64).max, 0
    for i, s in enumerate(lengths.tolist()):
        now = n_open[s:room]                       # gaps s .. room - 1
        change = np.where(now > 0, -2 * now + 1, never)
        change[1:] += np.where(now[1:] > 0, 2 * n_open[1:room - s] + 1, 0)
        gap = s + int(change.argmin()) if len(change) else room
        fresh = 2 * n_open[room - s] + 1 if s < room else 0
        if gap < room and change[gap - s] <= fresh:
            b = stacks[gap].pop()
            n_open[gap] -= 1
        else:
            gap, b, made = room, made, made + 1
        bins[i], offsets[i] = b, room - gap
        if gap > s:
            n_open[gap - s] += 1
            stacks[gap - s].append(b)
    return bins, offsets


def document_pieces(length: int):
    """Rows (piece, start, length, ids_crc32) of a document's ids and the end id; the first piece may be shorter."""
    def rows(bpe, ids):
        ids = np.array([*ids, END_ID], "<u4")
        cuts = [0, *range(len(ids) % length or length, len(ids) + 1, length)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            yield k, a, b - a, zlib.crc32(ids[a:b].tobytes())
    return rows


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``pieces`` (any columns with ``length``) with ``sequence_id`` and ``offset``; lengths must be 1..``length``.

    Equal rows are pieces of their own. An empty table stays empty. Input columns named
    ``sequence_id``, ``offset``, ``_pack_row`` or ``_pack_group`` are replaced or left out.
    """
    pieces = pieces.drop("sequence_id", "offset", "_pack_row", "_pack_group")
    fixed = written(pieces.withColumn("_pack_row", F.monotonically_increasing_id()), "pieces")
    full = fixed.where(F.col("length") == length)
    part = fixed.where(F.col("length") < length)
    groups = max(1, math.ceil(part.count() / group))
    schema = part.drop("_pack_row").schema.add("sequence_id", "long").add("offset", "long")

    def pack_group(table: pa.Table) -> pa.Table:
        # Longest first; the row number makes the order total.
        order = np.lexsort((table.column("_pack_row").to_numpy(), -table.column("length").to_numpy()))
        table = table.take(pa.array(order))
        bins, offsets = sum_of_squares(table.column("length").to_numpy(), length)
        base = int(table.column("_pack_group")[0].as_py()) << 32
        out = table.drop_columns(["_pack_row", "_pack_group"])
        return out.append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets))

    packed = part.withColumn("_pack_group", F.pmod(F.xxhash64("_pack_row"), F.lit(groups))) \
        .groupBy("_pack_group").applyInArrow(pack_group, schema)
    own = full.withColumn("sequence_id", F.col("_pack_row") + F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(own.drop("_pack_row"))


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of ``docs`` is a document; an empty or null text is the end id alone.
    """
    fields = [StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()),
              StructField("ids_crc32", LongType())]
    return pack(map_ids(docs, tokenizer, document_pieces(length), fields), length, group)
