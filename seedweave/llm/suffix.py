"""Suffix-array deduplication by names of prefixes, in one doubling step.

Bytes covered by a string of ``length`` bytes that also starts elsewhere are removed.
Positions are named by their first ``length / 2`` bytes, then by the pair of names
at offset 0 and ``length / 2``, that is by their first ``length`` bytes; positions
whose name is unique leave. This departs from sorted ranks at growing offsets: a name
is a 64-bit hash of the bytes (equal for equal strings), which a sorted rank would
only be compared with for equality, so no order is made and there is one step.

Of the first step a sample is enough: in every string of ``length`` bytes the place
with the smallest name, which equal strings have in common. All strings that sample
the same place form a block (its bytes, and where in it the sample lies, have a name
too), and blocks settle most positions without a second step: where a rank has one
block only, every string of the block is repeated if the block is, and unique if not.
Only where a rank has several blocks are the single strings ranked: those of blocks
that occur once, and for comparison those of the others, sent by one holder each.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from seedweave.llm import names as N
from seedweave.llm.shared import written

# What a chunk is told about a block.
REPEATED, RANK, REPEATED_AND_SEND = 1, 2, 3


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which the name of any substring follows (up to SEGMENT and a window long)."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * N.powers(len(data)), out=out[1:])
    return out


def ranks(sums: np.ndarray, length: int) -> np.ndarray:
    """Names of all substrings of that length."""
    n = len(sums) - length
    return N.mix((sums[length:] - sums[:n]) * N.powers(n, inverse=True))


def blocks(data: bytes, length: int):
    """For every segment: its start, the sampled ranks, and per sample the first and last string and the block's name."""
    half = (length + 1) // 2
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, max(len(data) - length + 1, 0), N.SEGMENT):
        sums = prefix_sums(whole[at:at + N.SEGMENT + length - 1])
        rank = ranks(sums, half)
        sample = N.sliding_argmin(rank, length - half + 1)
        first = N.first_of_group(sample)
        last = np.append(first[1:], len(sample)) - 1
        place, end = sample[first], last + length
        shape = N.mix((end - first).astype(np.uint64) * N.A + (place - first).astype(np.uint64))
        block = N.mix((sums[end] - sums[first]) * N.powers(int(first[-1]) + 1, inverse=True)[first] ^ shape)
        yield at, rank[place], first, last, block


def string_ranks(data: bytes, stretch: np.ndarray, length: int):
    """(start, name, second name) of the strings that begin in each stretch: the pair of ranks half a length apart."""
    half = (length + 1) // 2
    whole = np.frombuffer(data, np.uint8)
    for a, b in stretch.tolist():
        for at in range(a, b, N.SEGMENT):
            rank = ranks(prefix_sums(whole[at:min(at + N.SEGMENT, b) + length - 1]), half)
            left, right = rank[:len(rank) - (length - half)], rank[length - half:]
            yield at, N.pair(left, right), N.mix(left * N.B + right) >> np.uint64(32)


def settle_blocks(table: pa.Table) -> pa.Table:
    """First step, for the ranks of one range."""
    chunk, more, rank, block = N.unpacked(table, "u8")
    times = 1 + more.astype(np.int64)
    by_rank, by_block = N.first_of_group(rank), N.first_of_group(rank, block)
    n_rank = np.diff(np.append(by_rank, len(rank)))
    n_block = np.diff(np.append(by_block, len(rank)))
    seen = np.repeat(np.add.reduceat(times, by_rank), n_rank)
    own = np.repeat(np.add.reduceat(times, by_block), n_block)
    new = np.zeros(len(rank), np.int64)
    new[by_block] = 1
    several = np.repeat(np.add.reduceat(new, by_rank), n_rank) > 1
    state = np.where(~several | (own > 1), REPEATED, RANK)
    state[several & (own > 1) & (new == 1)] = REPEATED_AND_SEND
    kept = seen > 1
    return N.answers(chunk[kept], block[kept], state[kept])


def digest_of_kept(data: bytes, mask: np.ndarray | None):
    kept = data if mask is None else np.frombuffer(data, np.uint8)[~mask].tobytes()
    return sha256(kept).hexdigest()


def text_of_kept(data: bytes, mask: np.ndarray | None):
    """The remaining bytes as text; parts of a character whose other bytes are gone are left out."""
    kept = data if mask is None else np.frombuffer(data, np.uint8)[~mask].tobytes()
    return kept.decode("utf-8", "ignore")


def remove_repeated_strings(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text",
                            finish=digest_of_kept, column: str = "kept_sha256", chunk_bytes: int | None = None) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and ``column`` of every row of ``docs``.

    ``finish(data, mask)`` makes the column (a string) from the UTF-8 bytes and the
    mask of the removed ones (None: none): a digest, or ``text_of_kept``. Null
    texts are empty. Every row is a document of its own, also if ids repeat or are
    null; repeated rows remove each other's strings. Strings never cross documents and
    are judged on the input. Very long texts are named ``SEGMENT`` bytes at a time,
    without a limit. Other columns of ``docs`` are not read, whatever their names. An
    empty table gives an empty table with the same columns.
    """
    if length < 2:
        raise ValueError("length must be at least 2")
    base, n_chunks = N.chunked_documents(docs, id_col, text_col, chunk_bytes)
    id_type = base.schema["id"].dataType
    counted = StructType([StructField("id", id_type), *[StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")],
                          StructField(column, StringType())])
    split = StructType([StructField("open", BooleanType()), *counted, StructField("chunk", LongType()),
                        *[StructField(c, BinaryType()) for c in ("data", "repeated", "rank", "send")]])

    def sampled(batches):
        import zstandard
        plain = zstandard.ZstdDecompressor()
        box = N.Outbox(n_chunks, "u8")
        for b in batches:
            for z, chunk in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for _, rank, _, _, block in blocks(plain.decompress(z), length):
                    box.put(chunk, rank, block)
                if box.size >= N.FLUSH:
                    yield from box.flush()
        yield from box.flush()

    def result(data: bytes, stretches: np.ndarray, starts: np.ndarray):
        if not len(stretches) and not len(starts):
            return len(data), 0, 0, finish(data, None)
        mask = N.covered(starts, length, len(data), stretches)
        return len(data), int(mask.sum()), len(N.runs(mask)), finish(data, mask)

    def settle(docs_table: pa.Table, answer: pa.Table) -> pa.Table:
        """Documents whose blocks settle every string are done; the others keep their stretches of strings."""
        import zstandard
        plain = zstandard.ZstdDecompressor()
        known, states = N.told(answer)
        none, rows = np.zeros((0, 2), np.int64), []
        for z, chunk in zip(docs_table.column("data").to_pylist(), docs_table.column("chunk").to_pylist()):
            data = plain.decompress(z)
            found = {REPEATED: [none], RANK: [none], REPEATED_AND_SEND: [none]}
            for at, _, first, last, block in blocks(data, length) if len(known) else ():
                place = N.found_in(block, known)
                state = np.where(place >= 0, states[place], 0)
                for s in found:
                    found[s].append(np.stack((first[state == s] + at, last[state == s] + 1 + at), 1))
            found = {s: merged(np.concatenate(x)) for s, x in found.items()}
            repeated = merged(np.concatenate((found[REPEATED], found[REPEATED_AND_SEND])))
            if len(found[RANK]) or len(found[REPEATED_AND_SEND]):
                rows.append((True, None, None, None, None, chunk, z,
                             *(x.astype("<i8").tobytes() for x in (repeated, found[RANK], found[REPEATED_AND_SEND]))))
            else:
                rows.append((False, *result(data, repeated, np.zeros(0, np.int64)), *[None] * 5))
        types = [pa.bool_(), *[pa.int64()] * 3, pa.string(), pa.int64(), *[pa.binary()] * 4]
        cols = N.columns_of(rows, types)
        return pa.table([cols[0], docs_table.column("id").combine_chunks(), *cols[1:]], split.names)

    def merged(stretches: np.ndarray) -> np.ndarray:
        """Stretches in order, adjacent ones joined (they do not overlap)."""
        if len(stretches) < 2:
            return stretches
        x = stretches[np.argsort(stretches[:, 0], kind="stable")]
        begin = np.concatenate(([True], x[1:, 0] != x[:-1, 1]))
        return np.stack((x[begin, 0], x[np.append(begin[1:], True), 1]), 1)

    stretches_of = lambda x: np.frombuffer(x, "<i8").reshape(-1, 2)

    def paired(batches):
        import zstandard
        plain = zstandard.ZstdDecompressor()
        box = N.Outbox(n_chunks, "u4")
        for b in batches:
            for z, rank, send, chunk in zip(*(c.to_pylist() for c in b.columns)):
                data = plain.decompress(z)
                for x in (rank, send):
                    for _, name, second in string_ranks(data, stretches_of(x), length):
                        box.put(chunk, name, second)
                if box.size >= N.FLUSH:
                    yield from box.flush()
        yield from box.flush()

    def remove(docs_table: pa.Table, answer: pa.Table) -> pa.Table:
        import zstandard
        plain = zstandard.ZstdDecompressor()
        known, _ = N.told(answer)
        rows = []
        for z, repeated, rank in zip(*(docs_table.column(c).to_pylist() for c in ("data", "repeated", "rank"))):
            data = plain.decompress(z)
            starts = [at + np.flatnonzero(N.found_in(name, known) >= 0)
                      for at, name, _ in string_ranks(data, stretches_of(rank), length)]
            rows.append(result(data, stretches_of(repeated), np.concatenate([np.zeros(0, np.int64), *starts])))
        cols = N.columns_of(rows, [pa.int64()] * 3 + [pa.string()])
        return pa.table([docs_table.column("id").combine_chunks(), *cols], counted.names)

    first = N.ask(base.select("data", "chunk").mapInArrow(sampled, N.Outbox.SCHEMA), settle_blocks)
    level = written(base.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(settle, split), "suffixes")
    waiting = level.where("open")
    second = N.ask(waiting.select("data", "rank", "send", "chunk").mapInArrow(paired, N.Outbox.SCHEMA), N.repeated("u4"))
    removed = waiting.select("id", "chunk", "data", "repeated", "rank").groupBy("chunk") \
        .cogroup(second.groupBy("chunk")).applyInArrow(remove, counted)
    return level.where("NOT open").select(*counted.names).unionByName(removed).withColumnRenamed("id", id_col)


def without_repeated_strings(docs: DataFrame, length: int = 200, text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text``, and ``n_chars`` (if there) counted anew."""
    others = [c for c in docs.columns if c != text_col]
    keyed = docs.select(F.struct(*[F.col(c) for c in others]).alias("row"), text_col)
    out = remove_repeated_strings(keyed, length, "row", text_col, text_of_kept, "kept")
    cols = {c: F.col("row")[c] for c in others} | {text_col: F.col("kept")}
    if "n_chars" in cols:
        cols["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return out.select(*[cols[c].alias(c) for c in docs.columns])
