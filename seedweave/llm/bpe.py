"""Byte-level BPE encoding and decoding by tree concatenation.

Texts of up to ``LEAF_CHARS`` code points are encoded in one go. A longer text is
halved until its parts are that short; the parts are rows of their own, encoded by
different tasks, and then joined in pairs, level by level. At a join the tokens
next to the cut are decoded and encoded again together, in a window that doubles
until its first token equals the left half's token there and its last token the
right half's. A token row is the encoding of its text exactly if each pair of
neighbours is, so agreement at both ends proves the joined row; at worst the window
is the whole text.

The vocabulary is read from the tokenizer file given; the inner loop is the
``tiktoken`` library with these ranks, tests hold it against ``tokenizers``.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

LEAF_CHARS = 1 << 15
FIRST_WINDOW = 32          # tokens on each side of a cut
# Fixed value: how byte-level BPE splits text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """A byte-level BPE tokenizer file: ids of a text, bytes of ids."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True,
                                             "use_regex": True} or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        words = {w: i for w, i in model["vocab"].items() if w not in self.special}
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if any(words[a] >= words[b] for a, b in zip(joined, joined[1:])):
            raise ValueError(f"{path}: ids do not follow the order of the merges")
        ranks = {bytes(map(byte_of.__getitem__, w)): i for w, i in words.items()}
        self.tiktoken = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=self.special)
        self.bytes_of = [b""] * (1 + max([*ranks.values(), *self.special.values()]))
        for w, i in [*ranks.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.bytes_of[i] = w
        self.names = [str(i) for i in range(len(self.bytes_of))]
        self.longest_special = max((len(w.encode()) for w in self.special), default=0)

    def encode(self, text: str) -> list[int]:
        """Ids of a text that is short enough for one go."""
        if any(s in text for s in self.special):
            return self.tiktoken.encode(text, allowed_special="all")
        return self.tiktoken.encode_ordinary(text)

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the concatenation of two texts, from the ids of each."""
        if not left or not right:
            return left + right
        inside = lambda i: 0x80 <= self.bytes_of[i][0] < 0xC0  # noqa: E731  token starts within a character
        width = max(FIRST_WINDOW, self.longest_special)     # a special token cut in two is whole in the window
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            while a > 0 and inside(left[a]):
                a -= 1
            while b < len(right) and inside(right[b]):
                b += 1
            middle = self.encode(self.decode_bytes(left[a:] + right[:b]).decode())
            if (a == 0 or middle[0] == left[a]) and (b == len(right) or middle[-1] == right[b - 1]):
                return left[:a] + middle + right[b:]
            width *= 2

    def join_all(self, parts: list[list[int]]) -> list[int]:
        while len(parts) > 1:
            parts = [self.join(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def halves(text: str, most: int) -> list[str]:
    """``text`` halved until every part has at most ``most`` code points."""
    parts = 1
    while len(text) > parts * most:
        parts *= 2
    at = [len(text) * i // parts for i in range(parts + 1)]
    return [text[a:b] for a, b in zip(at, at[1:])]


def map_ids(docs: DataFrame, tokenizer: str, rows_of: Callable, fields: list[StructField], id_col: str = "doc_id",
            text_col: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``id_col`` and the ``fields`` of every row that ``rows_of(bpe, ids)`` yields for a document's ids.

    Null texts are empty. Texts are not shuffled, but for those over
    ``leaf_chars``; copies of such a text are encoded once. Rows with null or
    repeated ids are documents of their own. ``tokenizer`` is a file that every
    worker can read.
    """
    id_field = StructField("id", docs.schema[id_col].dataType)
    schema = StructType([id_field, *fields])
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"))

    def batch_of(keys: pa.Array, rows: list[list[tuple]], types: list[pa.DataType], names: list[str]):
        index = [i for i, r in enumerate(rows) for _ in r]
        flat = list(zip(*(x for r in rows for x in r))) or [()] * (len(names) - 1)
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(index, pa.int64())), *[pa.array(c, t) for c, t in zip(flat, types)]], names)

    def encode_short(batches):
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            rows = [list(rows_of(bpe, bpe.encode(t))) for t in batch.column(1).to_pylist()]
            yield batch_of(batch.column(0), rows, types, names)

    def split_long(batches):
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = halves(t, leaf_chars)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int32()),
                     pa.array(parts, pa.string())], ["key", "part", "text"])

    def encode_parts(batches):
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            ids = [np.array(bpe.encode(t), "<u4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())],
                                             ["key", "part", "ids"])

    def join_parts(table: pa.Table) -> pa.Table:
        bpe = byte_bpe(tokenizer)
        parts = sorted(zip(table.column("part").to_pylist(), table.column("ids").to_pylist()))
        ids = bpe.join_all([np.frombuffer(x, "<u4").tolist() for _, x in parts])
        key = table.column("key").combine_chunks().slice(0, 1)
        return pa.Table.from_batches([batch_of(key, [list(rows_of(bpe, ids))], types, ["key", *names[1:]])])

    from pyspark.sql.pandas.types import to_arrow_type
    types, names = [to_arrow_type(f.dataType) for f in fields], [f.name for f in schema]
    short = base.where(F.length("text") <= leaf_chars).mapInArrow(encode_short, schema)

    long = base.where(F.length("text") > leaf_chars).withColumn("key", F.md5(F.col("text").cast("binary")))
    parts = long.select("key", "text").mapInArrow(split_long, "key string, part int, text string") \
        .dropDuplicates(["key", "part"]).select("key", "part", "text")
    coded = parts.mapInArrow(encode_parts, StructType([
        StructField("key", StringType()), StructField("part", IntegerType()), StructField("ids", BinaryType())]))
    joined = coded.groupBy("key").applyInArrow(join_parts, StructType([StructField("key", StringType()), *fields]))
    whole = long.select("id", F.col("key").alias("own")).join(joined, F.col("own") == F.col("key"))
    out = short.unionByName(whole.select("id", *[f.name for f in fields]))
    return out.withColumnRenamed("id", id_col)


def ids_digest(bpe: ByteBpe, ids: list[int]):
    """n_tokens, SHA-256 of the ids and of the text decoded from them."""
    decoded = bpe.decode_bytes(ids).decode("utf-8", "replace")
    yield (len(ids), sha256(",".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest(),
           sha256(decoded.encode()).hexdigest())


def encode_digests(docs: DataFrame, tokenizer: str, **kw) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; an empty or null text has 0 tokens."""
    return map_ids(docs, tokenizer, ids_digest, [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
                                                 StructField("decoded_sha256", StringType())], **kw)


def encoded(docs: DataFrame, tokenizer: str, **kw) -> DataFrame:
    """doc_id and ``ids`` (little-endian unsigned 32-bit, as binary)."""
    return map_ids(docs, tokenizer, ids_binary, [StructField("ids", BinaryType())], **kw)


def ids_binary(bpe: ByteBpe, ids: list[int]):
    yield (np.array(ids, "<u4").tobytes(),)
