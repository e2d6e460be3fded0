"""SimHash near-duplicates by a byte-position index with count filtering.

Two 64-bit fingerprints that differ in at most two bits differ in at most two of
their eight bytes, so the tally of shared positional bytes is six or more. A pair
reaches that tally exactly if it shares one of the 28 choices of six positions, so
the index is kept on those: a posting list holds the fingerprints with the same six
bytes, and pairs below the minimum never come up. A list has at most 2**16 members,
whatever the input, since only two bytes are free in it.

Lists are verified without going through their pairs: two fingerprints are at most
two bits apart exactly if some word is at most one bit from both, so every member
names itself and its one-bit neighbours within the free bytes, and those who name
the same word (at most 65) are linked. Groups come from alternating star steps.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from seedweave.llm.shared import parts_for, written

MEMBERS = 1 << 16          # posting list members whose neighbours one task names
BLOCK = 1 << 18            # shingles hashed at once, to bound memory on very long texts


def simhash(text: str | None, shingle: int = 3) -> int:
    """Unsigned fingerprint: a bit is set if it is in over half of the shingles' XXH64 (seed 42); no words: 0."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()       # ASCII letters and ASCII spaces only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = words[at:min(at + BLOCK, n) + shingle - 1]
        grams = zip(*(part[k:] for k in range(shingle))) if len(words) >= shingle else [words]
        h = np.fromiter((xxh64_intdigest(b" ".join(g), 42) for g in grams), "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, name: str, text: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` with the signed 64-bit fingerprint of ``text`` as last column ``name``."""
    at = docs.columns.index(text)

    def add(batches):
        for batch in batches:
            fp = np.array([simhash(t, shingle) for t in batch.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp)], [*batch.schema.names, name])

    return docs.mapInArrow(add, StructType([*docs.schema.fields]).add(name, LongType()))


def linked_fingerprints(fps: DataFrame, bits: int = 2) -> DataFrame:
    """Edges (u, v), u > v, that connect exactly the fingerprints ``fp`` (distinct) reachable at ``bits`` or fewer differing bits.

    ``bits`` is 1 or 2.
    """
    if bits not in (1, 2):
        raise ValueError("bits must be 1 or 2")
    whole = (1 << 64) - 1
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    free = list(combinations(range(8), 2))                    # the two positions that may differ
    masks = [signed(whole & ~(0xFF << 8 * i) & ~(0xFF << 8 * j)) for i, j in free]
    kept = F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("six"))
                     for c, m in enumerate(masks)])
    lists = fps.select("fp", F.explode(kept).alias("k")).groupBy("k.c", "k.six") \
        .agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    flips = F.array(*[F.array(*[F.lit(signed(1 << b)) for i in pair for b in range(8 * i, 8 * i + 8)]) for pair in free])
    # Members grow 17-fold next, so they are dealt out by their number, not by their size now.
    member = written(lists.select("c", F.explode("fps").alias("fp")), "index-members")
    member = member.repartition(parts_for(member.count(), MEMBERS, 1))
    if bits == 1:
        # One bit apart: the word with the bit cleared is one of the two.
        named = F.transform(flips[F.col("c")], lambda f: F.col("fp").bitwiseAND(F.bitwise_not(f)))
    else:
        named = F.concat(F.array("fp"), F.transform(flips[F.col("c")], lambda f: F.col("fp").bitwiseXOR(f)))
    meet = member.select("fp", F.explode(named).alias("word")).groupBy("word") \
        .agg(F.sort_array(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)   # at most 65
    if bits == 1:
        meet = meet.where(F.array_contains("fps", F.col("word")))
        return meet.select(F.explode("fps").alias("u"), F.col("word").alias("v")).where("u <> v") \
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    return meet.select(F.explode("fps").alias("u"), F.col("fps")[0].alias("v")).where("u > v").distinct()


def star_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u > v): root is the smallest node reachable.

    Alternating large-star and small-star steps; each round is written to the
    shared folder. No node's neighbours are collected: minima are aggregated and
    joined back, which Spark can split where one node has very many.
    """
    def state(e):
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    edges = written(edges, "edges")
    last = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")) \
            .select("c", F.least("c", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where("u <> v").distinct()
        low = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where("u <> v").unionByName(low.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()
        edges = written(small, "edges")
        now = state(edges)
        if now == last:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        last = now


def near_duplicate_groups(rows: DataFrame, id_col: str, fp_col: str, bits: int = 2) -> DataFrame:
    """(fp, component_id, first_fp) for every distinct fingerprint of ``rows``.

    component_id is the smallest id of the group (null only if all are null),
    first_fp the smallest fingerprint that has it: both pick the group's first row.
    """
    own = written(rows.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("id")), "fingerprints")
    roots = star_components(linked_fingerprints(own.select("fp"), bits))
    rooted = own.join(roots, F.col("fp") == F.col("node"), "left") \
        .select("fp", "id", F.coalesce("root", "fp").alias("root"))
    first = F.struct(F.col("id").isNull().alias("no"), F.col("id"), F.col("fp"))
    comp = rooted.groupBy(F.col("root").alias("of")).agg(F.min(first).alias("x"))
    return rooted.join(comp, F.col("root") == F.col("of")) \
        .select("fp", F.col("x.id").alias("component_id"), F.col("x.fp").alias("first_fp"))


def simhash_components(docs: DataFrame, shingle: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``docs``.

    Texts without words (null, empty) have fingerprint zero and are linked like
    any other. Rows with null or repeated ids are rows of their own; a group whose ids
    are all null has a null component_id. Very long texts are hashed ``BLOCK`` shingles
    at a time, without a limit. Other columns of ``docs`` are not read, whatever their
    names. An empty table gives an empty table with the same columns.
    """
    rows = written(with_fingerprints(docs.select("doc_id", "text"), "fp", shingle=shingle).drop("text"), "simhash")
    groups = near_duplicate_groups(rows, "doc_id", "fp", bits).withColumnRenamed("fp", "own")
    return rows.join(groups, F.col("fp") == F.col("own")) \
        .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, shingle: int = 3, bits: int = 2) -> DataFrame:
    """One document of each group, with the columns of ``docs``: the one with the smallest id.

    Of rows that are equal in id and text one stays, of rows that are equal in id and
    fingerprint that with the smallest hash of id and text. Texts are fingerprinted
    where they are read and move once, to meet the keys of those that stay; copies
    have ids, and so keys, of their own.
    """
    text = F.coalesce("text", F.lit(""))
    key = ["_simhash_k1", "_simhash_k2"]               # 128 bits of id and text, never null
    keyed = docs.withColumns({key[0]: F.xxhash64("doc_id", text), key[1]: F.xxhash64(text, "doc_id")})
    rows = written(with_fingerprints(keyed.select("doc_id", "text", *key), "fp", shingle=shingle).drop("text"), "simhash")
    first = near_duplicate_groups(rows, "doc_id", "fp", bits).where("fp = first_fp") \
        .select(F.col("fp").alias("_fp"), F.col("component_id").alias("_id"))
    keep = rows.join(first, (F.col("fp") == F.col("_fp")) & F.col("doc_id").eqNullSafe(F.col("_id"))) \
        .groupBy("_fp").agg(F.min(F.struct(*key)).alias("k")).select("k.*")
    return keyed.join(written(keep, "simhash-keep"), key, "left_semi").dropDuplicates(key).select(*docs.columns)
