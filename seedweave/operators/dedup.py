"""Near-duplicate texts inside a group.

A text is dropped when an *earlier* text of the same group (by a total order) has
similarity ratio > 80 after rounding (i.e. > 80.5, Q11/Q12). The ratio is the indel
similarity ``100 * 2 * LCS / (len_a + len_b)``.

Identical texts go first, by an aggregate on the text. The ratio bounds the lengths of
a pair: the longer text has less than 1.485 times the characters of the shorter one. So
a group's texts are dealt to classes of length, each 1.5 times the last, and only texts of one
class or of two neighbouring ones meet. A class is dealt to blocks of about ``BLOCK`` texts by a
hash of the order, and every two blocks meet in a place of their own, so that no window,
task, row or shuffle ever holds a group. There, letter counts bound the common
subsequence of all pairs from above before any is computed. All bounds are exact.

Nothing exact spares the rest: as a fifth of all characters may differ, one in five
places, pairs need not share even three characters in a row.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

BLOCK = 2048
LENGTH_STEP = 1.5      # over 239 / 161, the largest ratio of two lengths within reach of the cut
LETTERS = 64           # letter counts are kept for so many classes of letters


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel (one big-int per row)."""
    if not a or not b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    n = len(a)
    full = (1 << n) - 1
    s = full
    for ch in b:
        u = s & masks.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return n - s.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    if total == 0:
        return 100.0
    return 200.0 * lcs_length(a, b) / total


def above_cut(lcs: int, len_a: int, len_b: int) -> bool:
    """ratio > 80.5 in integer form."""
    return 400 * lcs > 161 * (len_a + len_b)


_PLACE = ["_lo_class", "_lo_block", "_hi_class", "_hi_block"]


def _meeting(texts: DataFrame, group: str, order: list[str], text: str, block: int) -> DataFrame:
    """Every text once per block that it meets: its columns, ``_text``, the two blocks and whether it belongs to the second.

    Rows are sorted by group and blocks within partitions, so each place's rows follow each other.
    """
    t = F.coalesce(text, F.lit(""))
    length = F.floor(F.log(F.length("_text")) / F.log(F.lit(LENGTH_STEP)))
    own = texts.select(group, *order, t.alias("_text")).withColumn(
        "_class", F.when(F.length("_text") > 0, length).otherwise(-2).cast("long"))
    sizes = own.groupBy(group, "_class").agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
    # A row per group; as many entries as a group has classes of length.
    sizes = sizes.groupBy(F.col(group).alias("_g")).agg(F.map_from_entries(F.collect_list(F.struct("_class", "_blocks"))).alias("_sizes"))
    rows = own.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(*order), F.col("_sizes")[F.col("_class")]))
    me = {"class": F.col("_class"), "block": F.col("_block")}

    def places(step: int):
        other = F.col("_class") + step
        n = F.coalesce(F.try_element_at("_sizes", other), F.lit(0).cast("long"))
        blocks = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))

        def place(b):
            mine_first = F.lit(step > 0) if step else me["block"] <= b
            pick = lambda x, y: F.when(mine_first, x).otherwise(y)
            return F.struct(pick(me["class"], other).alias("_lo_class"), pick(me["block"], b).alias("_lo_block"),
                            pick(other, me["class"]).alias("_hi_class"), pick(b, me["block"]).alias("_hi_block"),
                            (~mine_first).alias("_second"))
        return F.transform(blocks, place)

    out = rows.withColumn("_p", F.explode(F.concat(places(-1), places(0), places(1)))).select(group, *order, "_text", "_p.*")
    # A fixed number: a place's work grows with its pairs, not with the bytes by which Spark would merge partitions.
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(n, group, *_PLACE).sortWithinPartitions(group, *_PLACE)


def _places(batches, group: str):
    """The rows of each place, as lists of dicts; holds one place at a time."""
    rows = (r for batch in batches for r in batch.to_pylist())
    for _, found in groupby(rows, key=lambda r: (r[group], *(r[c] for c in _PLACE))):
        yield list(found)


def _feasible_pairs(rows: list[dict], order: list[str], letters: bool = True):
    """(earlier, later) rows of a place, one of each block, whose lengths, then letters, leave the cut within reach."""
    same = all(rows[0][f"_lo_{x}"] == rows[0][f"_hi_{x}"] for x in ("class", "block"))
    first = rows if same else [r for r in rows if not r["_second"]]
    second = rows if same else [r for r in rows if r["_second"]]
    if not first or len(rows) < 2:
        return
    sizes = np.array([len(r["_text"]) for r in first])
    counts = np.stack([_letters(r["_text"]) for r in first]) if letters else None
    rank = lambda r: tuple((r[o] is not None, r[o]) for o in order)
    ranks = [rank(r) for r in first]
    for j, r in enumerate(second):
        n = len(r["_text"])
        common = np.minimum(counts, _letters(r["_text"])).sum(axis=1) if letters else np.minimum(sizes, n)
        mine = rank(r)
        for i in np.flatnonzero(400 * common > 161 * (sizes + n)).tolist():
            if not (same and i >= j):
                yield (first[i], r) if ranks[i] < mine else (r, first[i])


def _letters(text: str) -> np.ndarray:
    """How often each class of letters (code points by remainder) occurs."""
    return np.bincount(np.frombuffer(text.encode("utf-32-le"), "<u4") % LETTERS, minlength=LETTERS)


def similarities(texts: DataFrame, group: str, order: str, text: str, block: int = BLOCK) -> DataFrame:
    """X26 + J14: (group, a_ord, b_ord, ratio) of every pair whose lengths leave the cut within reach."""
    types = {f.name: f.dataType for f in texts.schema}
    schema = StructType([StructField(group, types[group]), StructField("a_ord", types[order]),
                         StructField("b_ord", types[order]), StructField("ratio", DoubleType())])
    arrow = to_arrow_schema(schema)

    def score(batches):
        for rows in _places(batches, group):
            out = [(a[group], a[order], b[order], indel_ratio(a["_text"], b["_text"]))
                   for a, b in _feasible_pairs(rows, [order], letters=False)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

    return _meeting(texts, group, [order], text, block).mapInArrow(score, schema)


def drop_near_duplicates(texts: DataFrame, group: str, order: list[str], text: str, block: int = BLOCK) -> DataFrame:
    """Rows of ``texts`` minus those with an earlier near-duplicate in their group.

    ``order`` must tell the rows of a group apart (a total order). Null texts count
    as empty.
    """
    own = drop_exact_duplicates(texts, group, order, text)
    schema = texts.select(group, *order).schema
    arrow = to_arrow_schema(schema)

    def later_ones(batches):
        for rows in _places(batches, group):
            gone = {}
            for a, b in _feasible_pairs(rows, order):
                if id(b) not in gone and above_cut(lcs_length(a["_text"], b["_text"]), len(a["_text"]), len(b["_text"])):
                    gone[id(b)] = b
            if gone:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in gone.values()], t) for c, t in zip(arrow.names, arrow.types)], schema=arrow)

    near = _meeting(own, group, order, text, block).mapInArrow(later_ones, schema).distinct()
    return own.join(near, [group, *order], "left_anti")


def drop_exact_duplicates(texts: DataFrame, group: str, order: list[str], text: str) -> DataFrame:
    """Keep the first of identical texts per group."""
    key = F.coalesce(F.col(text), F.lit(""))
    first = texts.groupBy(F.col(group).alias("_g"), F.xxhash64(key).alias("_h"), F.md5(key.cast("binary")).alias("_m")) \
        .agg(F.min(F.struct(*order)).alias("_first"))
    same = [F.col(group) == F.col("_g"), *[F.col(o) == F.col(f"_first.{o}") for o in order]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return texts.join(first, cond, "left_semi")


def drop_levenshtein_duplicates(texts: DataFrame, group: str, order: list[str], text: str) -> DataFrame:
    """P9 with edit-distance similarity 1 - lev / max_len > 0.8 in place of the indel ratio (built-in, SQL-checkable).

    Meant for groups of a few texts: pairs inside a group are joined.
    """
    own = texts.select(group, F.struct(*order).alias("_o"), F.coalesce(text, F.lit("")).alias("_t"))
    a = own.select(F.col(group).alias("_ga"), F.col("_o").alias("_oa"), F.col("_t").alias("_a"))
    longer = F.greatest(F.length("_a"), F.length("_t"))
    # The distance is at least the difference in length, and is not computed beyond the cut.
    pairs = own.join(a, (F.col(group) == F.col("_ga")) & (F.col("_oa") < F.col("_o"))
                     & (5 * F.abs(F.length("_a") - F.length("_t")) < longer))
    near = pairs.withColumn("_most", ((longer - 1) / 5).cast("int")) \
        .where(F.expr("levenshtein(_a, _t, _most) >= 0") & (longer > 0)).select(group, "_o").distinct()
    kept = own.select(group, "_o").join(near, [group, "_o"], "left_anti").select(F.col(group).alias("_g"), "_o")
    cond = F.col(group) == F.col("_g")
    for o in order:
        cond = cond & (F.col(o) == F.col(f"_o.{o}"))
    return texts.join(kept, cond, "left_semi")
