"""Lookup, mapping and tag-graph operators."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from seedweave.functions.text import split_trim


def lookup_map_column(spark, pairs):
    """A literal map key -> sorted array of values, for small fixed mappings."""
    grouped: dict[str, list] = {}
    for k, v in pairs:
        grouped.setdefault(k, []).append(v)
    if not grouped:
        return F.create_map().cast("map<string,array<string>>")
    args = []
    for k in sorted(grouped):
        args += [F.lit(k), F.array(*[F.lit(v) for v in sorted(grouped[k])])]
    return F.create_map(*args)


def not_yet_done(todo: DataFrame, done: DataFrame, key: str, null_aware: bool = False) -> DataFrame:
    """Rows of ``todo`` whose key is not in ``done``.

    Default is a left anti join on non-null keys. ``null_aware=True`` keeps the
    SQL ``NOT IN`` meaning (nothing survives if ``done`` holds a NULL, Q20).
    """
    d = done.select(key).where(F.col(key).isNotNull())
    left = todo.join(d, key, "left_anti")
    if not null_aware:
        return left
    # NOT IN an empty set holds for every row; a NULL on either side of a non-empty set is never "not in".
    nulls = done.agg(F.count(F.when(F.col(key).isNull(), 1))).scalar()
    rows = done.agg(F.count(F.lit(1))).scalar()
    return left.where((rows == 0) | ((nulls == 0) & F.col(key).isNotNull()))


def min_id_per_key(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """The row with the smallest id per key, as a semi join on the min ids."""
    mins = df.groupBy(key).agg(F.min(id_col).alias(id_col))
    return df.join(mins.select(id_col), id_col, "left_semi")


def explode_list_map(df: DataFrame, id_col: str, list_col: str, mapping: DataFrame,
                     sep: str = ",", key: str = "key", value: str = "value") -> DataFrame:
    """One row per (id, mapped value); duplicates kept."""
    items = df.select(id_col, F.explode(split_trim(list_col, sep)).alias(key))
    m = mapping.select(key, value)
    return items.join(m, key).select(id_col, value)


def left_join_checked(left: DataFrame, right: DataFrame, key: str, columns: list[str] | None = None,
                      every_key: bool = False) -> DataFrame:
    """Left join that fails, when it runs, on fan-out (duplicate keys on the right).

    ``columns`` states the columns the right side must have (checked at once);
    ``every_key`` makes a left row without a partner fail too. Nothing runs while
    the plan is built.
    """
    if columns is not None and sorted(right.columns) != sorted(columns):
        raise ValueError(f"right side has columns {right.columns}, not {columns}")
    others = [c for c in right.columns if c != key]
    one = right.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in others])
    wrong = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"left join on {key} would fan out at "), F.col(key).cast("string"))))
    if every_key:
        wrong = F.when(F.col("_n").isNull(), F.raise_error(F.concat(F.lit(f"no row on the right for {key} "), F.col(key).cast("string")))) \
            .otherwise(wrong)
    # The check is part of the first added column (or of the key), so it can't be pruned away.
    out = left.join(one, key, "left")
    checked = others[0] if others else key
    kind = out.schema[checked].dataType
    return out.withColumn(checked, F.coalesce(wrong.cast(kind), F.col(checked))).drop("_n")


def distinct_mapped_list(df: DataFrame, id_col: str, list_col: str, mapping: DataFrame,
                         sep: str = ",", key: str = "key", value: str = "value") -> DataFrame:
    """Sorted distinct mapped labels per row; rows without a hit get []."""
    hits = explode_list_map(df, id_col, list_col, mapping, sep, key, value)
    agg = hits.groupBy(id_col).agg(F.array_sort(F.collect_set(value)).alias("labels"))
    out = df.select(id_col).join(agg, id_col, "left")
    return out.select(id_col, F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def expand_links(pairs: DataFrame, links: DataFrame, key: str, node: str, hops: int = 1) -> DataFrame:
    """Add nodes linked from the given ones, ``hops`` times (one hop by default)."""
    e = links.select(F.col("src").alias(node), "dst")
    cur = pairs.select(key, node).distinct()
    frontier = cur
    for _ in range(hops):
        nxt = frontier.join(e, node).select(key, F.col("dst").alias(node))
        cur = cur.unionByName(nxt).distinct()
        frontier = nxt
    return cur


def external_votes(clients: DataFrame, external: DataFrame, key: str, label: str, weight: int) -> DataFrame:
    """Every (client, label) with the external weight, 0 when absent."""
    ext = external.select(key, label).distinct().withColumn("w", F.lit(weight))
    return clients.join(ext, [key, label], "left").select(key, label, F.coalesce("w", F.lit(0)).alias("weight"))


KEYWORD_CHARS = 2 << 20     # letters of the keywords in one automaton (some 100 MB of nodes)


@lru_cache(maxsize=1)
def _automaton(words: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(w, w)
    found.make_automaton()
    return found


def keyword_containment(texts: DataFrame, text_col: str, keywords: DataFrame, kw_col: str = "kw",
                        most_chars: int = KEYWORD_CHARS) -> DataFrame:
    """(text row, keyword row) for every keyword that is a substring of the text.

    The distinct keywords make an Aho-Corasick automaton, which reads every text once, batch
    by batch, so the work is linear in the texts and the hits, and no text is moved or cut up.
    Keywords with more than ``most_chars`` letters in all are dealt to several automata of that
    size, each with a scan of its own: what a task or the driver holds has that bound.
    Null and empty keywords and null texts match nothing.
    """
    words = keywords.select(F.col(kw_col).alias("w")).where(F.length("w") > 0).distinct()
    letters = words.agg(F.sum(F.length("w")).alias("n")).first()["n"] or 0
    parts = max(1, -(-letters // most_chars))
    schema = StructType([*texts.schema, StructField("_hit", StringType())])
    at, out = texts.columns.index(text_col), None
    for p in range(parts):
        mine = words.where(F.pmod(F.xxhash64("w"), F.lit(parts)) == p) if parts > 1 else words
        sent = texts.sparkSession.sparkContext.broadcast(tuple(r["w"] for r in mine.collect()))     # at most about ``most_chars`` letters

        def scan(batches, sent=sent):
            found = _automaton(sent.value) if sent.value else None
            for batch in batches:
                if found is None:
                    continue
                hits = [sorted({w for _, w in found.iter(t)}) if t else () for t in batch.column(at).to_pylist()]
                rows = pa.array([i for i, h in enumerate(hits) for _ in h], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*batch.take(rows).columns, pa.array([w for h in hits for w in h], pa.string())], [f.name for f in schema])

        found = texts.mapInArrow(scan, schema)
        out = found if out is None else out.unionByName(found)
    return out.join(keywords, F.col("_hit") == F.col(kw_col)).drop("_hit")


def tag_frequency(df: DataFrame, list_col: str, sep: str = ",") -> DataFrame:
    """(tag, n) over a delimited list column."""
    return df.select(F.explode(split_trim(list_col, sep)).alias("tag")).groupBy("tag").agg(
        F.count(F.lit(1)).alias("n"))


def tag_category_pairs(df: DataFrame, id_col: str, tags_col: str, categories: DataFrame,
                       sep: str = ",") -> DataFrame:
    """Co-occurrence counts of (tag, category) inside a row (a tag with itself included).

    Instead of a self join of the exploded list (quadratic in the list length)
    we join each tag to the categories present in the same row: the row's
    category set is computed in the row, so nothing is shuffled before the count.
    """
    cats = categories.select(F.col("category"))
    cat_arr = F.array_distinct(split_trim(tags_col, sep))
    rows = df.select(id_col, split_trim(tags_col, sep).alias("tags"), cat_arr.alias("present"))
    exploded = rows.select(id_col, "present", F.explode("tags").alias("tag"))
    with_cat = exploded.select(id_col, "tag", F.explode("present").alias("category"))
    with_cat = with_cat.join(cats, "category", "left_semi")
    return with_cat.groupBy("tag", "category").agg(F.count(F.lit(1)).alias("n"))


def concat_distinct_lists(df: DataFrame, key: str, list_col: str) -> DataFrame:
    """Per key, the sorted distinct union of all lists.

    Doubles go before anything is collected: a key's list holds each value once,
    however many rows the key has. Nulls in a list are left out.
    """
    values = df.select(key, F.explode_outer(list_col).alias("_v")).distinct()
    return values.groupBy(key).agg(F.sort_array(F.collect_set("_v")).alias(list_col))
