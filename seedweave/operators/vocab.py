"""Vocabulary, token ids and the document tensor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedweave.functions.text import explode_nonempty, filter_tokens, sentences
from seedweave.operators.windows import global_index


# Words that a join by words may keep on every executor.
FREQUENT_WORDS = 1 << 16
INDEX_BITS = (1 << 32) - 1


def token_rows(docs: DataFrame, tokens, id_col: str = "doc_id") -> DataFrame:
    return explode_nonempty(docs, tokens, "word", F.col(id_col).alias("doc_id"), with_pos="pos")


def _first_seen(docs: DataFrame, tokens, id_col: str, *aggregates) -> DataFrame:
    """(word, aggregates over its tokens, first_seen): the least (doc_id, pos) of every word.

    The least of a struct makes Spark sort all tokens; integer ids whose range has up to 31
    bits go with the position into one number instead, whose least is kept in a hash table.
    """
    t = token_rows(docs, tokens, id_col)
    kind = dict(t.dtypes)["doc_id"]
    low = None
    if kind in ("smallint", "int", "bigint"):
        ids = F.col(id_col).cast("decimal(20,0)")
        r = docs.agg(F.min(ids).alias("low"), F.max(ids).alias("high"), F.count_if(F.col(id_col).isNull()).alias("nulls")).first()
        if r["low"] is not None and not r["nulls"] and r["high"] - r["low"] < 1 << 31:
            low = int(r["low"])
    if low is None:
        return t.groupBy("word").agg(*aggregates, F.min(F.struct("doc_id", "pos")).alias("first_seen"))
    place = F.shiftleft(F.col("doc_id").cast("long") - F.lit(low).cast("long"), 32) + F.col("pos")
    v = t.groupBy("word").agg(*aggregates, F.min(place).alias("_place"))
    first = F.struct((F.shiftright("_place", 32) + F.lit(low).cast("long")).cast(kind).alias("doc_id"),
                     F.col("_place").bitwiseAND(INDEX_BITS).cast("int").alias("pos"))
    return v.withColumn("first_seen", first).drop("_place")


def vocabulary(docs: DataFrame, tokens, id_col: str = "doc_id", max_words: int | None = None) -> DataFrame:
    """(word, tf, first_seen, idx); idx 1-based by frequency, first seen on ties."""
    v = _first_seen(docs, tokens, id_col, F.count(F.lit(1)).alias("tf"))
    v = global_index(v, [F.desc("tf"), F.asc("first_seen"), F.asc("word")], "idx", start=1)
    if max_words is not None:  # T6: keep indices below the cut
        v = v.where(F.col("idx") < max_words)
    return v


def first_seen_index(docs: DataFrame, tokens, id_col: str = "doc_id", start: int = 0) -> DataFrame:
    """Index of words in order of first appearance."""
    v = _first_seen(docs, tokens, id_col)
    return global_index(v, [F.asc("first_seen"), F.asc("word")], "idx", start=start)


def to_indices(docs: DataFrame, tokens, vocab: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<long>) in token order; unknown words are skipped.

    Words with an index up to ``FREQUENT_WORDS`` (most tokens) are looked up where the text is read;
    only the tokens of others are shuffled to meet the rest of the vocabulary. A token is one
    number (position, then index), which is cheaper to collect and sort than a struct.
    """
    t = token_rows(docs, tokens, id_col)
    v = vocab.select("word", "idx")
    known, rest = F.broadcast(v.where(F.col("idx") <= FREQUENT_WORDS)), v.where(F.col("idx") > FREQUENT_WORDS)
    rare = t.join(known.select("word"), "word", "left_anti").join(rest, "word")
    j = t.join(known, "word").unionByName(rare)
    fits = F.col("idx").between(0, INDEX_BITS)
    item = F.when(fits, F.shiftleft(F.col("pos").cast("long"), 32) + F.col("idx")).otherwise(
        F.raise_error(F.lit("indices must be 0 to 2^32 - 1")).cast("long"))
    agg = j.groupBy("doc_id").agg(F.collect_list(item).alias("items"))
    return agg.select("doc_id", F.transform(F.sort_array("items"), lambda i: i.bitwiseAND(INDEX_BITS)).alias("ids"))


def doc_tensor(docs: DataFrame, vocab: DataFrame, text_col: str = "text", id_col: str = "doc_id",
               max_sentences: int = 15, max_len: int = 100) -> DataFrame:
    """X11: first ``max_sentences`` sentences x last ``max_len`` ids, zeros on the left.

    Missing sentences are zero rows; a sentence without known words is a zero row.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.lower(text_col).alias("text"))
    sents = d.select("doc_id", F.posexplode(sentences("text")).alias("s", "sentence")).where(F.col("s") < max_sentences)
    toks = sents.select("doc_id", "s", F.posexplode(filter_tokens("sentence", lower=False)).alias("pos", "word"))
    v = vocab.select("word", "idx")
    ids = (toks.join(v, "word").groupBy("doc_id", "s")
           .agg(F.collect_list(F.struct("pos", "idx")).alias("items"))
           .select("doc_id", "s", F.transform(F.array_sort("items"), lambda x: x["idx"]).alias("ids")))
    rows = sents.select("doc_id", "s").join(ids, ["doc_id", "s"], "left")
    ids_col = F.coalesce(F.col("ids"), F.array().cast("array<long>"))
    last = F.when(F.size(ids_col) > max_len, F.slice(ids_col, -max_len, max_len)).otherwise(ids_col)
    padded = F.concat(F.array_repeat(F.lit(0).cast("long"), F.lit(max_len) - F.size(last)), last)
    rows = rows.select("doc_id", "s", padded.alias("row"))
    per_doc = rows.groupBy("doc_id").agg(F.collect_list(F.struct("s", "row")).alias("items"))
    per_doc = per_doc.select("doc_id", F.transform(F.array_sort("items"), lambda x: x["row"]).alias("rows"))
    zero_row = F.array_repeat(F.lit(0).cast("long"), max_len)
    full = d.select("doc_id").join(per_doc, "doc_id", "left")
    r = F.coalesce(F.col("rows"), F.array().cast("array<array<long>>"))
    tensor = F.concat(r, F.array_repeat(zero_row, F.lit(max_sentences) - F.size(r)))
    return full.select("doc_id", tensor.alias("tensor"))
