"""The library's row, group and row-to-many functions by name in SQL.

Every one is a temporary SQL function of the session: Spark puts its body into the calling query, so
Catalyst sees plain expressions and no Python runs. ``register(spark)`` may be
called again at any time. For null arguments every function gives null.

    sw_word_tokens(text)                 words of two or more characters, lower case (X8)
    sw_filter_tokens(text)               word-index tokens (X7)
    sw_small_clean(text)                 lower case, without words that hold a digit (X1)
    sw_sorted_union(lists)               distinct members of all lists, sorted; with collect_list a group function (A18)
    sw_best_first(counts)                array<struct<label, n>> with most hits first (ties: by label)
    sw_share_labels(counts, labels, t)   P2 on array<struct<label, n>>: the labels kept, with n and total
    sw_token_rows(text)                  array<struct<pos, word>> of sw_word_tokens, for inline_outer (Y6)

A row becomes many by ``inline_outer(sw_token_rows(text))`` over a subquery. A table function for LATERAL isn't
offered: Spark plans one with a generator inside as a join on the whole text.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from seedweave.functions.text import DIGIT_WORD_RE, TOKENIZER_FILTERS, WORD_RE, char_class

_COUNTS = "ARRAY<STRUCT<label: STRING, n: BIGINT>>"

# Most hits first, ties by label.
_BEST_FIRST = ("array_sort(counts, (a, b) -> CASE WHEN a.n <> b.n THEN CAST(sign(b.n - a.n) AS INT) "
               "WHEN a.label < b.label THEN -1 WHEN a.label > b.label THEN 1 ELSE 0 END)")

FUNCTIONS = {
    "sw_word_tokens": ("text STRING", "ARRAY<STRING>", f"regexp_extract_all(lower(text), r'{WORD_RE}', 0)"),
    "sw_filter_tokens": ("text STRING", "ARRAY<STRING>",
                         f"filter(split(regexp_replace(lower(text), r'{char_class(TOKENIZER_FILTERS)}', ' '), ' '), t -> t <> '')"),
    "sw_small_clean": ("text STRING", "STRING",
                       "regexp_replace(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), "
                       f"r'{DIGIT_WORD_RE}', '$1'), r'^\\s+|\\s+$', ''), '  +', ' ')"),
    "sw_sorted_union": ("lists ARRAY<ARRAY<STRING>>", "ARRAY<STRING>", "array_sort(array_distinct(flatten(lists)))"),
    "sw_token_rows": ("text STRING", "ARRAY<STRUCT<pos: INT, word: STRING>>",
                      f"transform(regexp_extract_all(lower(text), r'{WORD_RE}', 0), (w, i) -> named_struct('pos', i, 'word', w))"),
    "sw_best_first": (f"counts {_COUNTS}", _COUNTS, _BEST_FIRST),
    # Below three labels every hit counts, else the best label and those whose share reaches the threshold.
    "sw_share_labels": (f"counts {_COUNTS}, labels INT, threshold DOUBLE", "ARRAY<STRUCT<label: STRING, n: BIGINT, total: BIGINT>>",
                        f"transform(array(named_struct('sorted', {_BEST_FIRST}, 'total', aggregate(counts, 0L, (t, c) -> t + c.n))), "
                        "x -> transform(filter(x.sorted, (c, i) -> CASE WHEN labels < 3 THEN c.n > 0 "
                        "ELSE i = 0 OR try_divide(c.n, x.total) >= threshold END), "
                        "c -> named_struct('label', c.label, 'n', c.n, 'total', x.total)))[0]"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; their names."""
    for name, (arguments, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
    return list(FUNCTIONS)
