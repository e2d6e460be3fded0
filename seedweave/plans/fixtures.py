"""Side inputs the driver's tables do not supply (built inline on both sides).

The registered queries all read the driver's tables; these small dictionaries
only parameterize them (seed words, code tables), as a user would.
"""

from __future__ import annotations

from seedweave.functions.text import TOKENIZER_FILTERS, char_class

# Test seeds: function words per language (overlaps on purpose: "in", "de", "des").
SEEDS = {
    "de": ["der", "und", "des", "in"],
    "en": ["the", "and", "in", "of"],
    "es": ["el", "los", "de", "en"],
    "fr": ["le", "les", "de", "des"],
}

# A second, smaller dictionary (fewer than 3 labels: "every label with a hit").
SEEDS_SMALL = {
    "en": ["the", "of"],
    "fr": ["le", "la"],
}

# Synonym dictionary over the words of part names (tags) -- multi-word entries
# on purpose so that n-gram matching matters.
TAG_SYNONYMS = {
    "colour": ["red", "blue", "red widget"],
    "temperature": ["hot", "cold"],
    "size": ["small", "large", "small ring"],
    "age": ["old", "new"],
    "hardware": ["bolt", "rod", "gear", "plate", "ring"],
    "gadget": ["widget", "gizmo", "anvil"],
}
TAG_IDS = {"colour": 1, "temperature": 2, "size": 3, "age": 4, "hardware": 5, "gadget": 6}
# Directed tag links (one hop): hardware -> gadget, colour -> size; 9 is unknown.
TAG_LINKS = [(5, 6), (1, 3), (2, 9)]

# Mapping of part-name words to categories (the "industry mapping sheet").
WORD_CATEGORY = [
    ("widget", "devices"), ("gizmo", "devices"), ("anvil", "tools"), ("gear", "mechanics"),
    ("bolt", "mechanics"), ("rod", "mechanics"), ("plate", "mechanics"), ("ring", "mechanics"),
    ("ring", "jewelry"),
]

# Bigrams merged into one token.
BIGRAMS = ["small ring", "red widget", "blue bolt", "hot gear"]

# Priority of conversation roles (the "source priority list").
ROLE_PRIORITY = ["user", "assistant", "system"]


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def seeds_values_sql(seeds: dict = SEEDS) -> str:
    rows = ", ".join(f"({sql_str(l)}, {sql_str(w)}, {i})" for l, ws in seeds.items() for i, w in enumerate(ws))
    return f"(SELECT * FROM (VALUES {rows}) AS s(label, word, pos))"


def pairs_values_sql(pairs, a: str, b: str, types=("str", "str")) -> str:
    def lit(v, t):
        return sql_str(v) if t == "str" else str(v)
    rows = ", ".join(f"({lit(x, types[0])}, {lit(y, types[1])})" for x, y in pairs)
    return f"(SELECT * FROM (VALUES {rows}) AS t({a}, {b}))"


def sql_filter_tokens(col: str) -> str:
    """DuckDB form of ``filter_tokens``."""
    cls = char_class(TOKENIZER_FILTERS)
    return (f"list_filter(string_split(regexp_replace(lower({col}), '{cls}', ' ', 'g'), ' '), "
            f"lambda x: x <> '')")


def sql_word_tokens(col: str) -> str:
    return f"regexp_extract_all(lower({col}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def sql_ngrams(tok: str, n: int) -> str:
    if n == 1:
        return tok
    return (f"CASE WHEN len({tok}) >= {n} THEN list_transform(range(1, len({tok}) - {n} + 2), "
            f"lambda i: array_to_string({tok}[i:i + {n} - 1], ' ')) ELSE [] END")


def sql_ngrams_upto(tok: str, n_max: int) -> str:
    parts = [sql_ngrams(tok, n) for n in range(1, n_max + 1)]
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


# Tags over the conversation languages (for the company job) and their links.
TEXT_TAGS = {
    "article": ["the", "der", "le", "el", "la"],
    "conjunction": ["and", "und", "et", "y"],
    "phrase": ["of the", "de la", "in der"],
    "preposition": ["of", "in", "de", "von", "dans"],
}
TEXT_TAG_IDS = {"article": 1, "conjunction": 2, "phrase": 3, "preposition": 4}
TEXT_TAG_LINKS = [(3, 1), (3, 4), (2, 7)]

# Batch timestamp written with classified rows (a parameter of the job).
ACQ_DATE = "2024-01-01 00:00:00"


def synonyms_values_sql(syn: dict) -> str:
    rows = ", ".join(f"({sql_str(t)}, {sql_str(w)})" for t, ws in syn.items() for w in ws)
    return f"(SELECT * FROM (VALUES {rows}) AS s(tag, word))"


def ids_values_sql(ids: dict) -> str:
    rows = ", ".join(f"({sql_str(t)}, {i})" for t, i in ids.items())
    return f"(SELECT * FROM (VALUES {rows}) AS s(tag, tag_id))"
