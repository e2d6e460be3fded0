"""Text expressions: every function maps Column -> Column and stays JVM-side.

Nothing here collects, explodes or shuffles; callers decide where rows move.
Regular expressions are written so that Java (Spark) and RE2 (the SQL oracle)
read them the same way: Unicode classes instead of ``\\w``, no look-behind.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for equal results.
# ---------------------------------------------------------------------------
# Filter set of the word-index tokenizer (keeps the apostrophe and "$", so
# sense tokens such as "bank$1" survive).
TOKENIZER_FILTERS = '!"#%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'
# ASCII punctuation (Python's string.punctuation).
PUNCTUATION = string.punctuation
# Characters the company-description cleaner turns into spaces.
DESCRIPTION_CHARS = ";,.!?()"
# URL pattern of the web-text cleaner.
URL_PATTERN = r"(http(s)?:\/\/.)?(www\.)?[-a-zA-Z0-9@:%._\+~#=]{2,256}\.[a-z]{2,6}\b([-a-zA-Z0-9@:%_\+.~#?&//=]*)"
# English stop words of the NLTK list, plus the extra word the reference adds.
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're",
    "you've", "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "she's", "her", "hers", "herself", "it", "it's",
    "its", "itself", "they", "them", "their", "theirs", "themselves", "what",
    "which", "who", "whom", "this", "that", "that'll", "these", "those", "am", "is",
    "are", "was", "were", "be", "been", "being", "have", "has", "had", "having",
    "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above",
    "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under",
    "again", "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "any", "both", "each", "few", "more", "most", "other", "some",
    "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very",
    "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now",
    "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn",
    "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn",
    "hasn't", "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't",
    "mustn", "mustn't", "needn", "needn't", "shan", "shan't", "shouldn",
    "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
]
EXTRA_STOP_WORDS = ["would"]

# Our own patterns (not taken from the reference).
WORD_RE = r"[\p{L}\p{N}_]{2,}"          # runs of >= 2 word characters
WORD_CHAR = r"[\p{L}\p{N}_]"
SENT_MARK = "\u0001"                      # internal sentence separator


def char_class(chars: str) -> str:
    """A regex character class matching exactly ``chars`` (Java and RE2)."""
    out = []
    for ch in chars:
        if ch in "\\]^-[":
            out.append("\\" + ch)
        elif ch == "\t":
            out.append("\\t")
        elif ch == "\n":
            out.append("\\n")
        else:
            out.append(ch)
    return "[" + "".join(out) + "]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# X6 --------------------------------------------------------------------------
def whitespace_tokens(c) -> Column:
    """``str.strip().split()``: tokens between runs of whitespace."""
    return F.array_remove(F.split(_c(c), r"\s+"), "")


# X7 --------------------------------------------------------------------------
def filter_tokens(c, filters: str = TOKENIZER_FILTERS, lower: bool = True) -> Column:
    """Word-index tokenizer: lower, split on spaces and filter characters."""
    x = F.lower(_c(c)) if lower else _c(c)
    return F.array_remove(F.split(x, char_class(filters + " ")), "")


# X8 --------------------------------------------------------------------------
def word_tokens(c) -> Column:
    """Count-vectorizer tokens: lowercase runs of >= 2 word characters."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(WORD_RE), 0)


# X1 --------------------------------------------------------------------------
def casefold(c) -> Column:
    return F.replace(F.lower(_c(c)), F.lit("ß"), F.lit("ss"))


WHITE_SPACE = " \t\n\x0b\f\r"


def strip_ws(c) -> Column:
    """Python ``str.strip()`` for ASCII whitespace, looking at the ends of the text only.

    A text that ends with another line terminator goes through the pattern, whose ``$`` also
    matches before that. One element, so that ``c`` is computed once.
    """
    def strip(x):
        other_end = x.endswith("\u0085") | x.endswith("\u2028") | x.endswith("\u2029")
        return F.when(other_end, F.regexp_replace(x, r"^\s+|\s+$", "")).otherwise(F.trim(x, F.lit(WHITE_SPACE)))
    return F.transform(F.array(_c(c)), strip)[0]


# Whitespace-delimited words holding a digit, with the white space before (group 1). Same words as
# \S*\p{Nd}\S* (leftmost match starts at the word start and runs to its end), but anchored at
# word starts with a possessive prefix, so the engine never backtracks through long
# digit-free words; a group instead of a look-behind, which is slow at every character.
DIGIT_WORD_RE = r"(^|\s)[^\s\p{Nd}]*+\p{Nd}\S*"


def small_clean(c, squeeze: bool = True) -> Column:
    """Casefold, delete tokens holding a digit, strip, squeeze spaces (which a tokenizer doesn't need)."""
    x = strip_ws(F.regexp_replace(casefold(c), DIGIT_WORD_RE, "$1"))
    return F.regexp_replace(x, "  +", " ") if squeeze else x      # a single space is no match: nothing is copied for it


# X2 --------------------------------------------------------------------------
def description_clean(c, strict: bool = False) -> Column:
    """Lower, ``;,.!?()`` to space; newlines deleted (strict) or spaced."""
    x = F.regexp_replace(F.lower(_c(c)), char_class(DESCRIPTION_CHARS), " ")
    return F.replace(x, F.lit("\n"), F.lit("" if strict else " "))


# X3 --------------------------------------------------------------------------
def web_clean(c, remove_runs: bool = True) -> Column:
    """Remove urls, ``?!``, runs of >= 3 equal word characters, extra spaces."""
    x = F.regexp_replace(_c(c), URL_PATTERN, "")
    x = F.regexp_replace(x, "[?!]", "")
    if remove_runs:
        x = F.regexp_replace(x, "(" + WORD_CHAR + r")\1{2,}", "")
    return strip_ws(F.regexp_replace(x, r"\s+", " "))


# F7 --------------------------------------------------------------------------
def is_boilerplate(c, word: str = "home", max_len: int = 50) -> Column:
    """True for short texts naming ``word`` and for empty texts."""
    return (F.lower(_c(c)).contains(word) & (F.length(_c(c)) < max_len)) | (F.length(_c(c)) == 0)


# X4 / X5 ---------------------------------------------------------------------
def strip_punctuation(c) -> Column:
    return F.translate(_c(c), PUNCTUATION, "")


def punctuation_to_space(c) -> Column:
    return F.regexp_replace(F.lower(_c(c)), char_class(PUNCTUATION), " ")


# X9 --------------------------------------------------------------------------
def sentences(c) -> Column:
    """Split after ``.!?`` followed by whitespace; mark the gap, then split."""
    marked = F.regexp_replace(strip_ws(c), r"([.!?])\s+", "$1" + SENT_MARK)
    return F.filter(F.split(marked, SENT_MARK), lambda s: s != "")


# X12 -------------------------------------------------------------------------
def ngrams(tokens, n: int) -> Column:
    """Word n-grams of one size, joined by a space; empty when too short."""
    t = _c(tokens)
    if n == 1:
        return t
    return F.when(F.size(t) >= n,
                  F.transform(F.sequence(F.lit(1), F.size(t) - n + 1),
                              lambda i: F.array_join(F.slice(t, i, n), " "))
                  ).otherwise(F.array().cast("array<string>"))


def ngrams_upto(tokens, n_max: int, n_min: int = 1) -> Column:
    """All n-grams with n_min <= n <= n_max, shortest first (clean, no Q7)."""
    return F.concat(*[ngrams(tokens, n) for n in range(n_min, n_max + 1)])


# X13 -------------------------------------------------------------------------
def merge_bigrams(text, bigrams: list[str]) -> Column:
    """Join listed word pairs into one word: "Buy Real estate, now" -> "Buy Realestate, now".

    Pairs are runs of word characters with white space between, compared in lower
    case; matches are taken from the left and don't overlap. One pattern, so a text
    is passed once. For a small list.
    """
    if not bigrams:
        return _c(text)
    # No entry is a prefix of another's match: both words must end at word boundaries.
    pairs = sorted({tuple(b.lower().split(" ")) for b in bigrams if len(b.split(" ")) == 2}, reverse=True)
    out = "|".join(rf"(?<=(?<![\p{{L}}\p{{N}}_]){_escape(a)})\s+(?={_escape(b)}(?![\p{{L}}\p{{N}}_]))" for a, b in pairs)
    return F.regexp_replace(_c(text), f"(?iu)(?:{out})", "") if not _chained(pairs) else _merge_in_order(_c(text), pairs)


def _escape(word: str) -> str:
    return "".join(ch if ch.isalnum() or ch == "_" else "\\" + ch for ch in word)


def _chained(pairs) -> bool:
    """Whether a pair may begin with the word that another ends with, so that matches can overlap."""
    return bool({a for a, _ in pairs} & {b for _, b in pairs})


def _merge_in_order(text: Column, pairs) -> Column:
    """Non-overlapping matches from the left: the second word is consumed with its pair."""
    edge, word = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    any_ = "|".join(rf"{_escape(a)}\s+{_escape(b)}" for a, b in pairs)
    hits = F.regexp_extract_all(text, F.lit(f"(?iu){edge}(?:{any_}){word}"), F.lit(0))
    rest = F.split(text, f"(?iu){edge}(?:{any_}){word}", -1)
    joined = F.transform(rest, lambda r, i: F.concat(r, F.coalesce(F.regexp_replace(F.get(hits, i), r"\s+", ""), F.lit(""))))
    return F.array_join(joined, "")


# X14 -------------------------------------------------------------------------
def merge_seed_bigrams(seeds, label: str = "label", word: str = "word", pos: str = "pos"):
    """Dictionary side of X13: (seeds with two-word entries as one word ``jj<pos>``, the map bigram -> word).

    Both are DataFrames; of a bigram under several labels or places the map keeps the
    smallest place.
    """
    two = F.size(F.split(F.col(word), " ")) == 2
    mono = F.concat(F.lit("jj"), F.col(pos).cast("string"))
    new = seeds.withColumn(word, F.when(two, mono).otherwise(F.col(word)))
    pairs = seeds.where(two).groupBy(F.col(word).alias("bigram")).agg(F.min(pos).alias(pos))
    return new, pairs.select("bigram", mono.alias("word"))


# X16 -------------------------------------------------------------------------
def join_sentences(sentences) -> Column:
    """An array of sentences as one text, " . " between them."""
    return F.array_join(_c(sentences), " . ")


# X15 -------------------------------------------------------------------------
def sense_word(c) -> Column:
    """Word part of ``word$k`` (everything before the last ``$`` when k is an int)."""
    k = sense_index(c)
    return F.when(k.isNotNull(), F.regexp_extract(_c(c), r"^(.*)\$[^$]*$", 1)).otherwise(_c(c))


def sense_index(c) -> Column:
    """Sense number of ``word$k``; NULL when the token has no integer sense."""
    return F.when(_c(c).contains("$"), F.regexp_extract(_c(c), r"\$([^$]*)$", 1).try_cast("int"))



# X16 / X29 -------------------------------------------------------------------
def join_ordered(items, sep: str = " ") -> Column:
    """Join an array<struct<order..., text>> by its order fields.

    Sorting a collected list of structs makes the result independent of the
    order in which the shuffle delivered rows.
    """
    return F.array_join(F.transform(F.array_sort(_c(items)), lambda s: s["text"]), sep)


# X27 -------------------------------------------------------------------------
def split_trim(c, sep: str = ",") -> Column:
    """Split a delimited list and trim the parts; empty parts are dropped."""
    return F.filter(F.transform(F.split(_c(c), sep), lambda p: F.trim(p)), lambda p: p != "")


# X31 -------------------------------------------------------------------------
def truncate_tokens(tokens, n: int) -> Column:
    return F.slice(_c(tokens), 1, n)


# F15 -------------------------------------------------------------------------
def remove_stop_words(tokens, stop_words=None) -> Column:
    """Drop stop words and tokens that are empty once punctuation is removed."""
    words = list(stop_words) if stop_words is not None else ENGLISH_STOP_WORDS + EXTRA_STOP_WORDS
    # A set, and a look at the first characters only: neither passes the list nor copies the token.
    return F.filter(_c(tokens), lambda t: (~t.isin(words)) & (F.ltrim(t, F.lit(PUNCTUATION)) != ""))


# Generators --------------------------------------------------------------------
def explode_nonempty(df, arr, alias: str, *keep, with_pos: str | None = None):
    """Rows of ``df`` times the elements of ``arr`` (a Column), NULL elements dropped.

    ``explode_outer`` plus a filter on the generated column. A plain ``explode``
    lets Catalyst infer ``size(arr) > 0`` and push that filter below the
    projection that computes ``arr``, so an expensive array (tokenization,
    labelling) would be computed twice per row.
    """
    if with_pos:
        out = df.select(*keep, F.posexplode_outer(arr).alias(with_pos, alias))
    else:
        out = df.select(*keep, F.explode_outer(arr).alias(alias))
    return out.where(F.col(alias).isNotNull())
