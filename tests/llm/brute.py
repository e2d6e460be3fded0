"""Plain versions of the operators' contracts, for small tables."""

import re
import zlib
from collections import Counter
from hashlib import sha256

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(data):
    return sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def word_windows(pairs, length):
    words = [WORD.findall((t or "").encode()) for _, t in pairs]
    seen = Counter(tuple(w[i:i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (key, _), w in zip(pairs, words):
        gone = set()
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k:k + length])] > 1:
                gone.update(range(k, k + length))
        out.append((key, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def byte_strings(pairs, length):
    texts = [(t or "").encode() for _, t in pairs]
    seen = Counter(w[i:i + length] for w in texts for i in range(len(w) - length + 1))
    out = []
    for (key, _), w in zip(pairs, texts):
        gone, last = bytearray(len(w)), 0
        for k in range(len(w) - length + 1):
            if seen[w[k:k + length]] > 1:
                a = max(k, last)
                gone[a:k + length] = b"\x01" * (k + length - a)
                last = k + length
        kept = bytes(b for b, x in zip(w, gone) if not x)
        out.append((key, len(w), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), sha(kept)))
    return out


def simhash(text):
    from xxhash import xxh64_intdigest
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components(prints, bits=2):
    """Root place of every fingerprint, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(prints))]


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, again = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4)), set()
    for i in range(len(words) - 4):
        if seen[tuple(words[i:i + 5])] > 1:
            again.update(range(i, i + 5))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again),
            len(words) < 10 or 100 * len(again) > 20 * len(words))


def pieces(ids, length=2048):
    """(piece, start, length, crc) of a document's ids and the end id."""
    ids = [*ids, 0]
    cuts = [0, *range(len(ids) % length or length, len(ids) + 1, length)]
    return [(k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b])))
            for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def rows(df, *cols):
    """Sorted rows; nulls first."""
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def ordered(rows_):
    return sorted(rows_, key=lambda r: tuple((x is not None, x) for x in r))
