"""Cross-tokenizer alignment by lockstep vectorised merging.

Two tokenizers cut the same bytes in different places. Where both end a token, the
text is cut into groups; an A token is linked with every B token of its group.

All documents of a slice lie on one line of bytes, and so do the ends of their A and
B tokens. One NumPy state vector holds a pair of pointers per document. Each step
compares the two ends of every document, moves the smaller (both where they are equal,
which is a cut), emits the groups and links of the cuts, and drops the documents
that are through. A document with many tokens enters as several runs that begin
at cuts of its own, so that the number of steps doesn't grow with its length.

Counts over the corpus: documents are dealt to chunks as they are read, a chunk names each
of its id pairs once with the number of documents that hold it, Spark sums the counts,
marks each A id's highest ones and answers every chunk. No document's pairs are
shuffled one by one, and no table of pairs is broadcast.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedweave.llm.bpe import LEAF_CHARS, ByteBpe, halves
from seedweave.llm.shared import written

RUN = 256                      # tokens of A in a run of the state vector
SLICE_CHARS = 2 << 20          # text merged together
CHUNK_CHARS = 16 << 20         # text that shares one list of id pairs
ROW_CHARS = 64                 # what a row counts besides its text
WIDE = 4096                    # links of a group up to which they are listed; beyond, counted by distinct ids


class PlainByteBpe(ByteBpe):
    """Byte-level BPE that takes special tokens in a text as plain text."""

    def encode(self, text: str) -> list[int]:
        return self.tiktoken.encode_ordinary(text)


class Tokenizers:
    """Tokenizer A (byte-level BPE file) and B (SentencePiece model) with their tokens' bytes."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece

        self.a = PlainByteBpe(a_file)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        n = self.b.get_piece_size()
        self.a_bytes = self.a.bytes_of
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(n)))]
        self.n_a, self.n_b = len(self.a_bytes), n
        self.a_sizes, self.b_sizes = (np.array([len(w) for w in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        # Ids followed by what stands after them: another id of the side, or the side's end in the group.
        self.names = [f"{i}{mark}" for n, marks in ((self.n_a, ",|"), (self.n_b, ",;")) for mark in marks for i in range(n)]

    def ids_of_a(self, text: str) -> list[int]:
        if len(text) <= LEAF_CHARS:
            return self.a.encode(text)
        return self.a.join_all([self.a.encode(t) for t in halves(text, LEAF_CHARS)])

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B of every text; none where the tokens' bytes are not the text's."""
        a, b = [[] for _ in texts], [[] for _ in texts]
        at = [i for i, t in enumerate(texts) if t]
        for i, y in zip(at, self.b.encode([texts[i] for i in at], num_threads=1)):
            whole = " " + texts[i]
            x, data = self.ids_of_a(whole), whole.encode()
            if b"".join(map(self.b_bytes.__getitem__, y)) == data == b"".join(map(self.a_bytes.__getitem__, x)):
                a[i], b[i] = x, y
        return a, b


@lru_cache(maxsize=2)
def tokenizers(a_file: str, b_file: str) -> Tokenizers:
    return Tokenizers(a_file, b_file)


def runs_of(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, run: int) -> np.ndarray:
    """First A tokens of all runs: those of the documents, and about every ``run`` tokens one right after a cut."""
    sizes = np.diff(first_a)
    inner = np.repeat(first_a[:-1], np.maximum((sizes - 1) // run, 0))
    if not len(inner):
        return np.unique(first_a[:-1][sizes > 0])
    many = np.maximum((sizes - 1) // run, 0)
    k = np.arange(len(inner)) - np.repeat(np.cumsum(many) - many, many) + 1
    at, found = inner + k * run, []
    last = np.repeat(first_a[1:], many) - 1
    while len(at):
        near = np.searchsorted(ends_b, ends_a[at])
        cut = ends_b[near] == ends_a[at]
        found.append(at[cut & (at < last)] + 1)
        at, last = at[~cut] + 1, last[~cut]
        at, last = at[at < last], last[at < last]
    return np.unique(np.concatenate([first_a[:-1][sizes > 0], *found]))


def listed(a0, na, b0, nb) -> tuple[np.ndarray, np.ndarray]:
    """All (A token, B token) pairs of the groups given by first tokens and sizes."""
    n = na * nb
    group = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    return a0[group] + k // nb[group], b0[group] + k % nb[group]


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, run: int = RUN):
    """Groups and links of all documents on one line of bytes.

    ``ends_a``, ``ends_b``: ends of the tokens, rising; ``first_a``: the documents' first A
    tokens, and the number of all. Returns groups as rows (first A, first B, A tokens, B
    tokens) in order, and links (A token, B token) of all groups with up to ``WIDE`` links.
    """
    if not len(ends_a):
        none = np.zeros(0, np.int64)
        return np.zeros((4, 0), np.int64), none, none
    a = runs_of(ends_a, ends_b, first_a, run)
    stop = np.append(a[1:], len(ends_a))
    b = np.where(a > 0, np.searchsorted(ends_b, ends_a[a - 1], "right"), 0)
    state = np.stack([a, b, a, b, stop])                    # A, B, first A and B of the group, end of the run
    groups, links_a, links_b = [], [], []
    while state.shape[1]:
        x, y = ends_a[state[0]], ends_b[state[1]]
        state[0] += x <= y
        state[1] += y <= x
        cut = np.flatnonzero(x == y)
        if len(cut):
            i, j, a0, b0, stop = state[:, cut]
            na, nb = i - a0, j - b0
            groups.append(np.stack([a0, b0, na, nb]))
            small = na * nb <= WIDE
            p, q = listed(a0, na, b0, nb) if small.all() else listed(a0[small], na[small], b0[small], nb[small])
            links_a.append(p)
            links_b.append(q)
            state[2, cut], state[3, cut] = i, j
            if (i == stop).any():
                state = np.delete(state, cut[i == stop], axis=1)
    groups = np.concatenate(groups, axis=1)
    return groups[:, np.argsort(groups[0])], np.concatenate(links_a), np.concatenate(links_b)


def aligned_slice(t: Tokenizers, texts: list[str | None], run: int = RUN):
    """Per text (n_a, n_b, n_groups, n_links, groups string's SHA-256, id pairs, links of each pair); pairs are ``a * n_b + b``, rising."""
    a, b = t.encode(texts)
    first_a, first_b = (np.cumsum([0, *map(len, x)]) for x in (a, b))
    ids_a, ids_b = (np.fromiter((i for y in x for i in y), np.int64, int(n[-1])) for x, n in ((a, first_a), (b, first_b)))
    ends_a, ends_b = np.cumsum(t.a_sizes[ids_a]), np.cumsum(t.b_sizes[ids_b])
    (a0, b0, na, nb), link_a, link_b = lockstep(ends_a, ends_b, first_a, run)
    doc = np.searchsorted(first_a, a0, "right") - 1
    doc_of = np.searchsorted(first_a, link_a, "right") - 1

    # Id pairs of each document with their links.
    keys = doc_of * (t.n_a * t.n_b) + ids_a[link_a] * t.n_b + ids_b[link_b]
    keys, times = np.unique(keys, return_counts=True)
    wide = np.flatnonzero(na * nb > WIDE)
    if len(wide):
        more, more_times = [keys], [times]
        for g in wide:
            x, nx = np.unique(ids_a[a0[g]:a0[g] + na[g]], return_counts=True)
            y, ny = np.unique(ids_b[b0[g]:b0[g] + nb[g]], return_counts=True)
            more.append((doc[g] * (t.n_a * t.n_b) + x[:, None] * t.n_b + y).ravel())
            more_times.append((nx[:, None] * ny).ravel())
        keys, at = np.unique(np.concatenate(more), return_inverse=True)
        times = np.zeros(len(keys), np.int64)
        np.add.at(times, at, np.concatenate(more_times))
    n = len(texts)
    split = np.searchsorted(keys // (t.n_a * t.n_b), np.arange(n + 1))
    pairs = keys % (t.n_a * t.n_b)

    # The groups' string: a token's place among all is its own place and the other side's tokens before it.
    codes = np.empty(len(ids_a) + len(ids_b), np.int64)
    last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    last_a[a0 + na - 1], last_b[b0 + nb - 1] = 1, 1
    codes[np.arange(len(ids_a)) + np.repeat(b0, na)] = ids_a + last_a * t.n_a
    codes[np.arange(len(ids_b)) + np.repeat(a0 + na, nb)] = ids_b + last_b * t.n_b + 2 * t.n_a
    n_groups = np.bincount(doc, minlength=n)
    n_links = np.zeros(n, np.int64)
    np.add.at(n_links, doc, na * nb)
    for d in range(n):
        lo, hi = first_a[d] + first_b[d], first_a[d + 1] + first_b[d + 1]
        text = "".join(map(t.names.__getitem__, codes[lo:hi].tolist()))[:-1]
        yield (len(a[d]), len(b[d]), int(n_groups[d]), int(n_links[d]), sha256(text.encode()).hexdigest() if text else "",
               pairs[split[d]:split[d + 1]], times[split[d]:split[d + 1]])


DOC = ["n_a long", "n_b long", "n_groups long", "n_links long", "groups_sha256 string"]


def aligned_chunks(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text",
                   chunk_chars: int = CHUNK_CHARS, slice_chars: int = SLICE_CHARS, run: int = RUN) -> DataFrame:
    """Alignment of every document, and one row per chunk with the chunk's id pairs.

    Document rows: chunk, doc_id, the ``DOC`` columns, ``places`` (of its pairs in the chunk's
    list, uint32) and ``again`` (places among those, links) where a pair has more than one
    link. Chunk rows (``pairs`` not null): ``pairs`` (int64, rising) and ``docs`` (int64, holding documents).
    """
    schema = f"chunk long, id {docs.schema[id_col].dataType.simpleString()}, {', '.join(DOC)}, places binary, again binary, " \
             "pairs binary, docs binary"
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]
    rows = docs.select(F.spark_partition_id().alias("part"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def align(batches):
        t = tokenizers(a_file, b_file)
        kept, size, k, part = [], 0, 0, 0

        def chunk():
            number = (part << 32) + k
            pairs, docs = np.unique(np.concatenate([r[-2] for r in kept]), return_counts=True)
            id_type = ids.type
            out = [[number] * len(kept), [r[0] for r in kept], *zip(*[r[1:6] for r in kept])]
            places = [np.searchsorted(pairs, r[6]).astype("<u4").tobytes() for r in kept]
            again = [np.stack([more := np.flatnonzero(r[7] > 1), r[7][more]]).astype("<i8").tobytes() for r in kept]
            none = [None] * len(kept)
            types = [pa.int64(), id_type, *[pa.int64()] * 4, pa.string(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, y) for c, y in zip([*out, places, again, none, none], types)], names)
            row = [number, *[None] * 8, pairs.astype("<i8").tobytes(), docs.astype("<i8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], y) for v, y in zip(row, types)], names)

        for batch in batches:
            ids = batch.column(1)
            keys, texts, at = ids.to_pylist(), batch.column(2).to_pylist(), 0
            part = batch.column(0)[0].as_py() if batch.num_rows else part
            while at < len(texts):
                stop, n = at, 0
                while stop < len(texts) and (stop == at or n < slice_chars):
                    n += len(texts[stop] or "") + ROW_CHARS
                    stop += 1
                kept += [(key, *r) for key, r in zip(keys[at:stop], aligned_slice(t, texts[at:stop], run))]
                size, at = size + n, stop
                if size >= chunk_chars:
                    yield from chunk()
                    kept, size, k = [], 0, k + 1
        if kept:
            yield from chunk()

    return rows.mapInArrow(align, schema)


def with_corpus_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """Document rows of a written ``aligned_chunks`` table with ``n_best`` and ``count_sum``."""
    def listed_pairs(batches):
        for rows in batches:
            for chunk, pairs, docs in zip(*(rows.column(c).to_pylist() for c in range(3))):
                p = np.frombuffer(pairs, "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(p), chunk, np.int64)), pa.array(np.arange(len(p), dtype=np.int32)), pa.array(p),
                     pa.array(np.frombuffer(docs, "<i8"))], ["chunk", "place", "pair", "docs"])

    held = aligned.where(F.col("pairs").isNotNull()).select("chunk", "pairs", "docs") \
        .mapInArrow(listed_pairs, "chunk long, place int, pair long, docs long")
    counts = held.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.expr(f"pair div {n_b}"))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))        # a row per A id
    counts = counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    answers = held.select("chunk", "place", "pair").join(counts, "pair").select("chunk", "place", "count", "best")
    documents = aligned.where(F.col("pairs").isNull()).drop("pairs", "docs")
    fields = [f for f in documents.schema if f.name not in ("chunk", "places", "again")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", n_best long, count_sum long"

    def total(rows: pa.Table, found: pa.Table) -> pa.Table:
        place = found.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = found.column("count").to_numpy(), found.column("best").to_numpy(zero_copy_only=False)
        n_best, count_sum = [], []
        for places, again in zip(rows.column("places").to_pylist(), rows.column("again").to_pylist()):
            at = np.frombuffer(places, "<u4")
            where, times = np.frombuffer(again, "<i8").reshape(2, -1)
            n_best.append(int(best[at].sum() + (best[at[where]] * (times - 1)).sum()))
            count_sum.append(int(count[at].sum() + (count[at[where]] * (times - 1)).sum()))
        return rows.drop_columns(["chunk", "places", "again"]).append_column("n_best", pa.array(n_best, pa.int64())) \
            .append_column("count_sum", pa.array(count_sum, pa.int64()))

    return documents.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(total, schema)


def align_documents(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text",
                    **kw) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    A text that is null or empty, or whose tokens don't spell it (a model that rewrites
    characters), has zeros and ''. Rows with null or repeated ids, and equal rows, are
    documents of their own and count as such. Texts of any length are encoded whole.
    More columns, whatever their names, are not read. An empty table gives no rows.
    Both files must be reachable by every worker.
    """
    import sentencepiece
    n_b = sentencepiece.SentencePieceProcessor(model_file=b_file).get_piece_size()
    aligned = written(aligned_chunks(docs, a_file, b_file, id_col, text_col, **kw), "aligned")
    return with_corpus_counts(aligned, n_b).select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
