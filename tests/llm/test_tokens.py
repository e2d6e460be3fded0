"""BPE by tree concatenation and packing against the tokenizers library and brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seedweave.llm.bpe import byte_bpe, encode_digests, encoded, halves
from seedweave.llm.catalog import tokenizer_file
from seedweave.llm.packing import pack, pack_documents, sum_of_squares
from seedweave.session import table
from tests.llm import brute
from tests.llm.conftest import ODD, SF

OP4 = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
OP10 = ["doc_id", "piece", "start", "length", "ids_crc32"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_file())


def digests(reference, pairs):
    out = []
    for key, t in pairs:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        out.append((key, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(reference.decode(ids, skip_special_tokens=False))))
    return brute.ordered(out)


BITS = st.sampled_from([" ", "  ", "\n", "a", "b", "the", "'", "s", "'re", "ll", "é", "😀", "1", "!", "...", "<|endoftext|>",
                        "<|end", "oftext|>", "中", "\t", "A", "́", " "])


@settings(max_examples=200, deadline=None)
@given(st.lists(BITS, max_size=120).map("".join), st.integers(1, 40))
def test_joined_halves_equal_the_library(text, most):
    from tokenizers import Tokenizer
    bpe = byte_bpe(tokenizer_file())
    reference = test_joined_halves_equal_the_library.__dict__.setdefault("t", Tokenizer.from_file(tokenizer_file()))
    ids = reference.encode(text, add_special_tokens=False).ids
    assert bpe.encode(text) == ids
    assert bpe.join_all([bpe.encode(t) for t in halves(text, most)]) == ids
    assert bpe.decode_bytes(ids).decode("utf-8", "replace") == reference.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, " " * 4000 + "x", "!" * 3000, "éè" * 2000, "1" * 3001, "'s" * 900])
def test_unsplit_text(reference, text):
    bpe = byte_bpe(tokenizer_file())
    assert bpe.join_all([bpe.encode(t) for t in halves(text, 100)]) == reference.encode(text, add_special_tokens=False).ids


def test_special_token_cut_in_two_with_a_narrow_window(reference, monkeypatch):
    from seedweave.llm import bpe as module
    monkeypatch.setattr(module, "FIRST_WINDOW", 1)
    bpe = byte_bpe(tokenizer_file())
    text = "x ftext|> <|endo<|endoftext|>1''s<|endoftext|><|endoftext|> y" * 3
    for most in range(1, 40):
        assert bpe.join_all([bpe.encode(t) for t in halves(text, most)]) == reference.encode(text, add_special_tokens=False).ids


def test_every_kind_of_character(reference):
    """Both libraries split text alike around every character of the basic plane, and samples beyond."""
    bpe = byte_bpe(tokenizer_file())
    points = [c for c in [*range(0x10000), *range(0x10000, 0x110000, 37)] if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)} x{chr(c)} \n{chr(c)}'s!{chr(c)}" for c in points]
    assert [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)] == [bpe.encode(t) for t in texts]


def test_documents_equal_the_library(spark, reference):
    docs = table(spark, SF, "documents")
    pairs = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert brute.rows(encode_digests(docs, tokenizer_file(), leaf_chars=1000), *OP4) == digests(reference, pairs)


def test_odd_rows(odd_docs, no_docs, reference):
    for leaf in (1 << 15, 50):
        assert brute.rows(encode_digests(odd_docs, tokenizer_file(), leaf_chars=leaf), *OP4) == digests(reference, ODD)
    assert encode_digests(no_docs, tokenizer_file()).count() == pack_documents(no_docs, tokenizer_file()).count() == 0
    ids = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in encoded(odd_docs, tokenizer_file()).collect()}
    assert ids[7] == reference.encode(dict(ODD)[7], add_special_tokens=False).ids


def packed_well(got, length):
    """Places are gapless, sequences not overfull; the number of sequences."""
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for rows in by.values():
        end = 0
        for offset, n in sorted(rows):
            assert offset == end
            end += n
        assert end <= length
    return len(by)


def test_pieces_and_sequences(spark, reference):
    docs = table(spark, SF, "documents")
    got = pack_documents(docs, tokenizer_file()).cache()
    expected = [(r["doc_id"], *p) for r in docs.select("doc_id", "text").collect()
                for p in brute.pieces(reference.encode(r["text"], add_special_tokens=False).ids)]
    assert brute.rows(got, *OP10) == brute.ordered(expected)
    rows = got.collect()
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert least <= packed_well(rows, 2048) <= 1.03 * least


def test_pieces_of_odd_rows(odd_docs, reference):
    got = pack_documents(odd_docs, tokenizer_file(), group=3).cache()
    expected = [(key, *p) for key, t in ODD for p in brute.pieces(reference.encode(t or "", add_special_tokens=False).ids)]
    assert brute.rows(got, *OP10) == brute.ordered(expected)
    packed_well(got.collect(), 2048)


def test_groups_are_even_whatever_the_row_numbers(spark):
    """Few rows per partition: row numbers have common factors with the number of groups."""
    df = spark.range(6400).repartition(200).selectExpr("id", "cast(1 + id % 7 AS int) AS length", "id AS offset")
    got = pack(df, 10, group=100)
    assert got.columns == ["id", "length", "sequence_id", "offset"]
    sizes = [r["count"] for r in got.groupBy(F.shiftright("sequence_id", 32)).count().collect()]
    assert len(sizes) == 64 and max(sizes) <= 200
    packed_well(got.collect(), 10)


def test_extra_columns_stay(spark):
    df = spark.createDataFrame([(1, 3, "x"), (2, 7, None), (3, 10, "y")], "id int, length long, bin string")
    got = pack(df, 10)
    assert got.columns == ["id", "length", "bin", "sequence_id", "offset"]
    assert packed_well(got.collect(), 10) == 2


def plain_sum_of_squares(lengths, room):
    """The rule by trying every open gap and a new sequence."""
    gaps, out = [], []
    total = lambda g: sum(sum(x == y for x in g if x) for y in g if y)  # noqa: E731  sum of N(g)^2
    for s in lengths:
        tries = [(total(gaps[:i] + [g - s] + gaps[i + 1:]), 0, g) for i, g in enumerate(gaps) if g >= s]
        best = min([*tries, (total([*gaps, room - s]), 1, room)])
        if best[1]:
            gaps.append(room - s)
        else:
            gaps[gaps.index(best[2])] -= s
        out.append(room - best[2])
    return out


def test_rule_equals_plain_form():
    rnd = random.Random(5)
    for _ in range(30):
        lengths = [rnd.randint(1, 12) for _ in range(40)]
        assert sum_of_squares(np.array(lengths), 12)[1].tolist() == plain_sum_of_squares(lengths, 12)
