"""Substring, suffix-array and SimHash deduplication against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from seedweave.llm.simhash import one_per_group, simhash_components, star_components, linked_fingerprints
from seedweave.llm.substring import remove_repeated_windows, text_of_kept
from seedweave.llm.suffix import remove_repeated_strings, without_repeated_strings
from seedweave.session import table
from tests.llm import brute
from tests.llm.conftest import ODD, SF

OP1 = ["doc_id", "n_words", "n_removed", "kept_sha256"]
OP7 = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
OP8 = ["doc_id", "fingerprint", "component_id"]


def planted(seed, n=60):
    """Texts with shared passages, near copies, repeats within a text and overlaps."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["aa", "b", "cé", "dd", "e"]) + str(rnd.randint(0, 400))
    passages = [[word() for _ in range(rnd.randint(5, 60))] for _ in range(8)]
    out = []
    for i in range(n):
        w = [word() for _ in range(rnd.randint(0, 80))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) - 1)
            k = rnd.randint(0, len(w))
            w[k:k] = p[a:] if rnd.random() < 0.5 else p[:a + 1]
        out.append((i, rnd.choice([" ", "\n", "  "]).join(w)))
    return out + [(n, out[3][1]), (n + 1, out[3][1])]


@pytest.mark.parametrize("length", [2, 7, 35])
def test_word_windows_equal_brute_force(make_docs, length):
    pairs = planted(length)
    got = remove_repeated_windows(make_docs(pairs), length, chunk_bytes=3000)
    assert brute.rows(got, *OP1) == brute.ordered(brute.word_windows(pairs, length))


@pytest.mark.parametrize("length", [2, 31, 200])
def test_byte_strings_equal_brute_force(make_docs, length):
    pairs = planted(length + 1)
    got = remove_repeated_strings(make_docs(pairs), length, chunk_bytes=3000)
    assert brute.rows(got, *OP7) == brute.ordered(brute.byte_strings(pairs, length))


def test_repeated_rows_spread_over_chunks(spark):
    from seedweave.llm.names import chunked_documents
    rows = spark.range(8000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"),
                                    F.when(F.col("id") % 2 == 0, F.concat(F.lit("text "), F.col("id").cast("string")))
                                    .otherwise(F.lit("repeated")).alias("text"))
    docs, n = chunked_documents(rows, "doc_id", "text", 1000)
    sizes = [r["count"] for r in docs.groupBy("chunk").count().collect()]
    assert len(sizes) == n > 50 and sum(sizes) == 8000 and max(sizes) < 2 * 8000 / n
    assert docs.where("id IS NULL").select("chunk").distinct().count() == n


def test_segments_give_the_same_rows(make_docs, monkeypatch):
    """Long texts are named in segments; short segments must not change a row (in this process)."""
    from seedweave.llm import names, substring, suffix
    import numpy as np
    data = " ".join(f"w{i % 50}" for i in range(400)).encode()
    whole = substring.word_names(data), list(suffix.string_ranks(data, np.array([[0, 900]]), 60))
    monkeypatch.setattr(names, "SEGMENT", 64)
    assert (substring.word_names(data) == whole[0]).all()
    parts = list(suffix.string_ranks(data, np.array([[0, 900]]), 60))
    assert np.concatenate([p[1] for p in parts]).tolist() == whole[1][0][1].tolist()


def test_odd_rows(odd_docs):
    assert brute.rows(remove_repeated_windows(odd_docs), *OP1) == brute.ordered(brute.word_windows(ODD, 35))
    small = odd_docs.where("length(text) < 60000 OR text IS NULL")
    pairs = [(i, t) for i, t in ODD if len(t or "") < 60_000]
    assert brute.rows(remove_repeated_strings(small), *OP7) == brute.ordered(brute.byte_strings(pairs, 200))
    one = {r["doc_id"]: r for r in remove_repeated_strings(odd_docs).collect() if r["doc_id"] == 8}
    assert one[8]["n_bytes"] == one[8]["n_removed"] == 70_000 and one[8]["n_spans"] == 1


def test_odd_rows_simhash(odd_docs):
    got = brute.rows(simhash_components(odd_docs), *OP8)
    prints = [brute.simhash(t) for _, t in ODD]
    roots = brute.components(prints)
    ids = {}
    for r, (key, _) in zip(roots, ODD):
        ids[r] = min([x for x in (ids.get(r), key) if x is not None], default=None)
    assert got == brute.ordered([(key, f"{p:016x}", ids[r]) for (key, _), p, r in zip(ODD, prints, roots)])


def test_empty_tables_and_extra_columns(no_docs, make_docs):
    from pyspark.sql import functions as F
    for f in (remove_repeated_windows, remove_repeated_strings, simhash_components):
        assert f(no_docs).count() == 0
    assert one_per_group(no_docs).count() == without_repeated_strings(no_docs).count() == 0
    clash = make_docs([(1, "a b c"), (2, "a b c")]).withColumns({c: F.lit("x") for c in ("id", "chunk", "data", "fp", "row", "kept")})
    assert remove_repeated_windows(clash, 2).select("n_removed").distinct().collect()[0][0] == 3
    assert one_per_group(clash).columns == without_repeated_strings(clash, 2).columns == clash.columns
    assert [r["doc_id"] for r in one_per_group(clash).collect()] == [1]
    assert {r["text"] for r in without_repeated_strings(clash, 2).collect()} == {""}


def test_real_outputs(make_docs):
    got = remove_repeated_windows(make_docs([(1, "a b c d"), (2, "b c x")]), 2, finish=text_of_kept, column="text")
    assert brute.rows(got, "doc_id", "text") == [(1, "a d"), (2, "x")]
    cut = without_repeated_strings(make_docs([(1, "éabcd"), (2, "abcx")]), 3)
    assert brute.rows(cut, "doc_id", "text", "n_chars") == [(1, "éd", 2), (2, "x", 1)]


def test_simhash_components_on_documents(spark):
    docs = table(spark, SF, "documents")
    pairs = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    prints = [brute.simhash(t) for _, t in pairs]
    roots = brute.components(prints)
    ids = {}
    for r, (key, _) in zip(roots, pairs):
        ids[r] = min(ids.get(r, key), key)
    expected = [(key, f"{p:016x}", ids[r]) for (key, _), p, r in zip(pairs, prints, roots)]
    assert brute.rows(simhash_components(docs), *OP8) == brute.ordered(expected)
    kept = one_per_group(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(ids.values())


@pytest.mark.parametrize("bits", [1, 2])
def test_links_equal_all_pairs(spark, bits):
    """Fingerprints a few bits from few centres, and a chain: groups as from all pairs."""
    rnd = random.Random(bits)
    prints = set()
    for _ in range(6):
        centre = rnd.getrandbits(64)
        for _ in range(40):
            prints.add(centre ^ sum({1 << rnd.randrange(64) for _ in range(rnd.randint(0, 4))}))
    step = rnd.getrandbits(64)
    for k in range(25):
        step ^= 1 << rnd.randrange(64)
        prints.add(step)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    roots = {r["node"]: r["root"] for r in star_components(linked_fingerprints(df, bits)).collect()}
    whole = brute.components([p & (1 << 64) - 1 for p in signed], bits)
    assert [roots.get(p, p) for p in signed] == [signed[r] for r in whole]
