"""Merkle manifest, cross-tokenizer alignment and Arrow sequences against plain versions."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from seedweave.llm import alignment, merkle, oracles, sequences
from seedweave.llm.catalog import tokenizer_file
from seedweave.session import table
from tests.llm import brute
from tests.llm.conftest import DOCS, ODD, SF, SMALL

OP11 = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
OP12 = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
OP13 = ["doc_id", "start", "n_tokens", "ids_crc32"]


def piece_file():
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def plain_manifest(rows):
    """OP11 rows by building every level of every tree."""
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, more=0):
        n = None if r["n_chars"] is None else r["n_chars"] + more
        return brute.sha("".join(map(value, (r["doc_id"], r["source"], r["lang"], n, r["text"]))))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([brute.sha("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
        return out

    def up(tree, i, node, met):
        for level in tree[:-1]:
            beside = level[i ^ 1] if i ^ 1 < len(level) else ""
            met += [beside] if beside else []
            node, i = brute.sha(beside + node if i % 2 else node + beside), i // 2
        return node

    trees = defaultdict(list)
    for r in rows:
        trees[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: levels([t[2] for t in sorted(trees[x], key=lambda t: t[:3])]) for x in langs}
    crown = levels([built[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, (known, key, h, r) in enumerate(sorted(trees[x], key=lambda t: t[:3])):
            changed = known and zlib.crc32(str(key).encode()) % 7 == 0
            met = []
            end = up(crown, k, up(built[x], i, leaf(r, 1) if changed else h, met), met)
            out.append((r["doc_id"], h, built[x][-1][0], crown[-1][0], brute.sha("".join(met)), end, end == crown[-1][0]))
    return brute.ordered(out)


@pytest.mark.parametrize("every", [6, 1, 3])
def test_manifest_of_documents(spark, every):
    docs = table(spark, SF, "documents")
    got = brute.rows(merkle.verified_documents(docs, merkle.one_more_char(), every=every), *OP11)
    assert got == plain_manifest(docs.collect())
    assert 0 < sum(not r[-1] for r in got) < len(got) / 4


def test_manifest_sql():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    names = [d[0] for d in con.execute("SELECT * FROM documents").description]
    rows = [dict(zip(names, r)) for r in con.execute("SELECT * FROM documents").fetchall()]
    assert brute.ordered(con.execute(oracles.MERKLE).fetchall()) == plain_manifest(rows)


def odd_rows():
    rows = [Row(doc_id=i, text=t, lang=lang, source=s, n_chars=n) for (i, t), lang, s, n in zip(
        ODD * 3, [None, "", "en", "é", "en", None] * 9, ["a", None, "", "1:a"] * 12, [None, 0, 7, 2 ** 63 - 2] * 12)]
    return rows + rows[:20]


def test_manifest_of_odd_rows(spark, no_docs):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, DOCS).select("*", F.lit(1).alias("tree"), F.lit("x").alias("pos"), F.lit("y").alias("up"))
    assert brute.rows(merkle.verified_documents(docs, merkle.one_more_char(), every=2), *OP11) == plain_manifest(rows)
    one = spark.createDataFrame(rows[3:4], DOCS)
    assert brute.rows(merkle.verified_documents(one), *OP11)[0][-1]
    empty = merkle.verified_documents(no_docs)
    assert empty.columns == OP11 and empty.count() == 0


def test_manifest_finds_every_changed_field(spark):
    docs = table(spark, SMALL, "documents")
    for column, value in (("text", F.concat("text", F.lit(" "))), ("lang", F.lit(None).cast("string")), ("source", F.lit(""))):
        got = merkle.verified_documents(docs, {column: value}).agg(F.max("verified")).first()[0]
        assert got is False
    assert merkle.verified_documents(docs).agg(F.min("verified")).first()[0] is True


def test_stored_levels_are_few(spark):
    leaves = spark.range(1000).select(F.lit("t").alias("tree"), "id", F.sha2(F.col("id").cast("string"), 256).alias("digest"),
                                      F.struct("id").alias("row"))
    manifest = merkle.write_manifest(leaves, "id", every=5)
    assert [x.count() for x in manifest.trees.levels] == [1000, 32, 1]
    assert manifest.root() == manifest.proofs().select(merkle.fold(F.col("leaf"), F.col("up"))).distinct().first()[0]
    assert manifest.proofs().select(F.size("up")).distinct().first()[0] == 10


def plain_alignment(pairs):
    """OP12 rows by walking both token rows."""
    import sentencepiece
    from tokenizers import Tokenizer
    first, second = Tokenizer.from_file(tokenizer_file()), sentencepiece.SentencePieceProcessor(model_file=piece_file())
    first.encode_special_tokens = True
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    docs = []
    for key, text in pairs:
        a, b, groups = [], [], []
        if text:
            a = [(i, bytes(byte[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode())
                 for i, p in ((i, second.id_to_piece(i)) for i in second.encode(text))]
            if not b"".join(w for _, w in a) == b"".join(w for _, w in b) == (" " + text).encode():
                a, b = [], []
        at_a, at_b, x, y, todo = 0, 0, [], [], iter(b)
        for i, w in a:
            at_a += len(w)
            x.append(i)
            while at_b < at_a:
                j, v = next(todo)
                at_b += len(v)
                y.append(j)
            if at_a == at_b:
                groups.append((x, y))
                x, y = [], []
        docs.append((key, len(a), len(b), groups, Counter((i, j) for g, h in groups for i in g for j in h)))
    count = Counter(p for d in docs for p in d[4])
    high = defaultdict(int)
    for (i, _), n in count.items():
        high[i] = max(high[i], n)
    text = lambda groups: ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
    return brute.ordered([(key, n, m, len(g), sum(c.values()), sum(k for p, k in c.items() if count[p] == high[p[0]]),
                           sum(k * count[p] for p, k in c.items()), brute.sha(text(g)) if g else "") for key, n, m, g, c in docs])


def align(docs, **kw):
    return alignment.align_documents(docs, tokenizer_file(), piece_file(), **kw)


def test_alignment_of_documents(spark):
    docs = table(spark, SF, "documents")
    expected = plain_alignment([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert brute.rows(align(docs), *OP12) == expected
    assert brute.rows(align(docs, chunk_chars=300_000, slice_chars=40_000, run=5), *OP12) == expected


def test_alignment_of_odd_rows(odd_docs, no_docs, make_docs):
    assert brute.rows(align(odd_docs.withColumn("chunk", F.lit(1)).withColumn("pairs", F.lit("x"))), *OP12) == plain_alignment(ODD)
    assert align(no_docs).count() == 0 and align(no_docs).columns == OP12
    odd = [(1, "a▁b"), (2, "▁"), (3, "\x00\x01 ﻿"), (4, "<s> </s> <unk> <0x41> <|endoftext|>"), (5, "éè" * 700),
           (6, "\n" * 999 + " " * 777 + "\t" * 555), (7, "😀🏽" * 300), (8, "x"), (9, " "), (10, None), (11, "")]
    assert brute.rows(align(make_docs(odd), slice_chars=1), *OP12) == plain_alignment(odd)


def test_wide_groups_are_counted_by_distinct_ids(make_docs, monkeypatch):
    pairs = [(k, " ".join(random.Random(k).choice(["été", "naïve", "straße", "中文", "😀", "cat"]) for _ in range(200))) for k in range(20)]
    monkeypatch.setattr(alignment, "WIDE", 1)
    t = alignment.Tokenizers(tokenizer_file(), piece_file())
    rows = list(alignment.aligned_slice(t, [x for _, x in pairs]))
    monkeypatch.undo()
    for got, exp in zip(rows, alignment.aligned_slice(t, [x for _, x in pairs], run=3)):
        assert got[:5] == exp[:5] and (got[5] == exp[5]).all() and (got[6] == exp[6]).all()


def test_lockstep_on_made_up_ends():
    rnd = random.Random(3)
    for _ in range(200):
        ends, first = ([], []), [0]
        base = 0
        for _ in range(rnd.randint(1, 6)):
            n = rnd.randint(1, 60)
            for side in ends:
                side += [base + x for x in sorted(rnd.sample(range(1, n), rnd.randint(0, n - 1))) + [n]]
            base += n
            first.append(len(ends[0]))
        a, b = map(np.array, ends)
        groups, link_a, link_b = alignment.lockstep(a, b, np.array(first), rnd.randint(1, 20))
        cuts = np.intersect1d(a, b)
        assert (a[groups[0] + groups[2] - 1] == cuts).all() and (b[groups[1] + groups[3] - 1] == cuts).all()
        assert (groups[0] == np.append(0, np.searchsorted(a, cuts)[:-1] + 1)).all()
        assert Counter(zip(link_a.tolist(), link_b.tolist())) == Counter(
            (i, j) for i in range(len(a)) for j in range(len(b)) if np.searchsorted(cuts, a[i]) == np.searchsorted(cuts, b[j]))


def plain_starts(pairs):
    from tokenizers import Tokenizer
    reference, start, out = Tokenizer.from_file(tokenizer_file()), 0, []
    for key, text in pairs:
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((key, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return brute.ordered(out)


def test_sequences_of_documents(spark):
    docs = table(spark, SF, "documents")
    pairs = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    expected = plain_starts(pairs)
    assert brute.rows(sequences.round_trip(docs, tokenizer_file()), *OP13) == expected
    assert brute.rows(sequences.round_trip(docs, tokenizer_file(), length=100, batch=3, shard_bytes=20_000), *OP13) == expected


def test_sequences_of_odd_rows(odd_docs, no_docs):
    got = brute.rows(sequences.round_trip(odd_docs.withColumn("shard", F.lit("x")).withColumn("hash", F.lit(1)), tokenizer_file(),
                                          length=16, batch=2), *OP13)
    # The order among rows of one id is not fixed; starts follow from the sizes.
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in plain_starts(ODD))
    assert [r[0] for r in sorted(got, key=lambda r: r[1])] == sorted((k for k, _ in ODD), key=lambda k: (k is not None, k))
    at = 0
    for r in sorted(got, key=lambda r: r[1]):
        assert r[1] == at
        at += r[2]
    empty = sequences.round_trip(no_docs, tokenizer_file())
    assert empty.columns == OP13 and empty.count() == 0


def test_files_give_views_at_any_place(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    shards = sequences.write_sequences(docs, tokenizer_file(), folder=str(tmp_path), length=64, batch=5).orderBy("shard").collect()
    assert sum(r["n_docs"] for r in shards) == docs.count() and len(shards) > 1
    ids_of = {r["doc_id"]: r["text"] for r in docs.collect()}
    bpe = sequences.byte_bpe(tokenizer_file())
    expected = [i for k in sorted(ids_of) for i in [*bpe.encode(ids_of[k] or ""), 0]]
    found, docs_found = [], []
    for r in shards:
        shard = sequences.Shard(r["file"])
        assert len(shard) == r["n_sequences"]
        for i in reversed(range(len(shard))):
            ids, mask = shard.ids(i), shard.mask(i)
            assert len(ids) == len(mask) == 64 and ids.dtype == np.uint16 and not ids.flags.owndata
            # The same bytes each time, no copy.
            assert shard.ids(i).__array_interface__["data"][0] == ids.__array_interface__["data"][0]
            assert shard.mask(i).buffers()[1].address == mask.buffers()[1].address
        for i in range(len(shard)):
            found += shard.ids(i)[shard.mask(i).to_numpy(zero_copy_only=False)].tolist()
            assert i == len(shard) - 1 or shard.mask(i).true_count == 64
        docs_found += [d for d, _ in shard.documents()]
        with pytest.raises(IndexError):
            shard.ids(len(shard))
        shard.close()
    assert found == expected and docs_found == sorted(ids_of)


def test_files_that_no_row_names_are_not_read(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    shards = sequences.write_sequences(docs, tokenizer_file(), folder=str(tmp_path))
    (tmp_path / "shard-000000-left-over.arrow").write_bytes(b"half a file")
    field = docs.schema["doc_id"]
    assert sequences.read_documents(shards, lambda ids: (), [], field).count() == docs.count()
