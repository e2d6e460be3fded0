"""Every stage of the pipeline against brute force on what the stage before it kept."""

import corpus_pipeline
from seedweave.llm.catalog import tokenizer_file
from seedweave.llm.shared import written
from seedweave.session import table
from tests.llm import brute
from tests.llm.conftest import SF


def test_stages(spark):
    docs = table(spark, SF, "documents")
    cols = docs.columns
    (n9, quality), (n8, simhash), (n7, suffix), (n10, packing) = corpus_pipeline.STAGES
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}

    before = rows(docs)
    a = written(quality(spark, docs, SF), n9)
    kept = rows(a)
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    assert a.columns == cols and all(kept[k] == before[k] for k in kept)
    fine = {k for k, r in before.items() if not brute.measures(r["text"])[5]}
    assert set(kept) <= fine
    clean = [k for k in fine if labels.get(k) == 1]
    assert sum(k not in kept for k in clean) <= 0.02 * len(clean)

    b = written(simhash(spark, a, SF), n8)
    left = rows(b)
    ids = sorted(kept)
    roots = brute.components([brute.simhash(kept[k]["text"]) for k in ids])
    assert b.columns == cols and set(left) == {ids[r] for r in roots} and all(left[k] == kept[k] for k in left)

    c = written(suffix(spark, b, SF), n7)
    cut = rows(c)
    pairs = [(k, left[k]["text"]) for k in sorted(left)]
    assert c.columns == cols and set(cut) == set(left)
    for key, _, removed, _, sha in brute.byte_strings(pairs, 200):
        r = cut[key]
        assert r["n_chars"] == len(r["text"]) and (r["lang"], r["source"]) == (left[key]["lang"], left[key]["source"])
        if not removed:
            assert r["text"] == left[key]["text"]
        elif "\ufffd" not in r["text"] and len(r["text"].encode()) + removed == len(left[key]["text"].encode()):
            assert brute.sha(r["text"]) == sha

    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_file())
    got = brute.rows(packing(spark, c, SF), "doc_id", "piece", "start", "length", "ids_crc32")
    assert got == brute.ordered([(k, *p) for k, r in cut.items()
                                 for p in brute.pieces(t.encode(r["text"], add_special_tokens=False).ids)])


def test_run_and_registration(spark):
    import __spark_entry__ as entry
    names = [f"op{n}_" for n in range(1, 11)]
    qs = entry.queries()
    assert all(sum(q.startswith(n) for q in qs) == 1 for n in names) and "pipeline" in qs
    assert qs["pipeline"](spark, "/root/testdata/sf0.001").count() > 0


def test_empty_documents_pass_all_stages(spark, no_docs):
    docs = no_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
    assert docs.count() == 0


def test_odd_documents_pass_all_stages(spark, odd_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
    docs = odd_docs                    # the rules reject them all; the other stages get them as they are
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = written(stage(spark, docs, SF), name)
    assert {r["doc_id"] for r in docs.collect()} == {None, 1, 4, 5, 7, 8, 9, 10}
