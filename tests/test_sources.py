"""Readers and writers of the side inputs."""

import json
import os
import tempfile


def test_seed_dictionary_plain_and_double_encoded(spark):
    from seedweave.sources.dictionaries import read_seed_dictionary
    d = tempfile.mkdtemp(dir="/tmp")
    seeds = {"a": ["x", "y"], "b": ["z"]}
    with open(os.path.join(d, "it0.json"), "w") as f:
        json.dump(seeds, f)
    with open(os.path.join(d, "it1.json"), "w") as f:
        json.dump(json.dumps(seeds), f)  # JSON inside a JSON string (Q9)
    rows = {(r.file, r.label, r.word, r.pos) for r in read_seed_dictionary(spark, d).collect()}
    for fn in ("it0.json", "it1.json"):
        assert {(fn, "a", "x", 0), (fn, "a", "y", 1), (fn, "b", "z", 0)} <= rows


def test_all_dictionaries_of_a_folder_in_name_order(spark):
    from seedweave.sources.dictionaries import read_seed_dictionaries
    d = tempfile.mkdtemp(dir="/tmp")
    for name, words in (("it1.json", ["y"]), ("it0.json", ["x"]), ("it10.json", ["z", "w"])):
        with open(os.path.join(d, name), "w") as f:
            json.dump({"a": words}, f)
    rows = read_seed_dictionaries(spark, d).collect()
    assert sorted((r.iteration, r.file, r.pos, r.word) for r in rows) == [
        (0, "it0.json", 0, "x"), (1, "it1.json", 0, "y"), (2, "it10.json", 0, "z"), (2, "it10.json", 1, "w")]


def test_tokenizer_of_the_production_matchers_is_a_parameter(spark):
    from pyspark.sql import functions as F

    from seedweave.operators import match
    from seedweave.sources.dictionaries import seeds_from_dict
    docs = spark.createDataFrame([(1, "a|b c|d"), (2, "c"), (3, None)], "doc_id long, text string")
    seeds = seeds_from_dict(spark, {"x": ["b c"], "y": ["c"]})
    bars = lambda c: F.split(c, r"\|")
    got = match.production_labels(docs, "text", seeds, 2, tokenizer=bars)
    assert sorted((r.doc_id, r.label) for r in got.collect()) == [(1, "x"), (2, "y")]
    ids = spark.createDataFrame([("x", 1), ("y", 2)], "tag string, tag_id int")
    links = spark.createDataFrame([], "src int, dst int")
    tags = match.tag_matches(docs, "text", seeds.withColumnRenamed("label", "tag"), ids, links, tokenizer=bars)
    assert sorted((r.doc_id, r.tag_id) for r in tags.collect()) == [(1, 1), (2, 2)]


def test_write_and_read_back_per_iteration(spark):
    from pyspark.sql import functions as F

    from seedweave.sources.dictionaries import read_seed_dictionary, seeds_from_dict, write_seed_dictionary
    out = tempfile.mkdtemp(dir="/tmp") + "/dicts"
    s = seeds_from_dict(spark, {"a": ["x", "y"], "b": ["z"]}).withColumn("iteration", F.lit(3))
    write_seed_dictionary(s, out)
    back = read_seed_dictionary(spark, out + "/iteration=3")
    assert sorted((r.label, r.word, r.pos) for r in back.collect()) == [("a", "x", 0), ("a", "y", 1), ("b", "z", 0)]


def test_tag_links_and_external_map(spark):
    from seedweave.sources.dictionaries import read_external_map, read_tag_links
    d = tempfile.mkdtemp(dir="/tmp")
    with open(d + "/links.json", "w") as f:
        json.dump({"1": [2, 3], "4": []}, f)
    with open(d + "/ext.json", "w") as f:
        json.dump({"robots": {"vertical": [1], "tag": [7, 8]}}, f)
    assert sorted((r.src, r.dst) for r in read_tag_links(spark, d + "/links.json").collect()) == [(1, 2), (1, 3)]
    r = read_external_map(spark, d + "/ext.json").first()
    assert (r.key, list(r.vertical), list(r.tag)) == ("robots", [1], [7, 8])


def test_mapping_sheet_flag(spark):
    from seedweave.sources.dictionaries import read_mapping_sheet
    d = tempfile.mkdtemp(dir="/tmp")
    with open(d + "/map.csv", "w") as f:
        f.write("source,target,flag\nweb,Software,1\nsteel,Mining,0\n")
    assert [(r.source, r.target) for r in read_mapping_sheet(spark, d + "/map.csv").collect()] == [("web", "Software")]


def test_job_tables_read_back(spark, tmp_path):
    """What a job leaves is what the next one reads."""
    from pyspark.sql import functions as F

    from seedweave.functions.text import merge_seed_bigrams, strip_punctuation
    from seedweave.sources import runs, tables
    from seedweave.sources.dictionaries import seeds_from_dict
    at = lambda name: str(tmp_path / name)

    v = spark.createDataFrame([("cat", 1, [1.0, 0.0]), ("cat", 2, [0.5, 0.5]), ("it's", 3, [0.0, 1.0])],
                              "word string, vec_id int, vec array<double>")
    tables.write_vectors(v, at("vec"), buckets=4)
    asked = spark.createDataFrame([("cat!",), ("it's",), ("dog",)], "word string")
    got = {(r.asked, r.word, r.vec_id) for r in tables.read_vectors(spark, at("vec"), asked, strip_punctuation).collect()}
    assert got == {("cat!", "cat", 1), ("cat!", "cat", 2), ("it's", "it's", 3)}

    c = spark.createDataFrame([("cat", 0, [1.0, 0.0])], "word string, sense int, center array<double>")
    tables.write_senses(c, at("senses"))
    assert tables.read_senses(spark, at("senses")).collect() == c.collect()

    voc = spark.createDataFrame([("cat", 1), ("dog", 2)], "word string, idx int")
    tables.write_vocabulary(voc, v.where("vec_id <> 2").select("word", "vec"), at("voc"))
    assert {(r.word, r.idx, r.vec is None) for r in tables.read_vocabulary(spark, at("voc")).collect()} == \
        {("cat", 1, False), ("dog", 2, True)}

    _, pairs = merge_seed_bigrams(seeds_from_dict(spark, {"x": ["a", "new york"], "y": ["new york"]}))
    tables.write_bigrams(pairs, at("big"))
    assert [tuple(r) for r in tables.read_bigrams(spark, at("big")).collect()] == [("new york", "jj0")]

    tables.write_corpus(voc, at("corpus"))
    assert sorted(spark.read.parquet(at("corpus")).collect()) == sorted(voc.collect())

    rep = spark.createDataFrame([("de", 1.0, 0.5, 0.6, 4)], "label string, precision double, recall double, f1 double, support long")
    for run, it in (("a", 0), ("a", 1), ("b", 0), ("a", 1)):
        runs.write_round(rep, at("hist"), run, it)
    assert runs.read_runs(spark, at("hist"), ["a"]).select("run", "iteration").orderBy("iteration").collect() == [("a", 0), ("a", 1)]
    runs.write_dictionary(seeds_from_dict(spark, {"x": ["w"]}).withColumn("extra", F.lit(1)), at("dict"), "a", 0)
    assert [tuple(r) for r in runs.read_runs(spark, at("dict"), schema=runs.DICTIONARY_SCHEMA).collect()] == [("x", "w", "a", 0)]
