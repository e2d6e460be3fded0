"""Registered queries of the operators (``opN_<name>`` and ``pipeline``) and their DuckDB SQL."""

from __future__ import annotations

from seedweave.llm import oracles
from seedweave.session import table


def tokenizer_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_level_wise_doubling(spark, sf_dir):
    from seedweave.llm.substring import remove_repeated_windows
    return remove_repeated_windows(table(spark, sf_dir, "documents"))


def op2_bounded_ring_shards(spark, sf_dir):
    from seedweave.llm.sharding import shard_documents
    return shard_documents(table(spark, sf_dir, "documents"))


def op3_content_defined_chunks(spark, sf_dir):
    from seedweave.llm.fingerprint import neighbour_fingerprints
    return neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op4_tree_concatenated_bpe(spark, sf_dir):
    from seedweave.llm.bpe import encode_digests
    return encode_digests(table(spark, sf_dir, "documents"), tokenizer_file())


def op5_composite_text_density(spark, sf_dir):
    from seedweave.llm.html import extract_pages
    return extract_pages(table(spark, sf_dir, "pages"))


def op6_url_language_model(spark, sf_dir):
    from seedweave.llm.urls import judge_urls
    return judge_urls(table(spark, sf_dir, "pages")).drop("score")


def op9_risk_controlled_rules(spark, sf_dir):
    from seedweave.llm.quality import quality_report
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_prefix_doubling(spark, sf_dir):
    from seedweave.llm.suffix import remove_repeated_strings
    return remove_repeated_strings(table(spark, sf_dir, "documents"))


def op8_simhash_byte_index(spark, sf_dir):
    from seedweave.llm.simhash import simhash_components
    return simhash_components(table(spark, sf_dir, "documents"))


def op10_sum_of_squares_packing(spark, sf_dir):
    from seedweave.llm.packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())


def op11_checkpoint_and_recompute(spark, sf_dir):
    from seedweave.llm.merkle import one_more_char, verified_documents
    return verified_documents(table(spark, sf_dir, "documents"), one_more_char())


def op12_lockstep_alignment(spark, sf_dir):
    import public_tokenizers

    from seedweave.llm.alignment import align_documents
    return align_documents(table(spark, sf_dir, "documents"), tokenizer_file(), public_tokenizers.path("piece_bpe_32k.model"))


def op13_arrow_sequences(spark, sf_dir):
    from seedweave.llm.sequences import round_trip
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_file())


def queries() -> dict:
    import corpus_pipeline
    return {n: f for n, f in globals().items() if n.startswith("op") and callable(f)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op6_url_language_model": oracles.URLS, "op9_risk_controlled_rules": oracles.QUALITY,
            "op11_checkpoint_and_recompute": oracles.MERKLE}
