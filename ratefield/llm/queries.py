"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from ratefield.llm import decontaminate, line_dedup, mixing, ngram_join, oracles, packing, pii, quality, secrets, sketches, token_store, toxicity, trie, whitening


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_pii_surrogates": pii.query,
    "op2_ngram_jaccard_join": ngram_join.query,
    "op3_token_store": token_store.query,
    "op4_document_fingerprints": sketches.query,
    "op5_source_mixing": mixing.query,
    "op6_pack_sequences": packing.query,
    "op7_line_dedup": line_dedup.query,
    "op8_quality_ratio": quality.query,
    "op9_nearest_toxicity": toxicity.query,
    "op10_secret_scan": secrets.query,
    "op11_benchmark_decontamination": decontaminate.query,
    "op12_conversation_trie": trie.query,
    "op13_embedding_whitening": whitening.query,
    "pipeline": _pipeline,
} | oracles.QUERIES

ORACLES = oracles.ORACLES
