"""The queries of this package and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from tesserine.llm import bpe_codec, embedding_dedup, language, line_dedup, near_dedup, nearest, packing, secrets, substring_dedup, toxicity

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_language_id": language.op2_language_id,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_packing": packing.op4_packing,
    "op5_nearest_neighbours": nearest.op5_nearest_neighbours,
    "op6_minhash_near_dedup": near_dedup.op6_minhash_near_dedup,
    "op7_bpe_codec": bpe_codec.op7_bpe_codec,
    "op8_embedding_near_dedup": embedding_dedup.op8_embedding_near_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}
ORACLE_SQL = {
    "op6_minhash_near_dedup": near_dedup.SQL,
    "op8_embedding_near_dedup": embedding_dedup.SQL,
}


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline
