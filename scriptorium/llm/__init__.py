"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

from . import ann, embeddings, language_id, middles, minhash, mixing, packing, quality, secrets, substrings, suffixes, token_counts, whitening

QUERIES = {
    "op1_minhash_near_duplicates": minhash.op1_minhash_near_duplicates,
    "op2_quality": quality.op2_quality,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_suffix_dedup": suffixes.op5_suffix_dedup,
    "op6_pack": packing.op6_pack,
    "op7_nearest_neighbours": ann.op7_nearest_neighbours,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_embedding_near_duplicates": embeddings.op9_embedding_near_duplicates,
    "op10_language_id": language_id.op10_language_id,
    "op11_whitening": whitening.op11_whitening,
    "op12_secrets": secrets.op12_secrets,
    "op13_fill_in_middle": middles.op13_fill_in_middle,
}
ORACLES = {"op4_substring_dedup": substrings.OP4_SQL, "op8_mix_sources": mixing.OP8_SQL, "op9_embedding_near_duplicates": embeddings.OP9_SQL, "op13_fill_in_middle": middles.OP13_SQL}
