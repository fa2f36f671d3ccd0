"""The registered queries of the training-data operators and their SQL."""

from . import fingerprints, line_dedup, mixing, packing, pii, quality, simhash_near, substring_dedup, suffix_dedup, token_shards

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_token_shards": token_shards.op3_token_shards,
    "op4_pii": pii.op4_pii,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_simhash_near_dedup": simhash_near.op6_simhash_near_dedup,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}

ORACLE_SQL = {
    "op2_line_dedup": line_dedup.OP2_SQL,
}
