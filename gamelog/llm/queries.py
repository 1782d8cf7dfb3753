"""Registered queries of the training-data operators, and SQL for those SQL can state."""

from __future__ import annotations

from gamelog.llm import (adaptive_scan, decontaminate, dual_tree, hamming_dedup, kneser_ney, licenses, mixing, packing, permuterm, pii,
                         sharding, topk, toxicity)

QUERIES = {
    "op1_quality_classifier": kneser_ney.op1_quality_classifier,
    "op2_mixing_rates": mixing.op2_mixing_rates,
    "op3_topk_search": topk.op3_topk_search,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_minhash_near_dedup": hamming_dedup.op5_minhash_near_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_packed_tokens": packing.op7_packed_tokens,
    "op8_pii": pii.op8_pii,
    "op9_extendible_shards": sharding.op9_extendible_shards,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_ranked_search": dual_tree.op11_ranked_search,
    "op12_spelling_variants": permuterm.op12_spelling_variants,
    "op13_nearest_vectors": adaptive_scan.op13_nearest_vectors,
}

ORACLE = {
    "op3_topk_search": topk.OP3_SQL,
    "op4_license_scan": licenses.OP4_SQL,
    "op5_minhash_near_dedup": hamming_dedup.OP5_SQL,
    "op9_extendible_shards": sharding.OP9_SQL,
    "op11_ranked_search": dual_tree.OP11_SQL,
    "op12_spelling_variants": permuterm.OP12_SQL,
}
