"""The queries and SQL of these operators, by name."""

from __future__ import annotations

from . import credentials, decision_list, filter_audit, mixing, near_copies, packing, repeats, rule_ensemble, sharding, spelling, token_counts, top_k, toxicity

QUERIES = {
    "op1_mix_hash_threshold": mixing.op1_mix,
    "op2_shard_feistel": sharding.op2_shard,
    "op3_near_copies_chosen_path": near_copies.op3_near_copies,
    "op4_remove_repeats": repeats.op4_repeats,
    "op5_token_prefix_counts": token_counts.op5_tokens,
    "op6_pack_length_buckets": packing.op6_pack,
    "op7_search_ball_tree": top_k.op7_search,
    "op8_toxicity_crf": toxicity.op8_toxicity,
    "op9_quality_decision_list": decision_list.op9_quality,
    "op10_quality_rule_ensemble": rule_ensemble.op10_quality,
    "op11_spelling_errata_trie": spelling.op11_spelling,
    "op12_secret_links": credentials.op12_credentials,
    "op13_filter_audit": filter_audit.op13_audit,
    "quality_base_columns": decision_list.quality_base_columns,
}

ORACLES = {
    "op1_mix_hash_threshold": mixing.OP1_SQL, "quality_base_columns": decision_list.BASE_SQL, "op6_pack_length_buckets": packing.OP6_SQL, "op7_search_ball_tree": top_k.OP7_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
