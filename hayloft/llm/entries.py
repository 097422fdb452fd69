"""Registered queries of the llm operators."""

from __future__ import annotations

from . import bitsliced, bpe, chat, decontaminate, divergence, imatch, jaccard_join, language, quality, secret_scan, sharding, spelling, token_count

QUERIES = {
    "op1_jaccard_lsh_forest": jaccard_join.op1_jaccard_lsh_forest,
    "op2_secrets_crf": secret_scan.op2_secrets_crf,
    "op3_shard_virtual_slots": sharding.op3_shard_virtual_slots,
    "op4_topk_bitsliced": bitsliced.op4_topk_bitsliced,
    "op5_chat_parts": chat.op5_chat_parts,
    "op6_language_ecoc": language.op6_language_ecoc,
    "op7_quality_qda": quality.op7_quality_qda,
    "op8_token_count_scan": token_count.op8_token_count_scan,
    "op9_bpe_segment_tree": bpe.op9_bpe_segment_tree,
    "op10_decontaminate_prefix_join": decontaminate.op10_decontaminate_prefix_join,
    "op11_divergence_runs": divergence.op11_divergence_runs,
    "op12_imatch_subsets": imatch.op12_imatch_subsets,
    "op13_spelling_tiles": spelling.op13_spelling_tiles,
}

ORACLE_SQL = {
    "op1_jaccard_lsh_forest": jaccard_join.ORACLE_SQL,
    "op4_topk_bitsliced": bitsliced.ORACLE_SQL,
    "op5_chat_parts": chat.ORACLE_SQL,
    "op10_decontaminate_prefix_join": decontaminate.ORACLE_SQL,
    "op11_divergence_runs": divergence.ORACLE_SQL,
    "op13_spelling_tiles": spelling.ORACLE_SQL,
}
