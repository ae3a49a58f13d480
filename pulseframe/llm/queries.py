"""The registered queries of the text operators and the SQL that checks them."""

from pulseframe.llm import archives, bpe, decontaminate, hard_negatives, html_text, prefix_trie, quality, secrets_scan, simhash, token_planes, toxicity, vector_search, wordpiece

QUERIES = {
    "op1_bit_planes": token_planes.op1_bit_planes,
    "op2_linear_pieces": wordpiece.op2_linear_pieces,
    "op3_tiled_top_k": vector_search.op3_tiled_top_k,
    "op4_simhash_variants": simhash.op4_simhash_variants,
    "op5_block_rules": html_text.op5_block_rules,
    "op6_co_training": quality.op6_co_training,
    "op7_bpe": bpe.op7_bpe,
    "op8_toxic_spans": toxicity.op8_toxic_spans,
    "op9_arc_to_warc": archives.op9_arc_to_warc,
    "op10_template_windows": decontaminate.op10_template_windows,
    "op11_coordinate_pruning": hard_negatives.op11_coordinate_pruning,
    "op12_credential_links": secrets_scan.op12_credential_links,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLES = {
    "op3_tiled_top_k": vector_search.ORACLE,
    "op9_arc_to_warc": archives.ORACLE,
    "op11_coordinate_pruning": hard_negatives.ORACLE,
    "op12_credential_links": secrets_scan.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
