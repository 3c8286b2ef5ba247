"""The queries of this subpackage and the SQL of those that SQL can express."""

from larder.llm import chat_roles, factor_machine, mixing, negatives, ngram_join, quality, repeats, sentence_pieces, token_counts, token_files, top_k, toxicity, whitening

QUERIES = {
    "op1_toxicity_grammar": toxicity.op1_toxicity_grammar,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_pareto_mix": mixing.op3_pareto_mix,
    "op4_signature_tree": ngram_join.op4_signature_tree,
    "op5_column_suffix_order": repeats.op5_column_suffix_order,
    "op6_prefix_table": sentence_pieces.op6_prefix_table,
    "op7_token_files": token_files.op7_token_files,
    "op8_branch_and_bound": top_k.op8_branch_and_bound,
    "op9_role_repair": chat_roles.op9_role_repair,
    "op10_decision_list": quality.op10_decision_list,
    "op11_block_whitening": whitening.op11_block_whitening,
    "op12_factor_machine": factor_machine.op12_factor_machine,
    "op13_packed_tree_negatives": negatives.op13_packed_tree_negatives,
}
SQL = {
    "op3_pareto_mix": mixing.OP3_SQL,
    "op4_signature_tree": ngram_join.OP4_SQL,
    "op5_column_suffix_order": repeats.OP5_SQL,
    "op8_branch_and_bound": top_k.OP8_SQL,
    "op13_packed_tree_negatives": negatives.OP13_SQL,
}
