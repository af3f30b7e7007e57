"""Queries of the corpus operators and the SQL of those that SQL can express."""

from strandlake.llm import decontaminate, importance, jaccard_join, lexical_search, line_dedup, piece_sampling, pii, quality_rules, source_mix, spelling, substring_dedup, token_binary, url_filter

QUERIES = {
    "op2_piece_sampling": piece_sampling.op2,
    "op8_substring_dedup": substring_dedup.op8,
    "op4_jaccard_join": jaccard_join.op4,
    "op3_decontaminate": decontaminate.op3,
    "op1_importance": importance.op1,
    "op5_url_filter": url_filter.op5,
    "op7_pii": pii.op7,
    "op9_token_binary": token_binary.op9,
    "op10_quality_rules": quality_rules.op10,
    "op6_line_dedup": line_dedup.op6,
    "op11_lexical_search": lexical_search.op11,
    "op12_spelling": spelling.op12,
    "op13_source_mix": source_mix.op13,
}
ORACLES = {
    "op8_substring_dedup": substring_dedup.ORACLE,
    "op4_jaccard_join": jaccard_join.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op11_lexical_search": lexical_search.ORACLE,
    "op12_spelling": spelling.ORACLE,
    "op13_source_mix": source_mix.ORACLE,
}
