"""The registered queries of this subpackage and their SQL."""

from graphloom.llm import bpe, embedding_dedup, html_text, line_dedup, mixing, quality, simhash, substring_dedup, topk, url_rules

QUERIES = {
    "op1_html_text": html_text.op1,
    "op2_embedding_dedup": embedding_dedup.op2,
    "op3_simhash": simhash.op3,
    "op4_line_dedup": line_dedup.op4,
    "op5_substring_dedup": substring_dedup.op5,
    "op6_mixing": mixing.op6,
    "op7_quality": quality.op7,
    "op8_url_rules": url_rules.op8,
    "op9_topk": topk.op9,
    "op10_bpe": bpe.op10,
}
ORACLES = {
    "op2_embedding_dedup": embedding_dedup.OP2_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op5_substring_dedup": substring_dedup.OP5_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op8_url_rules": url_rules.OP8_SQL,
    "op9_topk": topk.OP9_SQL,
}
