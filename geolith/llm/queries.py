"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from geolith.llm import block_max, bpe, exact_dedup, fill_middle, html_text, jaccard_join, kdtree_search, language_id, line_dedup, ordered_packing, packing, quality, tokenfile

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_bpe": bpe.op2_bpe,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_kdtree_search": kdtree_search.op4_kdtree_search,
    "op5_token_file": tokenfile.op5_token_file,
    "op6_language_id": language_id.op6_language_id,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_html_text": html_text.op9_html_text,
    "op10_packing": packing.op10_packing,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_ordered_packing": ordered_packing.op12_ordered_packing,
    "op13_block_max": block_max.op13_block_max,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {
        "op3_jaccard_join": jaccard_join.SQL,
        "op4_kdtree_search": kdtree_search.SQL,
        "op7_exact_dedup": exact_dedup.SQL,
        "op8_line_dedup": line_dedup.SQL,
        "op11_fill_middle": fill_middle.SQL,
        "op13_block_max": block_max.SQL,
    }
