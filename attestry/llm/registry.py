"""The registered queries of the subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from attestry.llm import alignment, bpe, exact_dedup, filter_audit, language_id, mixing, packing, quality, simhash, substring_dedup, suffix_dedup, topk_search, url_filters


def queries() -> dict:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_topk_search": topk_search.op2_topk_search,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_packing": packing.op5_packing,
        "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
        "op7_mix_sources": mixing.op7_mix_sources,
        "op8_quality_classifier": quality.op8_quality_classifier,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_url_filters": url_filters.op10_url_filters,
        "op11_token_alignment": alignment.op11_token_alignment,
        "op12_bpe_codec": bpe.op12_bpe_codec,
        "op13_filter_audit": filter_audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_topk_search": topk_search.SQL,
        "op3_substring_dedup": substring_dedup.SQL,
        "op7_mix_sources": mixing.SQL,
        "op9_exact_dedup": exact_dedup.SQL,
        "op10_url_filters": url_filters.SQL,
        "op13_filter_audit": filter_audit.SQL,
    }
