"""The queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from . import ann, bpe, line_dedup, lm_scoring, near_dedup, packing, quality_rules, site_quality, toxicity, url_filters

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_url_filters": url_filters.op2_url_filters,
    "op3_minhash_near_dedup": near_dedup.op3_minhash_near_dedup,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_nearest_neighbours": ann.op8_nearest_neighbours,
    "op9_site_quality": site_quality.op9_site_quality,
    "op10_packing": packing.op10_packing,
}

ORACLE_SQL = {"op1_line_dedup": line_dedup.SQL, "op2_url_filters": url_filters.SQL}
