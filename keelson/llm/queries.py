"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from keelson.llm import bpe, exact_dedup, hard_negatives, importance, langid, license_scan, minhash, mixing, pii, quality, sharding, substring_dedup, url_filter

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_pii": pii.op2_pii,
    "op3_minhash": minhash.op3_minhash,
    "op4_content_sort": exact_dedup.op4_content_sort,
    "op5_bpe": bpe.op5_bpe,
    "op6_mix": mixing.op6_mix,
    "op7_minimax_shards": sharding.op7_minimax_shards,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_crf_langid": langid.op9_crf_langid,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_url_filter": url_filter.op11_url_filter,
    "op12_importance": importance.op12_importance,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op4_content_sort": exact_dedup.ORACLE,
    "op6_mix": mixing.ORACLE,
    "op10_quality_rules": quality.ORACLE,
    "op11_url_filter": url_filter.ORACLE,
    "op12_importance": importance.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
