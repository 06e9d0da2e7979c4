"""Queries of this subpackage and their SQL, for the driver's entry point."""

from __future__ import annotations

from . import exact_dedup, html_extraction, jaccard_join, language_id, license_scan, mixing, quality_rules, sentencepiece_dropout, substring_dedup, toxicity


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_sentencepiece": sentencepiece_dropout.op6_sentencepiece,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_html_extraction": html_extraction.op9_html_extraction,
    "op10_mixing": mixing.op10_mixing,
    "pipeline": pipeline,
}
SQL = {
    "op3_license_scan": license_scan.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op5_jaccard_join": jaccard_join.SQL,
    "op7_substring_dedup": substring_dedup.SQL,
    "op8_quality_rules": quality_rules.SQL,
}
