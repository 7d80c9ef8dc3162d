"""The registered queries of the operators, and their SQL."""

from __future__ import annotations

from . import conversation_repair, decontamination, language_id, line_dedup, minhash_dedup, ngram_join, periodic_runs, quality_classifier, quality_rules, secret_scan, source_mixing, substring_dedup, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1,
    "op2_quality_rules": quality_rules.op2,
    "op3_source_mixing": source_mixing.op3,
    "op4_toxicity": toxicity.op4,
    "op5_decontamination": decontamination.op5,
    "op6_ngram_join": ngram_join.op6,
    "op7_substring_dedup": substring_dedup.op7,
    "op8_secret_scan": secret_scan.op8,
    "op9_language_id": language_id.op9,
    "op10_quality_classifier": quality_classifier.op10,
    "op11_minhash_dedup": minhash_dedup.op11,
    "op12_conversation_repair": conversation_repair.op12,
    "op13_periodic_runs": periodic_runs.op13,
}
SQL = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op7_substring_dedup": substring_dedup.OP7_SQL,
    "op8_secret_scan": secret_scan.OP8_SQL,
    "op12_conversation_repair": conversation_repair.OP12_SQL,
    "op13_periodic_runs": periodic_runs.OP13_SQL,
}
