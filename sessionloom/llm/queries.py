"""The registered queries of the subpackage and those of their SQL twins that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sessionloom.llm import classifier, decontaminate, golay, importance, langid, neardup, packing, quality, rtree, secrets, substrings, suffixes, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": langid.op1_language_id,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_suffix_dedup": suffixes.op3_suffix_dedup,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_near_duplicates": neardup.op6_near_duplicates,
    "op7_warc_archive": warc.op7_warc_archive,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_quality_classifier": classifier.op9_quality_classifier,
    "op10_curve_packing": packing.op10_curve_packing,
    "op11_importance_resampling": importance.op11_importance_resampling,
    "op12_hard_negatives": rtree.op12_hard_negatives,
    "op13_golay_near_duplicates": golay.op13_golay_near_duplicates,
}
ORACLES: dict[str, str] = {
    "op3_suffix_dedup": suffixes.OP3_SQL,
    "op4_substring_dedup": substrings.OP4_SQL,
    "op7_warc_archive": warc.OP7_SQL,
    "op11_importance_resampling": importance.OP11_SQL,
    "op12_hard_negatives": rtree.OP12_SQL,
}
