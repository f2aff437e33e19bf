"""Queries of this subpackage and their SQL, for the driver's contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import dominance, html_extract, media, mixing, packing, periodic, quality_classifier, quality_rules, simhash, substrings, toxicity, url_filters, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": simhash.op1_simhash,
    "op2_warc": warc.op2_warc,
    "op3_mixing": mixing.op3_mixing,
    "op4_media": media.op4_media,
    "op5_packing": packing.op5_packing,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_html_extraction": html_extract.op8_html_extraction,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_url_filters": url_filters.op10_url_filters,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_dominance": dominance.op12_dominance,
    "op13_substring_dedup": substrings.op13_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": warc.OP2_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_dominance": dominance.OP12_SQL,
    "op13_substring_dedup": substrings.OP13_SQL,
}
