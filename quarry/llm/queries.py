"""The queries of this subpackage and, where SQL can say it, the SQL that returns the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import fingerprints, licenses, line_dedup, ngram_join, packing, quality_rules, secrets, sentencepieces, sharding, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": licenses.query,
    "op2_ngram_join": ngram_join.query,
    "op3_fingerprints": fingerprints.query,
    "op4_packing": packing.query,
    "op5_sharding": sharding.query,
    "op6_sentencepiece": sentencepieces.query,
    "op7_line_dedup": line_dedup.query,
    "op8_quality_rules": quality_rules.query,
    "op9_secrets": secrets.query,
    "op10_toxicity": toxicity.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": ngram_join.oracle_sql(),
    "op7_line_dedup": line_dedup.oracle_sql(),
    "op8_quality_rules": quality_rules.oracle_sql(),
}
