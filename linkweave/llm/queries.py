"""The queries of this subpackage, each over its whole table, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkweave.llm import licenses, quality, quality_rules, sharding, toxicity
from linkweave.llm.decontaminate import contamination
from linkweave.llm.near_dedup import near_duplicates
from linkweave.llm.secrets import scan
from linkweave.llm.sql_decontaminate import SQL as CONTAMINATION_SQL
from linkweave.llm.sql_near_dedup import SQL as NEAR_SQL
from linkweave.llm.support import table
from linkweave.llm.token_counts import token_counts
from linkweave.llm.unigram import encode_decode

Query = Callable[[SparkSession, str], DataFrame]


def op1_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.with_paths(table(spark, sf_dir, "documents")))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_weak_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op5_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op6_novelty_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op7_unigram_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))


def op8_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_automaton_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_virtual_slot_sharding": op1_virtual_slot_sharding,
    "op2_license_scans": op2_license_scans,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_weak_quality_rules": op4_weak_quality_rules,
    "op5_whole_token_counts": op5_whole_token_counts,
    "op6_novelty_secrets": op6_novelty_secrets,
    "op7_unigram_codec": op7_unigram_codec,
    "op8_boosted_quality": op8_boosted_quality,
    "op9_weak_toxicity": op9_weak_toxicity,
    "op10_automaton_decontamination": op10_automaton_decontamination,
}

ORACLES: dict[str, str] = {
    "op3_minhash_near_dedup": NEAR_SQL,
    "op10_automaton_decontamination": CONTAMINATION_SQL,
}
