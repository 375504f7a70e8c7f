"""The queries that apply each operator to its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assertlake.llm import cost_pack, filter_audit, fm_decontaminate, katz_lm, mil_quality, prefix_trie, projection_forest, rule_filter, signature_join, sparse_suffix, tree_shard, url_rules, wrapper_induction
from assertlake.llm.common import table


def op1_sparse_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_suffix.reported(table(spark, sf_dir, "documents"))


def op2_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_lm.scored(table(spark, sf_dir, "documents"))


def op3_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil_quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_filter.judged(table(spark, sf_dir, "documents"))


def op5_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_shard.sharded(table(spark, sf_dir, "documents"))


def op6_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost_pack.packed(table(spark, sf_dir, "documents"))


def op7_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.joined(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper_induction.main_text(table(spark, sf_dir, "pages"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(table(spark, sf_dir, "pages"))


def op10_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_decontaminate.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_forest.deduplicated(table(spark, sf_dir, "embeddings"))


#: The operators' queries, by their numbers.
ALL = (
    op1_sparse_suffix_dedup, op2_katz_scores, op3_mil_quality, op4_quality_rules, op5_hash_tree_sharding, op6_cost_balanced_packing, op7_signature_tree_join, op8_wrapper_extraction,
    op9_url_rules, op10_fm_decontamination, op11_filter_audit, op12_prefix_trie, op13_projection_forest,
)
QUERIES = {f.__name__: f for f in ALL}

ORACLE_SQL = {
    "op1_sparse_suffix_dedup": sparse_suffix.oracle(),
    "op4_quality_rules": rule_filter.oracle(),
    "op5_hash_tree_sharding": tree_shard.oracle(),
    "op7_signature_tree_join": signature_join.oracle(),
    "op9_url_rules": url_rules.oracle(),
    "op10_fm_decontamination": fm_decontaminate.oracle(),
    "op11_filter_audit": filter_audit.oracle(),
    "op12_prefix_trie": prefix_trie.oracle(),
    "op13_projection_forest": projection_forest.oracle(),
}
