"""The corpus pipeline: documents that pass quality, one of each group of near copies, without passages that documents before them have; of these the
ones that benchmark text doesn't contaminate, packed.

Null and empty texts, repeated rows and other columns go the way that each operator states. Each stage is saved in the shared folder; what it wrote
on the way is deleted then, and its input too. An empty table gives no pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assertlake.llm import cost_pack, fm_decontaminate, mil_quality, signature_join, sparse_suffix
from assertlake.llm.common import removed, saved, table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among docs, doesn't reject. Null and empty texts are scored like any; without labels
    all stay."""
    return mil_quality.accepted(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies; of equal ids the one with the least hash of its text, null ids last. Documents
    without words stay, equal rows once."""
    return signature_join.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that a document before them has; one that loses all its words goes. Null and empty texts stay."""
    return sparse_suffix.without_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated: hits in less than one word of twenty, or none, which null and empty texts have. They stay whole."""
    return fm_decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences; a null or empty text is its end id."""
    return cost_pack.packed(docs)


STAGES = [(f.__name__, f) for f in (quality_classifier, ngram_jaccard_join, suffix_array_dedup, benchmark_decontamination, packing)]

#: The classifier and the tokeniser are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    begin = written()
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        removed(spark, begin, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
