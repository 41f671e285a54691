"""Corpus pipeline: quality rules, SimHash near-dedup, suffix-array dedup, benchmark decontamination, BPE.

Every stage takes null text as empty, texts of any length whole, null and repeated doc_ids, and further columns of any
name, which all but the last stage give back as they are. An empty table stays one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hostvigil.llm import bpe, decontaminate, quality, simhash, suffix_dedup
from hostvigil.llm.common import materialize, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; a row is judged by itself, so repeated rows stay or go together. Empty texts go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies the document of the smallest doc_id stays (null last); of equal rows one; of all empty texts one."""
    return simhash.keep_one(docs)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose what stands in a document of a smaller doc_id (null is smallest; equal ids don't count against each
    other); every row stays, its n_chars counted anew."""
    return suffix_dedup.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; empty texts and null or short items match nothing."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of digests for every document; an empty text has no tokens."""
    return bpe.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("repeat_dedup", repeat_dedup),
    ("decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: Several stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result is written to the shared folder and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
