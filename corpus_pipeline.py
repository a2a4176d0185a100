"""Corpus pipeline: quality classifier, quality rules, near-duplicates, repeated passages, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and reread as
the next one's ``docs``. All but the last return the columns of ``documents``, whatever these are called. Null texts
are empty texts; repeated rows count as rows until the near-duplicate stage; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from podium.llm import near_copies, quality_rules, rule_ensemble, suffix_dedup
from podium.llm.common import staged, table
from podium.llm.queries import pack_documents


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the rule ensemble scores as good; rows without an id are scored like any other."""
    return rule_ensemble.keep(docs, rule_ensemble.fit(docs, table(spark, sf_dir, "labels")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what neither the fixed limits nor the isolation forest reject; null and empty texts fail the limits."""
    return quality_rules.keep(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies (5-word shingles, 80 %): the one with the smallest id.

    Of repeated rows one stays; texts without words are copies of each other; rows without an id all stay.
    """
    return near_copies.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document with a smaller id has too; every document stays.

    Rows with one id don't take from each other, and rows without an id neither lose nor take anything.
    """
    return suffix_dedup.remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; an empty text is one piece of one id, and repeated rows are packed each."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("best_fit_packing", packing),
]
#: Learnt stages and tokenisation have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
