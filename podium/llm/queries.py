"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from podium.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from podium.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from podium.llm.suffix_dedup import digests

    return digests(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from podium.llm import toxicity

    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from podium.llm.token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), limit=4096)


#: Ids that the tokenizer library gives to special strings inside texts.
SPECIAL = (("<|endoftext|>", 50256),)


def pack_documents(documents: DataFrame) -> DataFrame:
    from podium.llm.packing import pack, pieces

    return pack(pieces(documents, _tokenizer("byte_bpe_50k.tiktoken"), length=2048, special=SPECIAL, end=0), capacity=2048)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    from podium.llm import rule_ensemble

    documents = table(spark, sf_dir, "documents")
    return rule_ensemble.score(documents, rule_ensemble.fit(documents, table(spark, sf_dir, "labels")))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from podium.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), k=20, scale=64, every=20)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from podium.llm import quality_rules

    documents = table(spark, sf_dir, "documents")
    return quality_rules.apply(documents, quality_rules.fit(documents, table(spark, sf_dir, "labels")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from podium.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from podium.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"))


def queries() -> dict[str, Query]:
    named = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(named.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    from podium.llm import licenses, suffix_dedup, topk

    return {"op1_license_scan": licenses.sql(), "op2_suffix_dedup": suffix_dedup.SQL, "op7_top_k": topk.SQL}
