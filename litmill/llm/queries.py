"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from litmill.llm.common import table


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files lie; the same on the driver and the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litmill.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=512)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litmill.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litmill.llm.line_dedup import line_report

    return line_report(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litmill.llm.language_id import held_out, identify, train

    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs, ~held_out()))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litmill.llm.secrets import secrets

    return secrets(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litmill.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litmill.llm.repair import write_and_read

    return write_and_read(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end=1)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litmill.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litmill.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litmill.llm.pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents"))


ALL = (
    op1_token_counts, op2_embedding_dedup, op3_line_dedup, op4_language_id, op5_secrets, op6_mixing, op7_token_file, op8_decontamination,
    op9_simhash, op10_pii,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    """None: SQL can express no operator whole; the tests hold each against brute force."""
    return {}
