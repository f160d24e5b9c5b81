"""The corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, mixing, token file.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
docs of the next. All but the last return the columns of ``documents``; the last returns the digest of the token
file. SQL can express no stage, so ``ORACLE_SQL`` is None and the tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from litmill.llm.common import Scratch, table
from litmill.llm.decontaminate import keep_clean
from litmill.llm.language_id import keep_identified, train
from litmill.llm.mixing import mixed
from litmill.llm.queries import tokenizer_path
from litmill.llm.repair import write_and_read
from litmill.llm.shingle_dedup import near_copies
from litmill.llm.simhash import keep_one


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those rejected go."""
    return keep_identified(docs, train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links between sets of five-word shingles of a similarity of 0.8 or more
    connect; the one of the smallest hash of id and text stays."""
    return keep_one(docs, near_copies)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed(docs)


def token_file(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the token file: doc_id, start, n_tokens, ids_crc32."""
    return write_and_read(docs, tokenizer_path("word_bpe_49k.json"), end=1)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_file", token_file),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        following = scratch.write(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = following
    return STAGES[-1][1](spark, docs, sf_dir)
