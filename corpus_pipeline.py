"""A training corpus from `documents`: five stages, each written as Parquet and read again by the next.

Documents whose language can't be told go, one document of each group of near copies stays, documents with passages of
the benchmark go, sources are mixed to their weights (a document that the mix takes twice stands twice), and the token
ids of what is left are written to files and read back as digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbweave.llm.common import fresh_dir, table
from orbweave.llm.decontaminate import decontaminated
from orbweave.llm.jaccard_join import first_of_each
from orbweave.llm.language_id import known_language
from orbweave.llm.mixing import mixture
from orbweave.llm.token_file import tokens_read, tokens_written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return known_language(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more."""
    return first_of_each(docs, k=5, num=4, den=5)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens_read(tokens_written(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("mix", mix), ("tokens", tokens)]
#: Language models, components and token files have no SQL; tests/llm/test_pipeline.py holds a brute-force version of every stage and of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
