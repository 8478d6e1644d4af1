"""Corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's docs.

Nulls and repeats: a document of null or letterless text goes in the first stage. Rows that repeat a doc_id become one in the second, and rows of null
doc_id are no copies of anything; they pass the next two stages, null languages and sources being branches of their own, and come first in the token
files. Columns beside those of documents pass all stages but the last. Empty documents give empty stages and an empty result, and an empty
benchmark contaminates nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontamination, language_id, mixing, near_duplicates, token_files
from quillspark.llm._io import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    return language_id.recognised(docs)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies stays, that of the smallest doc_id."""
    return near_duplicates.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, asked anew with other values or word for word."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), verbatim=decontamination.RUN)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture's epochs select it."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files.digests(docs)


STAGES = [("language", language), ("duplicates", duplicates), ("benchmark", benchmark), ("mixture", mixture), ("tokens", tokens)]

#: The language model and the tokenizer aren't SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
