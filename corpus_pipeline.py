"""A cleaning pipeline over ``documents``: language, exact copies, near copies, benchmark leaks, mixture.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
its result is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup, fm_index, hyperdim, mixing, ngram_join
from quillspark.llm.common import delete, scratch, scratch_dir, table
from quillspark.llm.queries import TARGETS, learned_languages


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or unlike every learned language go.

    Null and empty texts have no letters; with no language learned (an empty table, no lang) all go.
    Very long texts are read whole; repeated rows are judged each; all columns stay, whatever their names.
    """
    return hyperdim.keep_identified(docs, learned_languages(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    Null text equals the empty one; a null id is the smallest; of repeated rows one stays; an empty table stays empty.
    """
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays: five-word shingles, similarity 0.8 or more.

    Rows are told apart by their place in the files, so a row whose doc_id repeats is not lost with its namesake.
    Texts without words stand alone and stay; a null id is larger than others; of repeated rows one stays.
    """
    return ngram_join.keep_first(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go.

    Null and empty texts stay; with an empty benchmark all stay; items without words or with null text match nothing.
    """
    return fm_index.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents get their rate; those of rate zero go.

    Texts without words keep rate 1; without labels all rates are 1; a column of the name of an added one is an error.
    """
    return mixing.mix(docs, table(spark, sf_dir, "labels"), TARGETS).filter(F.col("rate") > 0)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark_leaks),
    ("source_mixing", mixture),
]

#: SQL can express neither the language profiles nor the domain classifier; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that all stages kept; what stages and operators wrote on the way is deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/pipeline/{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
