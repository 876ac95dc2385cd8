"""A corpus pipeline over ``documents``: language, exact copies, near copies, benchmark leaks, mixture.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps, with the columns of
``documents``; the last one gives the mixture: the row of each document with its size, its source's
size and target, and the words that the mixture takes from it. ``run`` writes each stage's result
as Parquet into the shared folder and rereads it, so a lost executor costs one stage at most.

Defined results: null and empty texts have no language and go in the first stage, as do texts without a
letter; texts are read whole, however long; of equal or near texts ties go to the smallest doc_id, null
ones last, and of repeated rows one stays; rows of one doc_id with different texts are decided apart; empty
tables give an empty result. Further columns, whatever their names, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.llm import language_id
from nearkin.llm.decontaminate import drop_contaminated
from nearkin.llm.exact_dedup import drop_copies
from nearkin.llm.mixing import mix_sources
from nearkin.llm.simhash import drop_near_copies
from nearkin.runtime import new_folder, ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those with a null text or without a letter go."""
    ship(spark)
    found = language_id.with_language(docs, language_id.fit(docs))
    kept = found.filter(F.col("lang_pred") != language_id.UND)
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of the documents whose texts are equal but for white space: the longest one, then the smallest doc_id."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the smallest doc_id."""
    ship(spark)
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture takes: doc_id, size, source_size, target and taken of every document."""
    ship(spark)
    return mix_sources(docs).documents


STAGES = [("language ID", language), ("exact dedup", exact), ("SimHash near-dedup", near), ("benchmark decontamination", decontaminate), ("mixing sources", mix)]

#: SQL has no cross-parsing and no pseudorandom permutation; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
