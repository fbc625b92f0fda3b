"""A training-corpus pipeline: language ID, near-duplicates, benchmark decontamination, personal data, source mix.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of ``documents``; the last one returns
those in the mix, with their text and the number of copies it takes.  Between stages the documents are written as Parquet and read again.

Defined cases, in every stage: a null, empty or letterless text is rejected by the first; texts of any length are taken whole; of rows that repeat an id one
stays after the second, rows with a null id are never near-duplicates; an empty table gives empty results; columns beside those of ``documents``
are passed through up to the mix, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regionframe.llm.common import Scratch, table
from regionframe.llm.decontaminate import decontaminate
from regionframe.llm.langid import identified
from regionframe.llm.minhash_dedup import distinct_documents
from regionframe.llm.pareto_mix import mixed
from regionframe.llm.pii_surrogates import replace_entities, surrogate_key


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return distinct_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    return replace_entities(docs, key=surrogate_key(spark))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text, source, size, source_size, target, copies, taken of the documents in the mix, which holds ``copies`` (1 or more) of each."""
    return mixed(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("mix", mix)]

#: A trained model decides the first stage: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = table(spark, sf_dir, "documents"), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = tables.write(docs, "stage")  # the table of the stage before goes once this one is written
    return docs
