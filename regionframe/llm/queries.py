"""The corpus operators as queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_preferences import opening_preferences
from .common import table
from .decontaminate import contamination
from .hnsw import nearest
from .langid import language_of
from .masked_lm import pseudo_likelihood
from .minhash_dedup import near_duplicates
from .oracles import ORACLES
from .page_text import main_text
from .pareto_mix import pareto_mix
from .pii_surrogates import replace_entities, surrogate_key
from .suffix_dedup import removed_repeats


def op1_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opening_preferences(table(spark, sf_dir, "conversations"))


def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents"), key=surrogate_key(spark), count_col="n_entities").select("doc_id", "text", "n_entities")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op6_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op7_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_chat_preferences, op2_page_text, op3_language_id, op4_pii_surrogates, op5_decontaminate, op6_hnsw, op7_masked_lm, op8_minhash_dedup, op9_suffix_dedup, op10_pareto_mix)}
__all__ = ["ORACLES", "QUERIES"]
