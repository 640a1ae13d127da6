"""Corpus preparation: language ID, near-dedup, substring dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; docs is what the stage
before it kept.  All but the last return the columns of `documents`."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taintlake.llm import langid, packing, rlz, simhash
from taintlake.plans.storage import saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are null or have no letter go.  Where no label can be learnt from, as
    when `lang` is null everywhere, no language is known and all other texts stay."""
    found = langid.identify(docs.select(COLUMNS))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) | langid.has_letter(F.col("text").cast("string"))).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component stays: that with the smallest doc_id, rows
    without a doc_id last.  Rows that repeat a doc_id, and equal rows, are rows like others."""
    return simhash.one_per_component(docs.select(COLUMNS)).select(COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in a run of 13 that a document before has are cut; a text cut to nothing goes.
    A null, empty or blank text has no words and stays as it is.  Rows without a doc_id
    take no part and stay; rows that repeat a doc_id are one document, so neither cuts the other."""
    cut = rlz.dedup_substrings(docs, carry=("lang", "source", "n_chars"))
    length = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.where("n_removed = 0 OR n_removed < n_words").select("doc_id", F.col("kept_text").alias("text"), "lang", "source", length.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1,024 ids.  A null or empty text is its closing id alone; every
    row is packed, those that repeat a doc_id or have none as well."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", pack)]
#: Fingerprints, the mixture model and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
