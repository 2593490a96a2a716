"""From raw documents to packed training sequences: five stages, each an operator of ``isoframe.llm``.

Every stage works on all its predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isoframe.llm.common import forget, small_batches, written
from isoframe.llm.decontaminate import decontaminate
from isoframe.llm.exact_dedup import exact_dedup
from isoframe.llm.minhash import keep_one
from isoframe.llm.packing import pack_documents
from isoframe.llm.ppm_langid import fit, identify
from isoframe.llm.queries import table, tokenizer_path
from isoframe.scratch import once


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some learned language stay; those without a letter, or without text, go."""
    with small_batches(spark):
        return written(identify(docs, fit(docs)).where("lang_pred <> 'und'").select(*docs.columns), "in_a_language")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup(docs).where("kept").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages to a twentieth of their words or more go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where("NOT contaminated").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and place in it."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", clean), ("pack", pack)]
#: Language models, sketches and packing have no SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = once(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
