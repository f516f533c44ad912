"""A corpus from raw documents to token ids: filter, near-dedup, exact dedup, mix, encode.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over everything that the one before it kept; what it
returns is written as Parquet and read again as the next one's docs. All but the last return the columns of
documents. Nulls, empty and repeated rows are handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, quality, simhash, suffix
from tidemark.llm.shared import Table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule. A null or empty text has no words and goes; equal rows share their fate."""
    return quality.keep(docs.select(COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id. Documents are linked as in op3, by fingerprints at
    most 3 bits apart, and also by five-word shingles of similarity 0.8, which finds longer changes. Texts without words are one
    class, rows without an id stay, and of equal rows one does."""
    return simhash.one_each(docs.select(COLUMNS), width=5, least=0.8, radius=3)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what repeats 50 bytes of a document with a smaller id; n_chars follows the text.

    Documents stay, even if empty. Null text stays null; null ids count as the largest.
    """
    kept = suffix.remove(docs.select(COLUMNS), length=50)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; never one without words. A null source is a source of its own."""
    return mixing.repeated(docs.select(COLUMNS)).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of each row's token ids and of the text decoded from them. Null text is empty."""
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("exact dedup", exact_dedup),
    ("mix sources", mix_sources),
    ("encode", encode),
]

#: Min-hashing, suffix sorting, a seeded mix and a tokenizer are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: Table | None = None
    for name, stage in STAGES[:-1]:
        table = Table(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before:
            before.drop()
        before, docs = table, table.read()
    result = STAGES[-1][1](spark, docs, sf_dir)  # a checkpoint, so what it was read from can go
    if before:
        before.drop()
    return result
