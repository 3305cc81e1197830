"""A corpus pipeline: documents in, token ids of a cleaned and mixed corpus out.

Every stage takes the documents its predecessor kept and returns documents (the last one their ids); between stages
the rows are written as Parquet in the shared folder and read again.

All stages but the last return the columns they are given, whatever these are called. Null and empty texts go in the first
stage; null ids and sources are values like others; rows repeated whole are copies, of which one stays; a table without
rows stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ringlens.llm import bpe, exact_dedup, language, mixing, simhash
from ringlens.llm.queries import vocabulary
from ringlens.llm.store import cut_lineage, read_documents
from ringlens.session import configure


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language; null texts and texts without a letter go, repeated rows stay."""
    return language.drop_unknown_language(docs)


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; null ids lose, of repeated rows one stays."""
    return exact_dedup.drop_exact_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id (null ids last)."""
    return simhash.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it; the words delivered are those of op10 on the same rows."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document of the mix."""
    return bpe.encode_digests(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language", known_language), ("exact_dedup", no_exact_copies), ("near_dedup", no_near_copies),
          ("mixing", mixed), ("encoding", encoded)]

ORACLE_SQL = None  # SQL has no language model, SimHash or BPE; tests/llm holds the rows against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    rows = read_documents(spark, sf_dir)
    for _, stage in STAGES:
        rows = cut_lineage(stage(spark, rows, sf_dir))
    return rows
