"""A training-data pipeline: five stages from ``documents`` to token ids.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cumulus.llm import bpe, langid, line_dedup, mixing, ngram_join
from cumulus.llm.common import fold, table, written_order
from cumulus.session import materialise, ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language by cross-parsing; texts that are null, empty or without a letter go."""
    ship(spark)
    return langid.keep_identified(docs, langid.fit(docs.filter(fold("doc_id", 4) != 2)))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents are dropped but in the first; a document without others goes."""
    ship(spark)
    return line_dedup.keep_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a shingle similarity of 0.8 or more the one with the smallest id stays."""
    ship(spark)
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the Pfair order of their sources' blocks."""
    ship(spark)
    return mixing.in_order(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their number, the digests of ids and decoded bytes, and the mixed ``position``.

    ``position`` counts from 0 in the order in which the stage before wrote the documents.
    """
    ship(spark)
    coded = bpe.encode(written_order(docs, "position"), bpe.rank_file(), decoded=True, keep=("position",))
    return bpe.digests(coded, "ids", "position")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode_texts),
]

#: Cross-parsing, candidate groups and BPE merges cannot be put in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
