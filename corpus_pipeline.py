"""From documents to token ids: five stages, each written and read again.

Language identification, quality rules, near-duplicates, mixing of sources and
tokenisation. Every stage takes ``(spark, docs, sf_dir)`` and works on all rows
its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import language, mixing, neardup, pieces, quality
from tablewright.llm.common import documents
from tablewright.session import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus."""
    return language.keep_identified(docs)


def apply_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the base rules and the compression bands."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near-duplicates: 5-word shingles, 80 % alike."""
    return neardup.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mixture."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and its slot and place in the mixture, by which the order outlives the files."""
    return pieces.tokenise(mixing.with_places(docs.select("doc_id", "source", "text")), keep=("slot", "place"))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Language scores and zstandard sizes cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
