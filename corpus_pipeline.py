"""From raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnlake.llm import jaccard_join, language, mixing, packing, pii
from cairnlake.llm.common import materialise, table
from cairnlake.llm.queries import tokenizer_path


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence. Null, empty and letterless texts go; texts of any length are
    read whole; repeated rows are judged alike and all stay or go; null ids don't matter; an empty table, or one
    that declares no language, gives none; columns of any name stay as they are."""
    return language.keep_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that of the smallest doc_id; of rows with one doc_id one. Rows without
    words or without a doc_id all stay. Ties don't arise, as ids differ; an empty table stays empty."""
    return jaccard_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows with personal data covered in text, and n_chars of that. Null texts stay null, empty ones empty;
    repeated rows stay, and count once for each doc_id in the statistics; other columns stay, whatever their names."""
    return pii.sanitise(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn by their rate, 1 at most, by a hash of id and text: equal rows stay or go together. Null and empty texts
    have no token and the rate of their posterior; without labels every domain is alike; an empty table stays empty."""
    return mixing.mix(docs, docs, table(spark, sf_dir, "labels"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row, placed. Null and empty texts are one token, long ones are cut; repeated rows and null ids
    have pieces of their own; extra columns are left out."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("language", languages), ("near_duplicates", near_duplicates), ("pii", personal_data), ("mixture", mixture), ("packing", sequences)]

#: SQL can't express these stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
