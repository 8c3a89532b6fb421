"""A corpus pipeline over documents: each stage reads what the one before kept, written as Parquet.

Languages are told apart and strangers rejected; exact copies, near copies and benchmark leaks go; the rest is packed.
All stages but the last return the columns of documents. No stage needs ids to be unique or any column to be filled; an empty
table passes through all of them. Whole texts count everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import decontaminate, exact_dedup, language_id, near_dedup, packing
from kbspark.llm.queries import held_out, table
from kbspark.sources.scratch import scope, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, by a model of those with a label that aren't held out.

    Null, empty and letterless texts are rejected. Repeated rows share their fate; rows with null ids are judged but never
    learned from. With nothing to learn from nothing is recognised.
    """
    return language_id.drop_rejected(docs, language_id.fit(docs.where(F.col("doc_id").isNotNull() & ~held_out())))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, null as empty, runs of white space as one space: that with the smallest id.

    A text all of whose ids are null keeps one row. Of repeated rows of that id the one with the least JSON stays.
    """
    return exact_dedup.drop_repeats(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id: five-word shingles, similarity of 0.8 or more.

    Texts without words are near nothing. Rows with null ids stay; rows of one id are one document and share its fate.
    """
    return near_dedup.drop_near(docs, near_dedup.Plan(width=5, percent=80, rows=6))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark: ten words in a row, or all of a shorter item.

    Null texts have no words and stay. Each row is judged by its own text, whatever its id.
    """
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in a training sequence.

    Null and empty texts take the place of the mark of their end. Null sources conflict with nothing; repeated rows are packed
    each by itself; ties go by id.
    """
    return packing.pack(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", leaks), ("packing", packed)]

#: SQL can't express the language model or the packing; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's output is stored before the next begins; then its scratch tables and the output before it are deleted."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scope(spark) as keep:
            now = keep(stored(stage(spark, docs, sf_dir), name))
        if last is not None:
            last.drop()
        docs, last = now.df, now
    return STAGES[-1][1](spark, docs, sf_dir)
