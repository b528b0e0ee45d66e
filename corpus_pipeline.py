"""A corpus in five stages: toxicity, exact dedup, n-gram Jaccard join, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a DataFrame; all but
the last return the columns of documents, whatever further columns docs has. An empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegate.llm.bpe import vocabulary
from tidegate.llm.common import delete, stored, table
from tidegate.llm.decontam import clean
from tidegate.llm.exact import keep_first
from tidegate.llm.ngram_join import one_of_each
from tidegate.llm.packing import best_fit
from tidegate.llm.toxicity import ordinary


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't predicted toxic. Null and empty texts score as a difference of 0 does; rows with a null id are judged
    too; repeated rows share their fate; if labels lack a class, all rows stay."""
    return ordinary(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows of equal texts, blanks aside, the one with the longest text, then the least id. A null text counts as empty, and
    one empty row stays; a null id comes first; of rows repeated in id and text, one stays."""
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row of least id. Rows without words and rows with a null id stay, all of them; rows that
    share an id are told apart by their texts; of rows repeated in id and text, one stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item. Null and empty texts contain none; null ids and repeated rows are judged each."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its sequence and place. A null text counts as empty and makes one piece of the
    separator; null ids and repeated rows are packed each."""
    return best_fit(docs, vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL expresses neither the learned model nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet in the shared folder and read again as the next one's documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, folder = stored(stage(spark, docs, sf_dir), name)
        if before:
            delete(spark, before)
        before = folder
    return docs
