"""From raw documents to training sequences: filter, clean, deduplicate, mix, pack.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet
and read back as the next stage's ``docs``. All but the last return the columns of documents.
The rules of each stage are those of the operator that it calls. In short:

* nulls: a null text fails the quality rules; a null source is a source of its own; rows with a
  null doc_id stay where groups are thinned; other columns may be null and are carried along;
* empty texts fail the quality rules; texts that lose all lines go on as empty ones, link with
  nothing, are read once and are packed as one token;
* texts of any length are taken whole, each in one task;
* ties: of a group the smallest doc_id stays, of several texts under it the one with the smallest
  hash; sequences and permutations break ties by digests and numbers;
* repeated rows are pages each, one of them stays where groups are thinned;
* an empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.boilerplate import without_boilerplate
from vellum.llm.common import materialise, table
from vellum.llm.fertility import keep_fertile
from vellum.llm.mixing import mixed
from vellum.llm.packing import packed_sequences
from vellum.llm.shingle_join import one_of_each_class


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and their language's fertility band let pass."""
    return keep_fertile(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that too many pages of their source share; n_chars is that of the text that is left."""
    kept = without_boilerplate(docs, F.col("source"))
    chars = lambda: F.coalesce(F.char_length("text"), "n_chars").cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", chars()) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class that similar shingle sets tie together."""
    return one_of_each_class(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of their sources reads them."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in a training sequence."""
    return packed_sequences(docs).drop("ids")


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("packing", packing),
]

#: Quality rules, classes and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
