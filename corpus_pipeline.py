"""A corpus pipeline from five of the corpus operators: filter by quality, drop repeated lines, keep one document of each
group of near-duplicates, order by target weights of the sources, pack into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet in the
shared folder and reads them again. All stages but the last return the columns of documents.

Defined results, for all stages: further columns are carried, whatever their names; a null text is kept as null and
counts as empty; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casegraph.llm import chosen_path, line_dedup, mixing, packing, quality
from casegraph.llm.common import materialise

#: A trained classifier, sampled paths and a tokeniser: SQL can't express them.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; all stay where the labels have no two classes. Repeated rows share their fate."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay only where they first stand, by doc_id (null first) and position; no document
    goes. Repeated rows count as one document and share the outcome."""
    return line_dedup.drop_lines(docs, min_docs=10)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the first by doc_id (null first), then by a hash of the text; of repeated rows one.
    All documents without a word are one group."""
    return chosen_path.one_of_each(docs, words=5, threshold=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture; a null source is a source of its own, ties go by a hash of the row."""
    return mixing.in_order(docs, block_rows=64, period=1024, temper=0.5)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens. Spark rereads the mixture's files by size, so its order is made again."""
    return packing.pack(mixing_stage(spark, docs, sf_dir), size=1024)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("source_mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
