"""A training corpus from documents: each stage applies one operator to all that its predecessor kept.

All stages take null and empty texts, long ones, repeated rows, empty tables and extra columns as their operators'
docstrings say: a null or empty text isn't toxic, has no lines, is nothing's duplicate and has no benchmark words, so it
stays, and is packed as an empty document. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkeeper.llm import decontam, line_dedup, near_dup, packing, toxicity
from stallkeeper.llm.common import new_path, read
from stallkeeper.llm.queries import TOKENIZER, toxic_labels


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled rows of docs, rejects go."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, toxic_labels(spark, sf_dir)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, then repeated passages; n_chars follows the text. Null texts stay null."""
    return line_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: 5-word shingles, similarity of 0.8 or more."""
    return near_dup.drop_near_duplicates(docs, words=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("toxicity", toxic), ("line dedup", lines), ("near-dedup", near), ("decontamination", benchmark), ("packing", packed)]
#: A classifier, sketches and a tokenizer aren't SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(path := new_path(spark, f"stage{k}"))
        docs = spark.read.parquet(path)
    return docs
