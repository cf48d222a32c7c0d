"""Documents to packed training sequences: quality rules, exact dedup, near duplicates, mixing, packing.

Every stage but the last returns the columns of ``docs``, whatever they are called; an empty table gives an empty one.
Texts are read whole, however long. What nulls, ties and repeated rows become is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeweave.llm import exact_dedup, mixing, ngram_join, packing, quality
from lakeweave.llm.common import cut
from lakeweave.llm.queries import TOKENIZER


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that failed. Null and empty texts go; repeated rows fare alike."""
    return quality.clean_documents(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that with the largest doc_id, a null one being below any other. Null texts are empty
    ones; of rows that repeat text and doc_id one stays."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id. Empty texts and rows without doc_id
    are in no group and stay; rows that repeat a doc_id are one document and share its fate."""
    return ngram_join.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for. Null is a source of its own; null texts have no words and
    come as often as their source; rows that repeat are drawn one by one."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 ids. A null text is its end id alone; repeated rows are documents of
    their own."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("packing", packed),
]

#: tokenizing and packing are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
