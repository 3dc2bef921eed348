"""From raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketloom.llm import decontaminate, line_dedup, order_minhash, packing, quality_gam
from marketloom.llm.common import materialise, shared_folder
from marketloom.llm.queries import VOCABULARY, table


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_gam.accepted(docs, table(spark, folder, "labels"))


def lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without lines that later documents repeat."""
    return line_dedup.cleaned(docs, shared_folder(spark, "line-runs"))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return order_minhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_contaminated(docs, table(spark, folder, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token pieces of the documents with their places in the sequences."""
    return packing.pack(packing.token_pieces(docs, VOCABULARY))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written before the next one reads it."""
    docs = table(spark, folder, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
