"""A training-data pipeline over documents: quality rules, toxicity, near duplicates, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns what it kept with the columns of documents, the last one the packed
pieces. A stage that fits or learns does so on what it was given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, written
from tessera.llm.near_dup import near_duplicates
from tessera.llm.packing import best_fit_packing
from tessera.llm.quality import kept_documents
from tessera.llm.secrets import redacted
from tessera.llm.toxicity import train, without_toxic


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return kept_documents(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon model, learned from the labels that op7 learns from, doesn't call toxic."""
    labels = table(spark, sf_dir, "labels").filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    return without_toxic(docs, train(docs, labels))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by doc_id, of each group; of rows that repeat a doc_id, the one of least hash of all columns.
    Rows without doc_id, and rows without words, stay."""
    found = written(near_duplicates(docs, size=5, percent=80).filter("doc_id is not null and kept").select(F.col("doc_id").alias("id"), "text_hash").distinct(), "near-duplicates")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"), whole.alias("row"))
    first = rows.join(found, ["id", "text_hash"]).groupBy("id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return first.select("row.*").unionByName(docs.filter("doc_id is null"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of 2048 tokens."""
    return best_fit_packing(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("secret scan", secret_stage),
    ("best-fit packing", packing_stage),
]

#: Learned scores, near duplicates and packing are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
