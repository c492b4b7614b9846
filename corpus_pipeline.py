"""Corpus pipeline: toxicity, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next stage's `docs`. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm import op3_mixing, op6_toxicity, op7_secrets, op8_packing, op10_minhash, work

#: The mixing stage keeps the total of its input's tokens and gives a leaf's tokens twice at most.
TOTAL = "sum(supply)"
EPOCHS, SEED = 2, 11


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; null and empty texts stay, as they score low. Columns are kept, whatever their names; an
    empty table, or labels that tell nothing, give the same rows back."""
    model = op6_toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op6_toxicity.screen(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays (and documents without an id). Rows are told
    apart by id and text, so a unique text stays where its id is repeated; of rows that repeat both, one."""
    found = work.save(op10_minhash.near_duplicates(docs).filter("doc_id is not null").groupBy("doc_id", "text_key").agg(F.bool_or("first").alias("first"), F.count("*").alias("rows")), "near-duplicates")
    named = docs.select(F.struct("*").alias("near_row"), F.col("doc_id").cast("long").alias("near_id"), op10_minhash.text_key().alias("near_key"))
    gone = found.filter("not first").select(F.col("doc_id").alias("near_id"), F.col("text_key").alias("near_key"))
    left = named.join(gone, ["near_id", "near_key"], "left_anti")
    again = found.filter("first and rows > 1").select(F.col("doc_id").alias("near_id"), F.col("text_key").alias("near_key"))
    if not again.isEmpty():
        one = left.join(again, ["near_id", "near_key"], "left_semi").dropDuplicates(["near_id", "near_key"])
        left = left.join(again, ["near_id", "near_key"], "left_anti").unionByName(one)
    return left.select("near_row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; its secrets are replaced by a mark and n_chars follows. A null text stays null with a null
    n_chars, an empty one empty; other columns are kept, whatever their names; an empty table gives none."""
    return op7_secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document comes once for each epoch that takes it. Null languages and sources
    are branches of their own; null and empty texts have no tokens and come with their leaf; rows of one id stand or
    fall together; columns are kept, whatever their names; an empty table gives none."""
    return op3_mixing.mix(docs, op3_mixing.WEIGHTS, TOTAL, EPOCHS, SEED).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their ids and their places in sequences. Null and empty texts are the end id alone;
    repeated rows and null ids are packed like others; extra columns are left out; an empty table gives none."""
    return op8_packing.pack(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: Learned models and similarity groups have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        point, before = work.mark(), docs
        docs = work.save(stage(spark, docs, sf_dir), f"stage-{name}")
        work.drop_since(point, docs)  # what the stage needed for itself
        work.drop(before)
    return docs
