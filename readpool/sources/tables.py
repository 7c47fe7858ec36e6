"""Reads from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letters_of(text: Column) -> Column:
    """A text as a sequence: letters map to ACGT by place in the alphabet, all else is dropped (first, in whole stretches)."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]+", ""), alphabet, "".join("ACGT"[i % 4] for i in range(26)))


def document_reads(spark: SparkSession, sf_dir: str, q: int = 6) -> DataFrame:
    """(read_id, seq): all letters of each document as a read, for those of q letters at least."""
    docs = table(spark, sf_dir, "documents")
    reads = docs.select(F.col("doc_id").alias("read_id"), letters_of(F.col("text")).alias("seq"))
    return reads.filter(F.col("read_id").isNotNull() & (F.length("seq") >= q))
