"""Verification of candidate pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readpool.functions.sequences import dice_of_sets, within_edits
from readpool.plans.components import written_with

FEW = 50_000  # pairs whose ids are broadcast: 1 MB


def counted(pairs: DataFrame) -> DataFrame:
    """(a, b, mult): each distinct pair once, with the number of rounds that met it."""
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("mult"))


def compared(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """`pairs` (a, b, ..) with sd double, and sizes n_a, n_b of the gram bags. sketched: (read_id, n_bag, bits, ..)."""
    left = sketched.select(F.col("read_id").alias("a"), F.col("n_bag").alias("n_a"), F.col("bits").alias("bits_a"))
    right = sketched.select(F.col("read_id").alias("b"), F.col("n_bag").alias("n_b"), F.col("bits").alias("bits_b"))
    return pairs.join(left, "a").join(right, "b").withColumn("sd", dice_of_sets("bits_a", "n_a", "bits_b", "n_b")).drop("bits_a", "bits_b")


def verified(pairs: DataFrame, sketched: DataFrame, reads: DataFrame, high: float, low: float, limit: int) -> DataFrame:
    """`pairs` (a, b, ..) with sd double and accepted boolean: similar at once from `high` on; from `low` on if few edits lie
    between. Only pairs between the two, of lengths that so few edits allow, need the reads (read_id, seq) themselves."""
    open_ = F.col("sd").between(low, high) & (F.col("sd") < high) & (F.abs(F.col("n_a") - F.col("n_b")) <= limit)
    both, seen = written_with(compared(pairs, sketched).withColumn("open", open_), n=F.count_if("open"))
    sure = both.select("*", (F.col("sd") >= high).alias("accepted"))
    if not seen["n"]:
        return sure.drop("n_a", "n_b", "open")
    if seen["n"] <= FEW:  # then only their reads move
        ids = both.filter("open").select(F.explode(F.array("a", "b")).alias("read_id")).distinct()
        reads = reads.join(F.broadcast(ids), "read_id", "left_semi")
    seqs = lambda c: reads.select(F.col("read_id").alias(c), F.col("seq").alias(f"seq_{c}"))
    near = both.filter("open").join(seqs("a"), "a").join(seqs("b"), "b").withColumn("accepted", within_edits("seq_a", "seq_b", limit)).drop("seq_a", "seq_b")
    return sure.filter("NOT open").unionByName(near.select(*sure.columns)).drop("n_a", "n_b", "open")
