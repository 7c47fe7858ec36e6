"""Scores, clusters and their representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readpool.plans.components import connected_components


def scores(accepted_pairs: DataFrame) -> DataFrame:
    """(read_id, score): accepted tests of each read; a pair met in several rounds counts as often. Pairs: (a, b, mult)."""
    ends = accepted_pairs.select(F.explode(F.array("a", "b")).alias("read_id"), "mult")
    return ends.groupBy("read_id").agg(F.sum("mult").cast("bigint").alias("score"))


def merged(reads: DataFrame, edges: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """(read_id, cluster): clusters after joining the ends of `edges` (a, b); a cluster's id is its least member.

    `current` (read_id, cluster) is the partition before; without it every read is alone.
    """
    if current is None:
        found = connected_components(edges).select(F.col("node").alias("n"), "component")
        return reads.select("read_id").join(found, F.col("read_id") == F.col("n"), "left").select("read_id", F.coalesce("component", "read_id").alias("cluster"))
    of = current.select(F.col("read_id").alias("r"), "cluster")
    lifted = edges.join(of, F.col("a") == F.col("r")).select(F.col("cluster").alias("ca"), "b").join(of, F.col("b") == F.col("r")).select(F.col("ca").alias("a"), F.col("cluster").alias("b"))
    found = connected_components(lifted.filter("a <> b")).select(F.col("node").alias("n"), "component")
    return current.join(found, F.col("cluster") == F.col("n"), "left").select("read_id", F.coalesce("component", "cluster").alias("cluster"))


def representatives(clusters: DataFrame, scored: DataFrame, most: int) -> DataFrame:
    """(cluster, rk, read_id, score): the `most` members of each cluster with the highest scores; ties by read_id."""
    points = scored.select(F.col("read_id").alias("r"), "score")
    rows = clusters.join(points, F.col("read_id") == F.col("r"), "left").select("cluster", "read_id", F.coalesce("score", F.lit(0)).cast("bigint").alias("score"))
    rk = F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("score").desc(), "read_id"))
    return rows.withColumn("rk", rk).filter(F.col("rk") <= most).select("cluster", "rk", "read_id", "score")


def focus(clusters: DataFrame, reps: DataFrame, rank: int) -> DataFrame:
    """(read_id, cluster): single reads, and the representative of rank `rank` (from 0) of every cluster that has one."""
    size = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("read_id").alias("read_id"))
    singles = size.filter("n = 1").select("read_id", "cluster")
    larger = reps.filter(F.col("rk") == rank + 1).join(size.filter("n > 1").select("cluster"), "cluster", "left_semi")
    return singles.unionByName(larger.select("read_id", "cluster"))


def ranked(clusters: DataFrame, scored: DataFrame) -> DataFrame:
    """(read_id, rank, single): every read with its rank in its cluster from 0 on, as `representatives` have it, and whether it is
    alone. `focus` of a rank is the reads of this rank and all single ones."""
    points = scored.select(F.col("read_id").alias("r"), F.coalesce("score", F.lit(0)).alias("score"))
    rows = clusters.join(points, F.col("read_id") == F.col("r"), "left").select("cluster", "read_id", F.coalesce("score", F.lit(0)).alias("score"))
    own = Window.partitionBy("cluster")
    return rows.select("read_id", (F.row_number().over(own.orderBy(F.col("score").desc(), "read_id")) - 1).alias("rank"), (F.count(F.lit(1)).over(own) == 1).alias("single"))


def sampled(rows: DataFrame, by: list[str], most: int, mark: Column) -> DataFrame:
    """At most `most` rows for each value of `by`, the first in the order of `mark`: all of them in small groups."""
    rk = F.row_number().over(Window.partitionBy(*by).orderBy(mark, "read_id"))
    return rows.withColumn("rk", rk).filter(F.col("rk") <= most).drop("rk")


def cluster_counts(clusters: DataFrame) -> DataFrame:
    """(n_clusters, n_singles) in one row."""
    size = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return size.agg(F.count(F.lit(1)).alias("n_clusters"), F.count_if(F.col("n") == 1).alias("n_singles"))


def reasonable(chunks: DataFrame, share: float) -> DataFrame:
    """(chunk_id, n): chunks of at least `share` times the mean size. chunks: (read_id, chunk_id)."""
    size = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    mean = size.agg(F.avg("n")).first()[0]
    return size.filter(F.col("n") >= F.lit(share * (mean or 0.0)))
