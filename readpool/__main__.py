"""Command line: cluster the reads of a block file, print the report and write the clusters beside it."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from readpool.config import ClusterConfig
from readpool.plans import pipeline
from readpool.sources import blocks


def main(args: list[str] | None = None) -> str:
    parser = argparse.ArgumentParser(prog="readpool", description=__doc__)
    parser.add_argument("-e", "--reads", required=True, metavar="PATH", help="block file of clustered reads")
    parser.add_argument("-o", "--out", metavar="PATH", help="folder for the clusters; none: <PATH>.result")
    parser.add_argument("--no-export", action="store_true")
    parser.add_argument("--seed", type=int, default=ClusterConfig.seed)
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("readpool").getOrCreate()
    config = ClusterConfig(seed=a.seed)
    pool = blocks.read_pool(spark, a.reads, config.q)
    result = pipeline.run(blocks.shuffled_ids(pool.reads, config.seed), config)
    reads = blocks.shuffled_ids(pool.reads, config.seed)
    text = pipeline.report(result, reads.select("read_id", F.col("cluster_id").alias("label")))
    print(text)
    if not a.no_export:
        members = result.clusters.join(reads.select("read_id", F.col("cluster_id").alias("strand_id"), "seq"), "read_id")
        blocks.write_blocks(members, pool.originals, a.out or f"{a.reads}.result")
    return text


if __name__ == "__main__":
    main()
