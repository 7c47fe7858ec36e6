"""Connected components of an edge list: every node gets the smallest node it reaches."""

from __future__ import annotations

import ctypes
import ctypes.util
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HERE = 1 << 18  # edges that the driver joins by itself: 4 MB


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a temporary one serves if all of Spark is on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="readpool-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def give_back_memory() -> None:
    """Returns what Python has freed to the system, where the C library can; workers and the driver live on after a step."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None)
    if trim:
        trim(0)


def jvm_gives_back(spark: SparkSession) -> None:
    """The driver's JVM returns free heap, which G1 does only after a full collection."""
    spark._jvm.System.gc()


def dropped(*tables: DataFrame) -> None:
    """Deletes what `written` wrote for tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder: it cuts the lineage and survives lost executors."""
    return written_with(df)[0]


def written_with(df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
    """The table, and aggregates that are taken while it is written, so that they cost no job of their own."""
    path = f"{shared_folder(df.sparkSession)}/readpool-{uuid.uuid4().hex}"
    seen = Observation()
    out = df.observe(seen, *(c.alias(k) for k, c in figures.items())) if figures else df
    out.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table, seen.get if figures else {}


def star_step(edges: DataFrame) -> DataFrame:
    """One large-star and small-star round over distinct edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    large = both.join(least, F.col("u") == F.col("n")).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.unionByName(both.join(least, F.col("u") == F.col("n")).filter((F.col("u") > F.col("m")) & (F.col("v") == F.col("m"))).select("u", "v")).filter("u > v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
    small = large.join(low, F.col("u") == F.col("n")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return small.select("e.*").filter("u > v").distinct()


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted nodes, the least node that each reaches) of edges, one after another."""
    nodes, place = np.unique(np.concatenate((u, v)), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(*(half.tolist() for half in np.split(place, 2)), strict=True):
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)  # places are in the order of nodes
    return nodes, nodes[np.fromiter((find(x) for x in range(len(nodes))), np.int64, len(nodes))]


def whole_numbers(spark: SparkSession, kind: T.DataType = T.LongType(), **columns: np.ndarray) -> DataFrame:  # noqa: B008
    return spark.createDataFrame(pa.table(columns), T.StructType([T.StructField(c, kind) for c in columns]))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every end of an edge; loops and repeated edges do no harm, null ends are left out.

    Large-star and small-star rounds alternate until the edges are stars. Each round is a table in the shared folder; the
    number of rounds grows with the logarithm of the nodes, and no task sees more than the edges of its partition. Only up to
    HERE distinct edges go to the driver instead.
    """
    mark = {"n": F.count(F.lit(1)), "x": F.bit_xor(F.xxhash64("u", "v")), "y": F.sum(F.xxhash64("v", "u") % 1_000_003)}
    pairs = edges.filter(F.col(a).isNotNull() | F.col(b).isNotNull())
    pairs = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))  # of one end alone, a loop
    now, seen = written_with(pairs.distinct(), **mark)
    kind = now.schema["u"].dataType
    if seen["n"] <= HERE and isinstance(kind, (T.LongType, T.IntegerType)):  # rounds over so few are all overhead
        got = now.toArrow()
        nodes, least = least_reached(got.column("u").to_numpy(), got.column("v").to_numpy())
        return whole_numbers(now.sparkSession, kind, node=nodes, component=least)
    nodes = now.select("u").union(now.select("v")).distinct().withColumnRenamed("u", "node")
    last, now = None, now.filter("u <> v")
    while seen["n"]:
        before = seen
        now, seen = written_with(star_step(now), **mark)
        if last:
            dropped(last)
        last = now
        if seen == before:
            break
    return nodes.join(now.withColumnsRenamed({"u": "n_", "v": "c_"}), F.col("node") == F.col("n_"), "left").select("node", F.coalesce("c_", "node").alias("component"))
