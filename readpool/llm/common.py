"""What the operators of this subpackage share: tables, shared storage and shipping code to executors."""

from __future__ import annotations

import sys
import tempfile
import threading
import time
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import readpool
from readpool.plans.components import give_back_memory, jvm_gives_back  # noqa: F401

# Executors need no installed copy of this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[readpool.__name__])

#: A word, as the contracts of the size and shingle operators define it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a temporary one serves if all of Spark is on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="readpool-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


COLLECT = 10  # seconds between collections of the driver's heap in a long job
_watched: dict[str, threading.Thread] = {}  # by application


def collecting(spark: SparkSession) -> None:
    """From now on the driver's collector runs every COLLECT seconds of a long job, the caller's last one included: what many tasks
    report would else let the heap grow to its limit, beside which metaspace, threads and the driver's Python need room too. Jobs of
    fewer seconds go without, and after ten turns without a job it ends."""
    context = spark.sparkContext
    if context.applicationId in _watched and _watched[context.applicationId].is_alive():
        return

    def run():
        last, idle = set(), 0
        while idle < 10:
            time.sleep(COLLECT)
            try:
                now = set(context.statusTracker().getActiveJobsIds())
                if now & last:
                    jvm_gives_back(spark)
            except Exception:  # noqa: BLE001  the session has ended
                return
            last, idle = now, 0 if now else idle + 1

    _watched[context.applicationId] = threading.Thread(target=run, daemon=True)
    _watched[context.applicationId].start()


def stored(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again: it cuts the lineage and survives a lost executor.

    The driver's collector runs after it: G1 gives free heap back only then, and else the driver's process grows to its limit
    over the tables of a long job, whatever little of it is in use. No marker of success is written, as no one looks for it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/readpool-{uuid.uuid4().hex}"
    collecting(spark)
    df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    jvm_gives_back(spark)
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes what `stored` wrote for tables that nothing reads any more. The driver's collector runs, so that Spark's cleaner
    removes the shuffle files of finished steps too, which else lie on executors until the driver's heap is full."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        jvm_gives_back(tables[0].sparkSession)


def collected(spark: SparkSession) -> None:
    """Runs the collector of every executor that has a free slot: its heap else stays as large as the largest step so far made it,
    also while Python workers beside it need the memory. It returns what no one uses, nothing depends on it."""
    n = 1 if spark.sparkContext.master.split("[")[0] == "local" else spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc') AS done").collect()


MAX_PARTS = 1 << 17


def size_of(df: DataFrame) -> int | None:
    """Bytes of the files that `df` comes from, as the plan knows them; None for rows that are no files."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else None


def parts_for(df: DataFrame, each: int = 128 << 20) -> int:
    """Tasks for a shuffle of what comes from `df`: one for `each` bytes, and no fewer than spark.sql.shuffle.partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(MAX_PARTS, -(-(size_of(df) or 0) // each)))


def held_out(id_col: str, folds: int, fold: int):
    """crc32 of the id as text, by remainder; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def lowest_hash_rows(df: DataFrame, id_col: str, most: int, salt: int = 0) -> DataFrame:
    """At most about `most` rows of `df`: those whose salted id hash is lowest. Only ids are sorted, not whole rows."""
    h = F.xxhash64(F.lit(salt), F.col(id_col))
    kth = df.select(h.alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0]
    return df.filter(h <= kth) if kth is not None else df.filter(F.lit(False))


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with columns named by place, so that no name of an operator's own can clash, and the new name of each column."""
    names = [f"column_{i}__" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))
