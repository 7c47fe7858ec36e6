"""The block text format of clustered reads: an original strand, a line of `*`, its copies, two blank lines.

Parsing accepts what the format's tools accept: blank lines anywhere, CRLF, separators of any length, text before the first
header. It differs in never failing: lines that cannot be a read go to `rejects` with a reason, each block is a cluster of
its own even where two have the same strand, and reads are told apart by their line, not their text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readpool.functions.sequences import VALID, tiebreak
from readpool.plans.components import written

SEPARATOR = "*" * 29
UNKNOWN = "-1"  # the strand of a read that no pool holds


@dataclass(frozen=True)
class Pool:
    """What a block file holds."""

    originals: DataFrame  # cluster_id bigint, strand string
    reads: DataFrame  # read_id bigint, cluster_id bigint, line_no bigint, seq string
    rejects: DataFrame  # file string, line_no bigint, value string, reason string


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): the trimmed lines that are not blank. A file is read whole, as its lines need their order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
    return lines.select("file", F.col("line_no").cast("bigint").alias("line_no"), F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("value")).filter(F.length("value") > 0)


def strict_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of files known to have exactly two blank lines after each block: one record a block, so a large
    file splits over tasks. `file` is a file's path and the place of a block in it, in the order of the file."""
    place = F.format_string("%020d", F.col("_metadata.file_block_start"))
    # Records of one split come in order, and splits of a file by where they start.
    nth = F.format_string("%020d", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    records = spark.read.text(path, lineSep="\n\n\n").select(F.concat_ws(":", F.col("_metadata.file_path"), place, nth).alias("block"), "value")
    lines = records.select("block", F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return lines.select(F.col("block").alias("file"), F.col("line_no").cast("bigint").alias("line_no"), F.trim("value").alias("value")).filter(F.length("value") > 0)


def in_order(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """`rows` with `name`, their place from 0 on in the order of `by`.

    Rows are sorted by range partitions, and each partition begins where the counts of those before it end; only these counts,
    one a partition, meet in one task. The sorted rows are a table, so that partitions stay what they were when counted.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("task__", F.spark_partition_id()).withColumn("nth__", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sorted_ = written(sorted_)
    sizes = sorted_.groupBy(F.col("task__").alias("t__")).agg(F.count(F.lit(1)).alias("n__"))
    before = F.coalesce(F.sum("n__").over(Window.orderBy("t__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("t__", before.alias("start__")))  # a row for each partition
    return sorted_.join(starts, F.col("task__") == F.col("t__")).withColumn(name, F.col("start__") + F.col("nth__")).drop("task__", "nth__", "t__", "start__")


def lookup(wanted: DataFrame, pool: DataFrame) -> DataFrame:
    """(seq, strand_id string): the strand of each read of `wanted` (seq) by its text, UNKNOWN for a text that is not in `pool` (seq,
    strand_id); of several the least."""
    known = pool.groupBy(F.col("seq").alias("seq_")).agg(F.min("strand_id").cast("string").alias("strand_id"))
    return wanted.join(known, F.col("seq") == F.col("seq_"), "left").select("seq", F.coalesce("strand_id", F.lit(UNKNOWN)).alias("strand_id"))


def parse(lines: DataFrame, q: int = 6) -> Pool:
    """The pool in `lines` (file, line_no, value). Ids are consecutive in the order of file and line."""
    in_file = Window.partitionBy("file").orderBy("line_no")
    is_sep = F.col("value").startswith("*")
    marked = lines.select("file", "line_no", "value", is_sep.alias("sep"))
    marked = marked.withColumn("before_sep", F.lead("sep", 1, False).over(in_file))
    marked = marked.withColumn("header", ~F.col("sep") & F.col("before_sep"))
    opens = F.col("sep") & F.lag("header", 1, False).over(in_file)
    marked = marked.withColumn("opens", opens).withColumn("block", F.sum(F.col("opens").cast("int")).over(in_file.rowsBetween(Window.unboundedPreceding, 0)))
    headers = marked.filter("header").select("file", F.col("line_no").alias("at"), F.col("value").alias("strand"), (F.col("block") + 1).alias("block"))
    numbered = in_order(headers, ["file", "at"], "cluster_id")
    body = marked.filter("NOT sep AND NOT header AND block > 0").join(numbered.select("file", "block", "cluster_id"), ["file", "block"])
    reason = read_fault(F.col("value"), q)
    good = body.filter(reason.isNull())
    reads = in_order(good, ["file", "line_no"], "read_id").select("read_id", "cluster_id", "line_no", F.col("value").alias("seq"))
    bad = body.filter(reason.isNotNull()).select("file", "line_no", "value", reason.alias("reason"))
    stray = marked.filter("sep AND NOT opens").select("file", "line_no", "value", F.lit("separator without a strand").alias("reason"))
    return Pool(numbered.select("cluster_id", "strand"), reads, bad.unionByName(stray))


def read_fault(seq: Column, q: int) -> Column:
    """Why a line cannot be a read; null if it can."""
    return F.when(~seq.rlike(VALID), F.lit("letter outside ACGT")).when(F.length(seq) < q, F.lit("shorter than a gram"))


def read_pool(spark: SparkSession, path: str, q: int = 6, strict: bool = False) -> Pool:
    return parse(strict_blocks(spark, path) if strict else lines_of(spark, path), q)


def shuffled_ids(reads: DataFrame, seed: int) -> DataFrame:
    """`reads` with read_id replaced by its place in a seeded pseudo-random order, so that ids say nothing of clusters."""
    marked = reads.withColumn("mark__", tiebreak(seed, "read_id"))
    return in_order(marked, ["mark__", "read_id"], "place__").withColumn("read_id", F.col("place__")).drop("mark__", "place__")


def majority_strand(members: DataFrame) -> DataFrame:
    """(cluster, strand_id): the strand that most members of each cluster copy; of equals the one met first by read_id.

    members: (cluster, read_id, strand_id).
    """
    votes = members.groupBy("cluster", "strand_id").agg(F.count(F.lit(1)).alias("votes"), F.min("read_id").alias("first"))
    best = votes.groupBy("cluster").agg(F.min(F.struct(-F.col("votes"), F.col("first"), F.col("strand_id").alias("s"))).alias("b"))
    return best.select("cluster", F.col("b.s").alias("strand_id"))


def blocks(members: DataFrame, originals: DataFrame) -> DataFrame:
    """(cluster, block): the text of each cluster: its majority strand, the separator, its reads by id.

    members: (cluster, read_id, strand_id, seq); originals: (cluster_id, strand).
    """
    voted = majority_strand(members).join(originals.withColumnRenamed("cluster_id", "strand_id"), "strand_id")
    text = members.groupBy("cluster").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("read_id", "seq"))), lambda x: x["seq"])).alias("body"))
    return text.join(voted, "cluster").select("cluster", F.concat_ws("\n", F.col("strand"), F.lit(SEPARATOR), F.col("body"), F.lit(""), F.lit("")).alias("block"))


def write_blocks(members: DataFrame, originals: DataFrame, path: str) -> None:
    """A folder of text files, clusters in order of their id over the files."""
    blocks(members, originals).orderBy("cluster").select("block").write.text(path)
