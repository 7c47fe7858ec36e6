"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

Chat logs often hold a conversation several times: a snapshot after each turn. A conversation is dropped if its turns
are a proper prefix of another's; of equal conversations the one with the smallest id stays. Rolling prefix hashes find
this: the hash of a prefix is the bitwise XOR of position-keyed hashes of its turns, so prefixes of any conversation
come from sums of blocks of turns and no task needs a whole conversation in order. Two independent 64-bit parts and the
length identify a prefix. The kept conversations are rendered as one text, or, where they have more than `BLOCK_TURNS` turns, as
one for each BLOCK_TURNS of them by place, so that no task renders a conversation without bound; the texts of the parts, joined
in order, are the conversation.

Defined results: turns of one conversation are ordered by (turn, role, text), nulls first; rows that repeat another in
all four columns count once; a null role or text is rendered as empty and differs from an empty one when prefixes are
compared; rows with a null conv_id form one conversation; of equal ones the smallest conv_id stays, a null one only if all are
null; an empty table gives an empty one; other columns play no part, whatever their names; a turn of any length is hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readpool.llm import common

BLOCK_TURNS = 256
START, END = "<|im_start|>", "<|im_end|>"


def positioned(df: DataFrame) -> DataFrame:
    """Distinct turns with block, pos (1 for the first turn of a conversation) and the rolling prefix hashes h1, h2."""
    turns = df.select("conv_id", "turn", "role", "text").distinct().withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(2**40))))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    turns = same(turns.withColumn("k", F.row_number().over(inside)), sizes, "n", "first").withColumn("pos", F.col("first") + F.col("k"))
    said = F.concat_ws("\x01", F.col("pos"), *(F.when(F.col(c).isNull(), F.lit("\x02")).otherwise(F.concat(F.lit("\x03"), F.length(c), F.lit(":"), F.col(c))) for c in ("role", "text")))
    md5 = F.md5(said.cast("binary"))
    part = lambda a: F.conv(F.substring(md5, a, 15), 16, 10).cast("long")
    turns = turns.withColumn("m1", part(1)).withColumn("m2", part(16))
    sums = turns.groupBy("conv_id", "block").agg(F.bit_xor("m1").alias("m1"), F.bit_xor("m2").alias("m2"))
    for i in "12":
        sums = sums.withColumn(f"b{i}", F.coalesce(F.bit_xor(f"m{i}").over(before), F.lit(0)))
    turns = same(turns, sums, "b1", "b2")
    rolling = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    for i in "12":
        turns = turns.withColumn(f"h{i}", F.bit_xor(f"m{i}").over(rolling).bitwiseXOR(F.col(f"b{i}")))
    return turns.select("conv_id", "turn", "role", "text", "block", "pos", "h1", "h2")


def same(turns: DataFrame, blocks: DataFrame, *columns: str) -> DataFrame:
    """`turns` with columns of the row of `blocks` for the same conversation and block."""
    b = blocks.select(F.col("conv_id").alias("c_"), F.col("block").alias("b_"), *columns)
    return turns.join(b, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("block") == F.col("b_"))).drop("c_", "b_")


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that stay; n_copies counts equal ones, itself included."""
    whole = turns.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("whole"))
    whole = whole.select("conv_id", "whole.*")
    distinct = whole.groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"), F.count_if(F.col("conv_id").isNull()).alias("nulls"))
    distinct = distinct.withColumn("conv_id", F.when(F.col("nulls") == F.col("n_copies"), F.lit(None)).otherwise(F.col("conv_id")))
    # A turn that is not its conversation's last ends a proper prefix.
    last = whole.select(F.col("conv_id").alias("c_"), F.col("pos").alias("last"))
    proper = turns.select("conv_id", "pos", "h1", "h2").join(last, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("pos") < F.col("last"))).select("pos", "h1", "h2").distinct()
    return distinct.join(proper, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "n_copies")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(END), F.lit("\n"))


def formatted(df: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, n_copies, rendered): the kept conversations; part counts from 0, and is 0 alone for most."""
    turns = common.stored(positioned(df))
    kept = maximal(turns).withColumnRenamed("conv_id", "c_")
    rows = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("c_"))).withColumn("part", F.expr(f"int((pos - 1) div {BLOCK_TURNS})"))
    text = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("pos", rendered(F.col("role"), F.col("text")).alias("s")))), lambda x: x["s"]))
    return rows.groupBy("conv_id", "part").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), text.alias("rendered"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(common.table(spark, sf_dir, "conversations"))


OP2_SQL = """
WITH t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
), p AS (
  SELECT conv_id, turn, role, text, pos,
    list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS said,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM t
), whole AS (
  SELECT said, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(n) AS n FROM p WHERE pos = n GROUP BY said
), kept AS (
  SELECT * FROM whole WHERE said NOT IN (SELECT said FROM p WHERE pos < n)
)
SELECT t.conv_id, CAST((pos - 1) // 256 AS INTEGER) AS part, any_value(n) AS n_turns, any_value(n_copies) AS n_copies,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM t JOIN kept ON t.conv_id IS NOT DISTINCT FROM kept.conv_id
GROUP BY t.conv_id, (pos - 1) // 256
"""
