"""Blocking joins: reads meet where a key is equal, next to each other in a seeded order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readpool.functions.sequences import band_key, substring_key, tiebreak


def band_keys(sketched: DataFrame, rounds: list[tuple[int, ...]], bits: int, first_round: int = 0) -> DataFrame:
    """`sketched` (with sig) in one row for each round: round int, key bigint, and all columns but sig."""
    rest = [c for c in sketched.columns if c != "sig"]
    keys = F.array(*(F.struct(F.lit(first_round + r).alias("round"), band_key("sig", p, bits).alias("key")) for r, p in enumerate(rounds)))
    return sketched.select(*rest, F.explode(keys).alias("b")).select(*rest, "b.round", "b.key")


def adjacent_pairs(keyed: DataFrame, within: list[str], seed: int, flag: str | None = None) -> DataFrame:
    """(round, a, b) with a < b: rows next to each other among those that are equal in `within`. With `flag`, a column of
    the rows, also that of either as (flag)_a and (flag)_b.

    This makes at most one pair for each row, however large a bucket is. The order inside a bucket is pseudo-random and
    differs by round.
    """
    mark = tiebreak(seed, F.concat_ws(":", F.col("round"), F.col("read_id")))
    order, flags = Window.partitionBy(*within).orderBy(mark, "read_id"), [flag] * bool(flag)
    pairs = keyed.select("round", "read_id", F.lag("read_id").over(order).alias("other"), *flags, *(F.lag(f).over(order).alias("other_flag") for f in flags))
    pairs = pairs.filter("other IS NOT NULL AND other <> read_id")
    lower = F.col("read_id") < F.col("other")
    both = [x for f in flags for x in (F.when(lower, F.col(f)).otherwise(F.col("other_flag")).alias(f"{f}_a"), F.when(lower, F.col("other_flag")).otherwise(F.col(f)).alias(f"{f}_b"))]
    return pairs.select("round", F.least("read_id", "other").alias("a"), F.greatest("read_id", "other").alias("b"), *both)


def substring_edges(rows: DataFrame, anchors: list[tuple[str, ...]], length: int) -> DataFrame:
    """(a, b): chunk ids that some key holds together, each with the least chunk id of its key.

    rows: (chunk_id, seq, turn); the row's key has the anchors of its turn, and keys of different turns do not meet. Equal
    keys merge whole buckets, so a star of edges says the same as all pairs. The least id comes from an aggregate that
    combines before the shuffle.
    """
    key = F.lit(None).cast("array<string>")
    for i, a in enumerate(anchors):
        key = F.when(F.col("turn") == i, substring_key("seq", list(a), length)).otherwise(key)
    keyed = rows.select("chunk_id", "turn", key.alias("key"))
    least = keyed.groupBy("turn", "key").agg(F.min("chunk_id").alias("a"), F.max("chunk_id").alias("hi")).filter("a <> hi").select(F.col("key").alias("k"), F.col("turn").alias("t"), "a")
    return keyed.join(least, (F.col("key") == F.col("k")) & (F.col("turn") == F.col("t"))).filter("chunk_id <> a").select("a", F.col("chunk_id").alias("b")).distinct()
