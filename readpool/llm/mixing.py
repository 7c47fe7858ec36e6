"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. The target of a source is its weight's part of all words, at most `cap` times the source's words; what lies above
   is shared again by weight until no source is above.
2. Sources get whole blocks of `block` words by the highest quotients target / (2k - 1).
3. Each source's blocks go to its shards (seeded groups of about `shard_docs` documents) by the same rule.
4. In a shard, documents are laid end to end in seeded order, and the quota is a contiguous run of blocks of this order from a
   seeded start, going round as often as needed (not a draw of single blocks, which would cut documents into pieces); so a
   document is taken at most `cap` times and reruns agree.

Only (id, source, size) rows are shuffled. A source's shards are at most MAX_SHARDS rows of numbers, however large it is.

Defined results: a null text has size 0 and is taken 0 times; a null source is a source of its own, last in order;
repeated rows (also with the same id) are documents of their own; rows with equal id and size in a shard are told apart in
`take` by a hash of the text, so reruns take the same texts; a text of any length is counted whole; an empty table gives an empty
one; columns of `docs` never clash with those made on the way. Rows of numbers about sources (one a source) are sorted in one
task.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readpool.llm import common
from readpool.llm.common import give_back_memory

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 16
SHARD_DOCS = 64
MAX_SHARDS = 1 << 20
SEED = 17


def sainte_lague(targets: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients targets / (2k - 1), none above `most`; ties go to the lower index.

    A divisor that gives too few seats at most is found by bisection, then the remaining seats are dealt out one by one.
    """
    targets = np.asarray(targets, float)
    most = np.where(targets > 0, most, 0).astype(np.int64)
    seats = min(int(seats), int(most.sum()))
    if seats <= 0:
        return np.zeros(len(targets), np.int64)
    at = lambda d: np.minimum(most, np.floor(np.minimum(targets / d, 4e18) + 0.5).astype(np.int64))
    low, high = targets.sum() / (4 * seats + 4 * len(targets)), targets.max() * 4
    while at(low).sum() < seats and low > 1e-300:
        low /= 4
    for _ in range(200):
        mid = (low + high) / 2
        if at(mid).sum() > seats:
            low = mid
        else:
            high = mid
    got = at(high)
    while (left := seats - int(got.sum())) > 0:
        quotient = np.where(got < most, targets / (2 * got + 1), -1.0)
        best = np.argsort(-quotient, kind="stable")[:left]
        best = best[quotient[best] == quotient[best[0]]]
        got[best] += 1
    return got


def source_targets(sized: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, n_docs, target) by water filling; one row for each source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_code_point) - 1) % len(weights) + 1).cast("double")
    per = per.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    # Sources fill up in the order of most / weight: the first k are full if sharing the rest among the others would overfill the k-th.
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    so_far = filling.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(so_far), F.lit(0))
    others = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(so_far), F.lit(0.0))
    per = per.withColumn("level", rest / others).withColumn("full", F.col("most") < F.col("weight") * F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(every)  # it falls once the rest would not be full
    return per.withColumn("target", F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight") * level)).select("source", "source_size", "n_docs", "target")


def mixed(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", *, weights=WEIGHTS, cap=CAP, block=BLOCK, shard_docs=SHARD_DOCS, seed=SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, size, source_size, target, taken) and the columns `carry`: how many words of each document the mix takes."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(common.WORD)), F.lit(0)).cast("long")
    sized = common.stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), *(F.col(c).alias(f"carry_{c}") for c in carry)))

    def apportion(pdf: pd.DataFrame) -> pd.DataFrame:
        """Blocks for sources: all rows are sources."""
        pdf = pdf.sort_values("source", na_position="last", kind="stable")
        most = -(-cap * pdf["source_size"].to_numpy() // block)
        total = math.floor(pdf["target"].sum() / block + 0.5)
        pdf["blocks"] = sainte_lague(pdf["target"].to_numpy(), total, most)
        return pdf

    sources = source_targets(sized, weights, cap)
    kind = "source string, source_size long, n_docs long, target double, blocks long"
    quotas = common.stored(sources.groupBy().applyInPandas(apportion, kind))

    shards = F.least(F.greatest(F.ceil(F.col("n_docs") / shard_docs), F.lit(1)), F.lit(MAX_SHARDS))
    digest = lambda n, *of: F.md5(F.concat_ws(":", F.lit(str(seed + n)), *(F.col(c).cast("string") for c in of)))
    number = lambda x: F.conv(F.substring(x, 1, 15), 16, 10).cast("long")
    key = digest(0, "id")
    in_shards = sized.join(quotas.select(F.col("source").alias("s"), "source_size", "target", "blocks", shards.alias("n_shards")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    in_shards = in_shards.withColumn("shard", (number(digest(1, "id")) % F.col("n_shards")).cast("int"))

    def to_shards(pdf: pd.DataFrame) -> pd.DataFrame:
        """Blocks for shards: all rows are shards of one source."""
        pdf = pdf.sort_values("shard")
        pdf["quota"] = sainte_lague(pdf["words"].to_numpy(), pdf["blocks"].iloc[0], -(-cap * pdf["words"].to_numpy() // block))
        return pdf[["source", "shard", "words", "quota"]]

    per_shard = in_shards.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("blocks").alias("blocks"))
    per_shard = per_shard.groupBy("source").applyInPandas(to_shards, "source string, shard int, words long, quota long")
    per_shard = per_shard.select(F.col("source").alias("s"), F.col("shard").alias("h"), "words", F.least(F.col("quota") * block, cap * F.col("words")).alias("quota"))

    rows = in_shards.join(per_shard, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h")))
    laid = Window.partitionBy("source", "shard").orderBy(key, "id", "size", *(f"carry_{c}" for c in carry)).rowsBetween(Window.unboundedPreceding, -1)
    n = F.greatest(F.col("words"), F.lit(1))
    a = F.coalesce(F.sum("size").over(laid), F.lit(0))
    # The run starts at a block of the shard and covers `over` words, going round the end.
    start = (number(digest(2, "source", "shard")) % F.greatest(F.floor(F.col("words") / block), F.lit(1))) * block
    over = F.col("quota") % n
    lap = lambda x, y: F.greatest(F.lit(0), F.least(F.col("a") + F.col("size"), y) - F.greatest(F.col("a"), x))
    rows = rows.withColumn("a", a).withColumn("start", start).withColumn("over", over)
    taken = F.floor(F.col("quota") / n) * F.col("size") + lap(F.col("start"), F.col("start") + F.col("over")) + lap(F.lit(0), F.col("start") + F.col("over") - n)
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"), *(F.col(f"carry_{c}").alias(c) for c in carry))


def take(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **options) -> DataFrame:
    """The mix itself: a document of which it takes q whole copies and r words more gives q equal rows and one row with its
    first r words; one of which it takes nothing gives none. Columns stay those of `docs`."""
    plain, name = common.renamed(docs)
    ids = plain.groupBy(name[id_col]).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(name[id_col]).isNull())
    if ids.isEmpty():  # ids tell rows apart
        numbered, by = plain, name[id_col]
        amounts = mixed(plain, name[id_col], name[text_col], name[source_col], **options)
    else:
        numbered, by = common.stored(plain.withColumn("hash__", F.xxhash64(name[text_col])).withColumn("row__", F.monotonically_increasing_id())), "row__"
        amounts = mixed(numbered, name[id_col], name[text_col], name[source_col], carry=("hash__", "row__"), **options)
    amounts = amounts.filter("taken > 0").select(F.col(by).alias("of__"), F.col("size").alias("size__"), F.col("taken").alias("taken__"))
    rows = numbered.join(amounts, F.col(by) == F.col("of__")).select(*plain.columns, "size__", "taken__").toDF(*docs.columns, "size__", "taken__")
    columns = docs.columns
    at = columns.index(text_col)
    word = re.compile(common.WORD)

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            which, out = [], []
            for i, (x, size, taken) in enumerate(zip(texts, b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)):
                whole, rest = divmod(taken, size)
                out += [x] * whole
                if rest:
                    out.append(x[: next(itertools.islice(word.finditer(x), rest - 1, None)).end()])
                which += [i] * (whole + bool(rest))
            index = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if j == at else b.column(j).take(index) for j in range(len(columns))], columns)
        b = texts = out = index = None
        give_back_memory()

    return rows.mapInArrow(run, docs.select("*").schema)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(common.table(spark, sf_dir, "documents"))
