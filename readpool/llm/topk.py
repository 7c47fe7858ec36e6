"""Exact top-k search by columnar branch-and-bound.

Vectors are packed into blocks in vertical layout (one row of a matrix for each dimension). A query accumulates inner
products dimension block by dimension block; after each, a candidate whose partial score plus the largest mass that the
remaining dimensions can add (Cauchy-Schwarz) is below the k-th best lower bound is dropped, and the survivors are
compacted. Components are integers; where sums could leave the exact range of doubles, whole numbers of any size are used
(a score that does not fit a bigint is given as the nearest one, but ranks by its size as a double).

Query blocks meet vector blocks in pairs, so no task holds more than one of each. Defined results: vectors that are
null or hold null or non-finite components, and rows with a null id, take no part; a query meets vectors of its own
dimension only; no row with the query's id is its candidate; repeated rows are candidates each, and a repeated query finds its
candidates once for each of its rows, within the same k ranks; ties go to the smaller id; an empty table, or one without a
query, gives no row; columns other than the two named play no part, whatever their names; long vectors are taken whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readpool.llm import common

K = 20
QUERY_DIVISOR = 20
SCALE = 64
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
DIM_BLOCK = 16


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    x = F.col(vec_col)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return df.filter(F.col(id_col).isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: floor_of(v.cast("double") * scale)).alias("v")
    )


def floor_of(x):
    """The floor as a double; from 2**53 on doubles are whole (and a bigint would be cut at 2**63)."""
    return F.when(F.abs(x) < F.lit(float(1 << 53)), F.floor(x).cast("double")).otherwise(x)


def search_block(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, columns: np.ndarray, k: int, dim_block: int) -> list[tuple]:
    """The k best of one block of vectors (columns: dimensions x vectors) for each query: (query, id, score, score as a double)."""
    d = columns.shape[0]
    if d and np.abs(columns).max(initial=0) * np.abs(q).max(initial=0) * d >= 2**53:
        return search_large(qid, q, ids, columns, k)
    cuts = list(range(0, d, dim_block)) + [d]
    mass = [np.sqrt((columns[a:] ** 2).sum(0)) * (1 + 1e-12) for a in cuts[1:]]
    q_mass = [np.sqrt((q[:, a:] ** 2).sum(1)) * (1 + 1e-12) for a in cuts[1:]]
    out = []
    order = np.argsort(ids, kind="stable")
    ids, columns, mass = ids[order], columns[:, order], [m[order] for m in mass]
    for i, own in enumerate(qid):
        alive = np.flatnonzero(ids != own)
        score = np.zeros(len(alive))
        for j, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            score = score + q[i, a:b] @ (columns[a:b] if len(alive) == columns.shape[1] else columns[a:b, alive])
            if b < d and len(alive) > k:
                rest = q_mass[j][i] * mass[j][alive]
                least = np.partition(score - rest, len(alive) - k)[len(alive) - k]
                keep = score + rest >= least - 1e-6 * (1 + abs(least))
                if keep.mean() < 0.75:
                    alive, score = alive[keep], score[keep]
        if len(alive) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            keep = np.flatnonzero(score >= least)
            keep = keep[np.argsort(-score[keep], kind="stable")][:k]  # ids ascend, so ties go to the smaller
            alive, score = alive[keep], score[keep]
        out += zip([int(own)] * len(alive), ids[alive].tolist(), score.tolist(), score.tolist(), strict=True)
    return out


def nearest(x: int) -> float:
    try:
        return float(x)
    except OverflowError:
        return float("inf") if x > 0 else float("-inf")


def search_large(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, columns: np.ndarray, k: int) -> list[tuple]:
    """The same in whole numbers of any size, for components whose products leave the exact range of doubles."""
    limit = 2**63 - 1
    vectors = [[int(x) for x in v] for v in columns.T]
    out = []
    for own, row in zip(qid.tolist(), q, strict=True):
        x = [int(c) for c in row]
        best = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for i, v in zip(ids.tolist(), vectors, strict=True) if i != own)[:k]
        out += [(own, i, max(-limit, min(limit, -s)), nearest(-s)) for s, i in best]
    return out


def top_k(df: DataFrame, id_col="vec_id", vec_col="embedding", *, k=K, divisor=QUERY_DIVISOR, scale=SCALE, block_rows=BLOCK_ROWS, query_rows=QUERY_ROWS, dim_block=DIM_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest inner product for each row whose id is divisible by `divisor`."""
    rows = quantised(df, id_col, vec_col, scale).withColumn("d", F.size("v"))
    counts = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % divisor == 0).alias("q"))
    sizes = counts.select(F.col("d").alias("dim"), F.ceil(F.col("n") / block_rows).alias("blocks"), F.greatest(F.ceil(F.col("q") / query_rows), F.lit(1)).alias("query_blocks"))
    rows = rows.join(sizes, F.col("d") == F.col("dim")).drop("dim")
    pack = "d int, part int, parts int, ids binary, m binary"

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        return pd.DataFrame({"d": [m.shape[1]], "part": [pdf["part"].iloc[0]], "parts": [pdf["parts"].iloc[0]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "m": [m.T.copy().tobytes()]})

    def blocks(of: DataFrame, n, parts) -> DataFrame:
        of = of.select("id", "v", "d", F.pmod(F.xxhash64("id"), n).cast("int").alias("part"), parts.cast("int").alias("parts"))
        return of.groupBy("d", "part").applyInPandas(packed, pack)

    wide = blocks(rows, F.col("blocks"), F.col("query_blocks")).withColumnsRenamed({"ids": "ids_c", "m": "m_c", "part": "part_c"}).drop("parts")
    asked = blocks(rows.filter(F.col("id") % divisor == 0), F.col("query_blocks"), F.col("blocks")).withColumn("part_c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def search(batches):
        for pdf in batches:
            found = []
            for r in pdf.itertuples():
                ids, qid = np.frombuffer(r.ids_c, np.int64), np.frombuffer(r.ids, np.int64)
                c, q = np.frombuffer(r.m_c).reshape(r.d, len(ids)), np.frombuffer(r.m).reshape(r.d, len(qid)).T
                found += search_block(qid, q, ids, c, k, dim_block)
            yield pd.DataFrame(found, columns=["query_id", "vec_id", "score", "size"]).astype({"query_id": "int64", "vec_id": "int64", "score": "int64", "size": "float64"})

    pairs = asked.join(wide.hint("shuffle_hash"), ["d", "part_c"])
    best = Window.partitionBy("query_id").orderBy(F.col("size").desc(), F.col("score").desc(), "vec_id")
    found = pairs.select("d", "ids", "m", "ids_c", "m_c").mapInPandas(search, "query_id long, vec_id long, score long, size double")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
