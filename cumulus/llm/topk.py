"""Exact top-k search by exhaustive term-at-a-time accumulation.

Candidates and queries are dealt into blocks of bounded size. A task takes one block of each: it turns the candidates
into posting lists by dimension, and every query scatters weight x posting into a dense array of scores, one of its
non-zero dimensions after another. A partition step keeps the k best of the block; the blocks' lists are merged by a
window. Nothing is broadcast, and no task holds more than one block of each side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cumulus.llm.common import query, table

QUERY_BLOCK, CANDIDATE_BLOCK = 1_024, 8_192
#: The largest long, which no exact component takes: in its place a component outside a long is seen and refused.
LIMIT = (1 << 63) - 1


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, exact; +-LIMIT where it is outside a long, which ``top_k`` refuses; null for a null vector or one with a component that is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    cell = lambda x: F.least(F.greatest(F.floor(F.lit(scale) * x.cast("double")), F.lit(-LIMIT)), F.lit(LIMIT))
    return F.when(F.coalesce(finite, F.lit(False)), F.transform(vector, cell))


def _sparse(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, dimension, weight) of the non-zero components."""
    sizes = vectors.map(len).to_numpy(dtype=np.int64)
    weights = np.concatenate([np.asarray(v, dtype=np.int64) for v in vectors]) if len(vectors) else np.empty(0, np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    dims = np.arange(len(weights)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    some = weights != 0
    return rows[some], dims[some], weights[some]


def block_best(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query_key, query_id, vec_id, score) of the k best rows of the block for each query; ties go to the smaller id."""
    rows = rows.sort_values("vec_id", kind="stable")
    ids = rows["vec_id"].to_numpy(dtype=np.int64)
    at, dims, weights = _sparse(rows["w"])
    q_at, q_dims, q_weights = _sparse(queries["w"])
    high = [max(int(w.max()), -int(w.min())) if len(w) else 0 for w in (weights, q_weights)]
    if max(high) >= LIMIT:
        raise ValueError("a component is outside a long")
    # sums that could leave a long are taken in whole numbers of any size
    wide = high[0] * high[1] * max(1, *rows["w"].map(len)) > LIMIT if len(rows) else False
    if wide:
        weights, q_weights = weights.astype(object), q_weights.astype(object)
    order = np.argsort(dims, kind="stable")
    at, dims, weights = at[order], dims[order], weights[order]
    width = int(dims.max()) + 1 if len(dims) else 0
    ends = np.searchsorted(dims, np.arange(width + 1))
    # a list that names every row needs no scatter by index
    lists = [(slice(None) if ends[d + 1] - ends[d] == len(ids) else at[ends[d] : ends[d + 1]], weights[ends[d] : ends[d + 1]]) for d in range(width)]
    q_ends = np.searchsorted(q_at, np.arange(len(queries) + 1))
    out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    scores = np.empty(len(ids), object if wide else np.int64)
    for i, (key, own) in enumerate(zip(queries["query_key"], queries["query_id"], strict=True)):
        scores[:] = 0
        for j in range(q_ends[i], q_ends[i + 1]):
            if q_dims[j] < width:
                where, posting = lists[q_dims[j]]
                scores[where] += q_weights[j] * posting
        others = np.flatnonzero(ids != own)
        mine = scores[others]
        if len(mine) > k:
            least = np.partition(mine, len(mine) - k)[len(mine) - k]
            over = np.flatnonzero(mine > least)
            pick = np.concatenate([over, np.flatnonzero(mine == least)[: k - len(over)]])
            others, mine = others[pick], mine[pick]
        if wide and any(abs(x) > LIMIT for x in mine):
            raise ValueError("a score is outside a long")
        out.append((key, own, ids[others], mine.astype(np.int64)))
    sizes = [len(x[2]) for x in out]
    return pd.DataFrame(
        {
            "query_key": np.repeat(np.array([x[0] for x in out], np.int64), sizes),
            "query_id": np.repeat(np.array([x[1] for x in out], np.int64), sizes),
            "vec_id": np.concatenate([x[2] for x in out]) if out else np.empty(0, np.int64),
            "score": np.concatenate([x[3] for x in out]) if out else np.empty(0, np.int64),
        }
    )


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (vec_id, w) the k rows (vec_id, w) with the highest inner products.

    ``w`` is array<long>; null vectors and null ids take no part; vectors of unequal length are as if padded with
    zeros. Equal rows count once; different vectors under one id are rows of their own, and a query never meets its
    own id. A component or a best score of a block outside a long is an error. Ties go to the smaller vec_id. Fewer than k rows give all; an empty table gives an empty result.
    """
    whole = [x.select("vec_id", "w").filter("vec_id is not null and w is not null").dropDuplicates() for x in (rows, queries)]
    sizes = [max(1, -(-x.count() // n)) for x, n in zip(whole, (CANDIDATE_BLOCK, QUERY_BLOCK), strict=True)]
    key = F.xxhash64("vec_id", "w")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = whole[1].select(key.alias("query_key"), F.col("vec_id").alias("query_id"), "w").withColumn("qb", F.pmod("query_key", F.lit(sizes[1])).cast("int")).withColumn("cb", every(sizes[0]))
    right = whole[0].select("vec_id", "w", F.pmod(key, F.lit(sizes[0])).cast("int").alias("cb")).withColumn("qb", every(sizes[1]))
    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(lambda q, c: block_best(q, c, k), "query_key long, query_id long, vec_id long, score long")
    best = W.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query(
    "op6_topk",
    """
    WITH v AS (
      SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS w FROM embeddings
      WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
)
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rows of ``embeddings`` with the highest integer inner products, for every vec_id divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding"), 1024).alias("w"))
    return top_k(rows, rows.filter("vec_id % 100 = 0"), 10)
