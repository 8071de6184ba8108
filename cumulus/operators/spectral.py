"""Leading eigenvectors of a sparse symmetric matrix by Chebyshev-filtered subspace iteration (Zhou & Saad 2006).

A narrow block of vectors is a table with a row per vertex. One step is one join of the matrix with that table and one
grouped sum; rows never leave the executors. A filter of several steps damps all eigenvalues below the smallest one of
the block; then the block is made orthogonal through its own Gram matrix and turned to Ritz vectors. Only these small
matrices reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulus.functions.vectors import matrix, vector_array
from cumulus.operators.folds import fold, map_blocks
from cumulus.operators.neighbors import knn_join, radius_blocks
from cumulus.session import Rounds, check_state, materialise

#: Vectors carried beyond the wanted ones; how far a filter may raise an eigenvalue of 1 above the damped ones (more would
#: cost the block's Gram matrix its digits); the most steps of a filter.
SPARE, GROWTH, DEGREE = 8, 1e5, 40


@dataclass
class Spectrum:
    """``vectors``: (id, v) in the order of ``values``, falling; ``residual``: the largest norm of S v - value v."""

    vectors: DataFrame
    values: np.ndarray
    rounds: int
    residual: float
    settled: bool


def affinity_graph(points: DataFrame, neighbors: int = 10, radius: float | None = None, gamma: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The matrix (a, b, s) of degree-normalised affinities exp(-gamma d^2), and (id, deg).

    Rows are linked when either is among the other's ``neighbors`` nearest rows, or when they lie within ``radius`` if
    that is given; every row is linked with itself. Both directions of a link are rows of the matrix.
    """
    base = points.select("id", "x")
    if radius is None:
        near = knn_join(base, base, neighbors, exclude_self=True)
        pairs = near.groupBy(F.least("id", "neighbor").alias("a"), F.greatest("id", "neighbor").alias("b")).agg(F.min("dist").alias("dist"))
    else:
        pairs = radius_blocks(base, radius, "pairs")
    half = pairs.select("a", "b", F.exp(F.lit(-gamma) * F.col("dist") * F.col("dist")).alias("w"))
    loops = base.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("w"))
    graph = materialise(half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).unionByName(loops), "affinity")
    degree = materialise(graph.groupBy("a").agg(F.sum("w").alias("deg")).select(F.col("a").alias("id"), "deg"), "degree")
    side = lambda c: degree.select(F.col("id").alias(c), F.col("deg").alias(f"_{c}"))
    scaled = graph.join(side("a"), "a").join(side("b"), "b").select("a", "b", (F.col("w") / F.sqrt(F.col("_a") * F.col("_b"))).alias("s"))
    return materialise(scaled, "normalised"), degree


def _push(links: DataFrame, now: DataFrame, m: int, last: int) -> DataFrame:
    """(id, y, p): S y - last * p as the new y; the old y is the new p.

    Numbers that change between rounds stay out of the expressions, so Spark compiles each form of the step once.
    """
    new = [F.expr(f"sum(s * y[{i}]" + (f" - if(a = b, p[{i}], 0D)" if last else "") + f") as n{i}") for i in range(m)]
    old = [F.expr(f"sum(if(a = b, y[{i}], 0D)) as o{i}") for i in range(m)]
    sums = links.join(now.withColumnRenamed("id", "b"), "b").groupBy("a").agg(*new, *old)
    return sums.select(F.col("a").alias("id"), F.array(*[f"n{i}" for i in range(m)]).alias("y"), F.array(*[f"o{i}" for i in range(m)]).alias("p"))


def _ritz(gram: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ritz values, falling, and the matrix that turns the block into orthonormal Ritz vectors; dependent directions go."""
    scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
    w, U = np.linalg.eigh(gram * scale[:, None] * scale[None, :])
    some = w > 1e-14 * w[-1]
    basis = scale[:, None] * U[:, some] / np.sqrt(w[some])
    inner = basis.T @ image @ basis
    values, Q = np.linalg.eigh((inner + inner.T) / 2)
    return values[::-1], basis @ Q[:, ::-1]


def leading_vectors(links: DataFrame, k: int, rounds: int = 30, tol: float = 1e-8, seed: int = 0) -> Spectrum:
    """The ``k`` greatest eigenvalues of the symmetric matrix (a, b, s) and their orthonormal vectors.

    The matrix has its eigenvalues in [-1, 1] and a row for every (a, a). It settles when no residual norm of the wanted
    vectors exceeds ``tol``; else the last round is returned and ``settled`` is False. A matrix with fewer rows than
    ``k`` gives a vector for each row. The start depends on ids and seed only.
    """
    ids = links.filter("a = b").select(F.col("a").alias("id"))
    m = min(k + SPARE, ids.count())
    check_state(2 * m * m, "the Gram matrices of a block")
    if not m:
        return Spectrum(ids.withColumn("v", F.array().cast("array<double>")), np.empty(0), 0, 0.0, True)
    k, cuts, scaled = min(k, m), Rounds("subspace"), Rounds("filter")
    start = F.array(*[F.xxhash64("id", F.lit(seed), F.lit(j)) / float(2**63) for j in range(m)])
    now, values, residual = ids.select("id", start.alias("y"), start.alias("p")), np.empty(0), np.inf
    for done in range(1, rounds + 1):
        pushed = cuts.cut(_push(links, now, m, 0))  # y = S p

        def grams(batch):
            Y, P = matrix(batch.column("y")), matrix(batch.column("p"))
            return np.stack([P.T @ P, P.T @ Y])

        values, turn = _ritz(*fold(pushed.select("y", "p"), grams, (2, m, m)))
        m = len(values)

        def turned(batch, turn=turn):
            return {"y": vector_array(matrix(batch.column("y")) @ turn), "p": vector_array(matrix(batch.column("p")) @ turn)}

        block = cuts.cut(map_blocks(pushed, turned, "y array<double>, p array<double>", ["id"], ("id", "y", "p")))

        def apart(batch, values=values):
            return ((matrix(batch.column("y")) - matrix(batch.column("p")) * values) ** 2).sum(0)

        residual = float(np.sqrt(fold(block.select("y", "p"), apart, (m,))[:k].max()))
        if residual <= tol or done == rounds:
            break
        low, high = -1.0, float(values[-1])
        middle, half = (low + high) / 2, max((high - low) / 2, 1e-9)

        def lead(batch, middle=middle, half=half):
            P = matrix(batch.column("p"))
            return {"y": vector_array((matrix(batch.column("y")) - middle * P) / half), "p": batch.column("p")}

        now = map_blocks(block, lead, "y array<double>, p array<double>", ["id"], ("id", "y", "p"))
        moved = scaled.cut(links.withColumn("s", (F.col("s") - F.when(F.col("a") == F.col("b"), middle).otherwise(0.0)) * (2 / half)))
        steps = int(np.arccosh(GROWTH) / np.arccosh(max((1 - middle) / half, 1 + 1e-9)))
        for _ in range(min(max(steps, 2), DEGREE) - 1):
            now = cuts.cut(_push(moved, now, m, 1))
    vectors = materialise(block.select("id", F.slice("p", 1, k).alias("v")), "eigenvectors")
    return Spectrum(vectors, values[:k], done, residual, residual <= tol)
