"""Density clustering, mean shift and spectral clustering over the radius join."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulus.functions.vectors import matrix, square_distances
from cumulus.operators.components import connected_components
from cumulus.operators.folds import fold, map_blocks
from cumulus.operators.kmeans import KMeansFit, assign_centers, best_by_agreement, lloyd
from cumulus.operators.neighbors import knn_join, kth_distances, radius_blocks
from cumulus.operators.ordering import number_rows, seeded_pick
from cumulus.operators.spectral import affinity_graph, leading_vectors
from cumulus.session import MAX_STATE, check_state, materialise, spread

#: Rows for each wanted vector from which the start centres of a spectral clustering are drawn.
_STARTS = 50


def dbscan(points: DataFrame, radius: float, min_cluster_size: int = 1, min_neighbors: int = 1) -> DataFrame:
    """(id, cluster): components of core points; everything else is one noise cluster, numbered last.

    A core point has at least ``min_neighbors`` rows within the radius, itself included. Border points stay
    in the noise. Clusters are numbered by their smallest id.
    """
    base = points.select("id", "x")
    spots = materialise(base.groupBy("x").agg(F.min("id").alias("id"), F.count("*").alias("w")).select("id", "x", "w"), "spots")
    core = spots
    if min_neighbors > 1:
        near = radius_blocks(spots, radius, "degree").groupBy("id").agg(F.sum("near").alias("near"))
        counted = spots.join(near, "id", "left").withColumn("near", F.coalesce("near", F.lit(0)) + F.col("w"))
        core = materialise(counted.filter(F.col("near") >= min_neighbors).select("id", "x", "w"), "core")
    linked = connected_components(radius_blocks(core, radius, "forest"))
    owner = core.join(linked, "id", "left").select("x", "w", F.coalesce("component", "id").alias("component"))
    owner = materialise(owner, "owner")
    big = owner.groupBy("component").agg(F.sum("w").alias("size")).filter(F.col("size") >= min_cluster_size)
    named = number_rows(big, [], ["component"], "cluster").select("component", F.col("cluster").cast("int").alias("cluster"))
    noise = named.agg(F.coalesce(F.max("cluster"), F.lit(0)) + 1).first()[0]
    labelled = owner.join(named, "component", "left").select("x", F.coalesce("cluster", F.lit(noise)).alias("cluster"))
    return base.join(labelled, "x", "left").select("id", F.coalesce("cluster", F.lit(noise)).cast("int").alias("cluster"))


def estimate_bandwidth(points: DataFrame, quantile: float, sample: int | None = None, seed: int = 0) -> float:
    """Mean distance to the (quantile x n)-th row, the row itself included; ``sample`` is the estimator's own option."""
    base = points.select("id", "x")
    if sample:
        base = seeded_pick(base, sample, seed)
    n = base.count()
    return kth_distances(base, max(1, int(n * quantile))).agg(F.avg("far")).first()[0]


def mean_shift(points: DataFrame, bandwidth: float, max_rounds: int = 100, bin_size: float | None = None) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, dist2) and the modes: flat-kernel mean shift from the occupied bins of a grid.

    Seeds move on their own, so they are shifted in slices of bounded size; each round of a slice is one scan.
    Modes within a bandwidth of a more populated one are merged into it.
    """
    size = bin_size or bandwidth
    binned = points.select(F.transform("x", lambda v: F.round(v / size)).alias("b")).distinct()
    seeds = materialise(binned.select(F.monotonically_increasing_id().alias("id"), F.transform("b", lambda v: v * size).alias("x")), "seeds")
    d = points.select(F.size("x")).first()[0]
    slice_rows = max(1, min(4096, MAX_STATE // (4 * (d + 1))))
    slices = -(-seeds.count() // slice_rows)
    modes: list[tuple[float, tuple]] = []
    for i in range(slices):
        rows = seeds.filter(F.pmod(F.xxhash64("id"), F.lit(slices)) == i).select("x").toArrow().column(0)
        if not len(rows):
            continue
        S = matrix(rows).copy()
        moving = np.ones(len(S), bool)
        weight = np.zeros(len(S))
        for _ in range(max_rounds):
            here = S[moving]

            def step(batch, here=here):
                X = matrix(batch.column("x"))
                near = (square_distances(here, X) <= bandwidth * bandwidth).astype(float)
                return np.concatenate([near.sum(1, keepdims=True), near @ X], axis=1)

            s = fold(points.select("x"), step, (len(here), d + 1))
            live = s[:, 0] > 0
            new = np.where(live[:, None], s[:, 1:] / np.maximum(s[:, :1], 1), here)
            weight[moving] = s[:, 0]
            shift = np.sqrt(((new - here) ** 2).sum(1))
            S[moving] = new
            moving[np.flatnonzero(moving)[(shift < 1e-3 * bandwidth) | ~live]] = False
            if not moving.any():
                break
        modes += sorted({(float(w), tuple(np.round(m, 9))) for w, m in zip(weight, S) if w > 0})
        check_state(len(modes) * d, "modes")
    modes.sort(key=lambda m: (-m[0], m[1]))
    kept: list[np.ndarray] = []
    for _, m in modes:
        m = np.array(m)
        if all(((m - o) ** 2).sum() > bandwidth * bandwidth for o in kept):
            kept.append(m)
    centers = np.array(kept)

    def near(batch):
        D = square_distances(matrix(batch.column("x")), centers)
        at = D.argmin(1)
        return {"cluster": pa.array(at.astype(np.int32) + 1), "dist2": pa.array(D[np.arange(len(at)), at])}

    return map_blocks(points, near, "cluster int, dist2 double", points.columns), centers


def spectral(points: DataFrame, label: str, classes: int, radius: float | None = None, gamma: float = 1.0, seed: int = 0, rounds: int = 30, neighbors: int = 10, tol: float = 1e-6, restarts: int = 3) -> DataFrame:
    """(id, cluster): k-means on the first k vectors of the affinity over k = 2 .. 4 x classes, the k that agrees best with the labels.

    Links are those of ``affinity_graph``: nearest neighbours, or all pairs within ``radius`` if that is given. All k
    share the scans, and of each k the start of least cost is kept; vectors are scaled by the degrees, so that rows of one
    component get equal values.
    """
    links, degree = affinity_graph(points, neighbors, radius, gamma)
    most = 4 * classes
    found = leading_vectors(links, most, rounds, tol, seed)
    if not found.settled:
        warnings.warn(f"spectral: after {found.rounds} rounds the residual is {found.residual:.1e}, above {tol:.1e}", stacklevel=2)
    emb = found.vectors.join(degree, "id").select("id", F.transform("v", lambda v: v / F.sqrt("deg")).alias("x"))
    emb = materialise(points.select("id", label).join(emb, "id").select("id", label, "x"), "embedding")
    ks = [k for k in range(2, most + 1) if k <= len(found.values)]
    check_state(_STARTS * most * most, "start rows")
    rows = np.array([r["x"] for r in seeded_pick(emb.select("id", "x"), _STARTS * most, seed).collect()], float)
    rng = np.random.default_rng(seed)
    tries = lloyd(spread(emb.select("id", "x")), [KMeansFit(f"k{k}-{i}", _apart(rows[:, :k], k, rng)) for k in ks for i in range(restarts)])
    fits = [min((f for f in tries if f.k == k), key=lambda f: f.cost) for k in ks]
    return assign_centers(emb, best_by_agreement(emb, label, fits)).select("id", "cluster")


def _apart(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k start centres among ``rows``, each drawn by its squared distance to those before it (Arthur & Vassilvitskii 2007)."""
    picked = [rows[rng.integers(len(rows))]]
    near = np.full(len(rows), np.inf)
    while len(picked) < k:
        near = np.minimum(near, ((rows - picked[-1]) ** 2).sum(1))
        total = near.sum()
        picked.append(rows[rng.choice(len(rows), p=near / total) if total > 0 else rng.integers(len(rows))])
    return np.array(picked)
