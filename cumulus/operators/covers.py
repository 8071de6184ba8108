"""Covers: over-segmentations of a cloud into Gaussian models with a filtered complex over them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulus.operators import complexes
from cumulus.operators.description import description_accepts
from cumulus.operators.gaussians import Gaussians, assign_models, assignment_sizes, cluster_models, construct_models, prune_models, reassign_outliers
from cumulus.operators.kmeans import assign_centers, best_of_restarts
from cumulus.operators.manifolds import manifold_clusters
from cumulus.operators.mixtures import dirichlet_mixture, factor_analysers, gaussian_mixture


@dataclass
class Cover:
    models: Gaussians
    cells: DataFrame  # filtered cells (run_id, dim, verts, w, ord)

    @property
    def edges(self) -> DataFrame:
        return self.cells.filter("dim = 1").select("run_id", F.col("verts")[0].alias("a"), F.col("verts")[1].alias("b"), "w", "ord")

    def assign(self, points: DataFrame) -> DataFrame:
        return assign_models(points, self.models)


def build(points: DataFrame, models: Gaussians, eps: float = float("inf"), max_dim: int = 1, run: str = "run") -> Cover:
    vertices, edges = complexes.cluster_graph(points, models, eps, run)
    cap = complexes.dimension_cap(max_dim, models.dim)
    return Cover(models, complexes.filtration(complexes.expand(vertices, edges, cap)))


def kmeans_cover(points, size, seed=0, restarts=1, min_size=1, kind="full", keep="best", rounds=30, **build_opts) -> Cover:
    """k-means clusters as models. Of the restarts the cheapest is kept (``keep="worst"``: the dearest)."""
    fit = best_of_restarts(points, size, restarts, seed, keep=keep, rounds=rounds)
    models = construct_models(assign_centers(points.select("id", "x"), fit), "cluster", min_size, kind)
    return build(points, models, **build_opts)


def _pruned(points, models, min_size, prune):
    models = Gaussians(models.ids, np.round(models.n).astype(np.int64), models.mu, models.cov, models.weight)
    if prune:
        return prune_models(points, models, min_size)
    models.n = assignment_sizes(points, models)
    return models


def factor_cover(points, size, factors=1, seed=0, tol=1e-3, max_iter=1000, min_size=1, prune=True, **build_opts) -> Cover:
    """Factor analysers, fitted until they settle: the rounds stop by ``tol``, ``max_iter`` only guards against a fit that never does."""
    fit = factor_analysers(points, size, factors, seed, tol, max_iter)
    return build(points, _pruned(points, fit.models, min_size, prune), **build_opts)


def mixture_cover(points, size, kind="diag", seed=0, tol=1e-3, max_iter=50, restarts=3, min_size=1, prune=True, **build_opts) -> Cover:
    fit = gaussian_mixture(points, size, kind, seed, tol, max_iter, restarts)
    return build(points, _pruned(points, fit.models, min_size, prune), **build_opts)


def dirichlet_cover(points, size, kind="diag", seed=0, tol=1e-3, max_iter=50, min_size=1, prune=True, **build_opts) -> Cover:
    """Concentration 1 / size; only components that win rows become models."""
    fit = dirichlet_mixture(points, size, 1.0 / size, kind, seed, tol, max_iter)
    return build(points, _pruned(points, fit.models, max(min_size, 1), prune), **build_opts)


def manifold_cover(points, size, seed=0, entropy_bound=0.0, search: dict | None = None, **build_opts) -> Cover:
    """Manifold clusters; models whose entropy exceeds the bound are dropped and their rows reassigned."""
    found = manifold_clusters(points, clusters=size, seed=seed, **{"max_dim": 1, **(search or {})})
    base = found.assign(points.select("id", "x"))
    fitted = cluster_models(base.filter("cluster > 0"), "cluster")
    entropy = fitted.entropy()
    good = np.isfinite(entropy) & (entropy <= entropy_bound)
    if not good.any():
        raise ValueError("every manifold cluster is wider than the entropy bound")
    kept = fitted.take(good)
    ids = [int(i) for i in kept.ids]
    held = base.withColumn("cluster", F.when(F.col("cluster").isin(ids), F.col("cluster")))
    final = reassign_outliers(held, "cluster", kept)
    sizes = {r["cluster"]: r["count"] for r in final.groupBy("cluster").count().collect()}
    n = np.array([sizes.get(i, 0) for i in ids], np.int64)
    models = Gaussians(np.arange(1, len(ids) + 1), n, kept.mu, kept.cov, n / n.sum())
    return build(points, models, **build_opts)


def cover(points: DataFrame, method: str, classes: int, multiplier: int, seed: int = 0, **opts) -> Cover:
    """Cover by name; its size is the multiplier times the expected classes."""
    size = multiplier * classes
    if method == "kmeans":
        return kmeans_cover(points, size, seed, **opts)
    if method == "factors":
        return factor_cover(points, size, seed=seed, **opts)
    if method == "mixture":
        return mixture_cover(points, size, seed=seed, **opts)
    if method == "dirichlet":
        return dirichlet_cover(points, size, seed=seed, **opts)
    if method == "manifold":
        search = {"bounded": True, **opts.pop("search", {})}
        if "ratio" in opts:
            search["accept"] = description_accepts(opts.pop("ratio"), opts.pop("error", 1e-3))
        return manifold_cover(points, size, seed, search=search, **opts)
    raise ValueError(f"unknown cover method {method}")
