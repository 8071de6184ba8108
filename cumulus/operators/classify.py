"""Classifiers over Gaussian models and meta-clusters of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cumulus.functions.vectors import matrix
from cumulus.operators.folds import map_blocks
from cumulus.operators.gaussians import Gaussians, assign_models, cluster_models
from cumulus.operators.mixtures import log_sum


def bayes_fit(points: DataFrame, label: str, kind: str = "full") -> Gaussians:
    """One Gaussian per label; the weights are the label shares."""
    return cluster_models(points, label, kind)


def bayes_predict(points: DataFrame, models: Gaussians, out: str = "pred", keep: list[str] | None = None) -> DataFrame:
    """Largest log prior + log density. Models of a model clustering work the same way."""
    return assign_models(points, models, prior=True, out=out, keep=keep)


def likelihood_predict(points: DataFrame, models: Gaussians, out: str = "pred", keep: list[str] | None = None) -> DataFrame:
    """Largest log density, no prior."""
    return assign_models(points, models, prior=False, out=out, keep=keep)


def mixture_component(points: DataFrame, models: Gaussians, out: str = "comp", keep: list[str] | None = None) -> DataFrame:
    """Component of highest density in a mixture; the mixture weights play no part in the choice."""
    return assign_models(points, models, prior=False, out=out, keep=keep)


def meta_log_density(models: Gaussians, members: list[list[int]], counts: np.ndarray | None = None):
    """(X) -> (n, clusters) log densities of the clusters as mixtures weighted by component counts.

    ``members`` lists component ids per cluster. A cluster whose components hold no points has undefined
    weights and gets -Inf, so it is never chosen.
    """
    counts = models.n if counts is None else counts
    place = {int(c): i for i, c in enumerate(models.ids)}
    groups = [[place[c] for c in m] for m in members]
    models.factors()

    def density(X, comp=None):
        comp = models.log_density(X) if comp is None else comp
        out = np.full((len(X), len(groups)), -np.inf)
        for g, idx in enumerate(groups):
            w = counts[idx].astype(float)
            if w.sum() > 0:
                live = w > 0
                out[:, g] = log_sum(comp[:, np.array(idx)[live]] + np.log(w[live] / w.sum()))
        return out

    return density


def meta_predict(points: DataFrame, models: Gaussians, members: list[list[int]], prior: bool = True, out: str = "pred", keep: list[str] | None = None) -> DataFrame:
    """Meta-cluster (1-based) of every row: Bayes with the cluster shares as prior, or likelihood alone."""
    density = meta_log_density(models, members)
    place = {int(c): i for i, c in enumerate(models.ids)}
    sizes = np.array([models.n[[place[c] for c in m]].sum() for m in members], float)
    with np.errstate(divide="ignore"):
        base = np.log(sizes / sizes.sum()) if prior else np.zeros(len(members))

    def step(batch):
        score = density(matrix(batch.column("x"))) + base
        return {out: pa.array(score.argmax(1).astype(np.int32) + 1)}

    return map_blocks(points, step, f"`{out}` int", points.columns if keep is None else keep)
