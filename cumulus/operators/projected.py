"""Oriented projected clustering (Aggarwal & Yu 2000) and principal-component reduction."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulus.functions.vectors import matrix, vector_array
from cumulus.operators.folds import fold, map_blocks
from cumulus.operators.gaussians import cluster_models, origin_of
from cumulus.operators.kmeans import random_centers
from cumulus.session import check_state, spread


@dataclass
class ProjectedFit:
    centers: np.ndarray
    axes: list[np.ndarray]  # (d, l) directions of least spread
    energy: float = math.inf


def _projected2(X, centers, axes):
    return np.stack([(((X - c) @ e) ** 2).sum(1) for c, e in zip(centers, axes)], 1)


def _sums(points, origin, fit) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    k, d = fit.centers.shape
    check_state(k * (1 + d + d * d), "projected clusters")

    def step(batch):
        X = matrix(batch.column("x"))
        D = _projected2(X, fit.centers, fit.axes)
        at = D.argmin(1)
        Z = X - origin
        out = [np.array([D[np.arange(len(X)), at].sum()])]
        for i in range(k):
            mine = Z[at == i]
            out += [np.array([len(mine)]), mine.sum(0), (mine.T @ mine).ravel()]
        return np.concatenate(out)

    s = fold(points.select("x"), step, (1 + k * (1 + d + d * d),))
    rest = s[1:].reshape(k, 1 + d + d * d)
    return rest[:, 0], rest[:, 1 : 1 + d], rest[:, 1 + d :].reshape(k, d, d), float(s[0])


def _least_axes(n, s, q, l):
    mean = s / max(n, 1)
    values, vectors = np.linalg.eigh(q / max(n, 1) - np.outer(mean, mean))
    return vectors[:, :l], float(np.maximum(values[:l], 0).mean())


def projected_clusters(points: DataFrame, k: int, dim: int, start: int | None = None, seed: int = 0, shrink: float = 0.5) -> ProjectedFit:
    """k clusters in subspaces of ``dim`` dimensions, from ``start`` (3k) seeds.

    Every round is one scan for assignment and moments; choosing axes and merging the closest seeds works on
    the moments, which add up.
    """
    base = spread(points.select("id", "x"))
    start = start or 3 * k
    centers = random_centers(base, start, seed)
    d = centers.shape[1]
    now, l = start, float(d)
    slow = math.exp(-math.log(d / dim) * math.log(1 / shrink) / math.log(start / k)) if start > k and dim < d else 1.0
    fit = ProjectedFit(centers, [np.eye(d)] * start)
    origin = origin_of(base)
    while True:
        n, s, q, _ = _sums(base, origin, fit)
        live = np.flatnonzero(n > 0)
        n, s, q = list(n[live]), list(s[live]), list(q[live])
        target = max(k, int(now * shrink))
        l = max(float(dim), l * slow)
        width = dim if target == k else max(dim, round(l))
        energy = {}
        pair = lambda i, j: _least_axes(n[i] + n[j], s[i] + s[j], q[i] + q[j], width)[1]
        alive = list(range(len(n)))
        for i in alive:
            for j in alive:
                if i < j:
                    energy[i, j] = pair(i, j)
        while len(alive) > target:
            i, j = min(energy, key=energy.get)
            n[i], s[i], q[i] = n[i] + n[j], s[i] + s[j], q[i] + q[j]
            alive.remove(j)
            energy = {p: e for p, e in energy.items() if j not in p and i not in p}
            energy.update({(min(i, c), max(i, c)): pair(i, c) for c in alive if c != i})
        fit = ProjectedFit(
            np.array([s[i] / n[i] + origin for i in alive]), [_least_axes(n[i], s[i], q[i], width)[0] for i in alive]
        )
        done, now = now <= k, len(alive)
        if done or now <= k and width == dim:
            break
    fit.energy = _sums(base, origin, fit)[3]
    return fit


def assign_projected(points: DataFrame, fit: ProjectedFit, out: str = "cluster") -> DataFrame:
    def step(batch):
        D = _projected2(matrix(batch.column("x")), fit.centers, fit.axes)
        at = D.argmin(1)
        return {out: pa.array(at.astype(np.int32) + 1), "dist2": pa.array(D[np.arange(len(at)), at])}

    return map_blocks(points, step, f"`{out}` int, dist2 double", points.columns)


@dataclass
class Reduction:
    mean: np.ndarray
    axes: np.ndarray  # (d, q)
    variance: np.ndarray
    total: float


def fit_reduction(points: DataFrame, dim: int) -> Reduction:
    """Principal axes from one scan; each axis points so that its largest entry is positive."""
    model = cluster_models(points.select("x", F.lit(1).alias("_all")), "_all", ids=np.array([1]))
    values, vectors = np.linalg.eigh(model.cov[0])
    axes = vectors[:, ::-1][:, :dim]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return Reduction(model.mu[0], axes, values[::-1][:dim], float(values.sum()))


def reduce_points(points: DataFrame, red: Reduction) -> DataFrame:
    """The same rows with ``x`` in the reduced space; a fit on training rows applies to any others."""

    def step(batch):
        return {"x": vector_array((matrix(batch.column("x")) - red.mean) @ red.axes)}

    keep = [c for c in points.columns if c != "x"]
    return map_blocks(points, step, "x array<double>", [*keep]) if not keep else _replace(points, step, keep)


def _replace(points, step, keep):
    return map_blocks(points, lambda b: {"_y": step(b)["x"]}, "_y array<double>", keep).withColumnRenamed("_y", "x")
