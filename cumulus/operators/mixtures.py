"""Mixture models by expectation-maximisation.

One round is one scan: a block step turns rows into responsibilities and sums the sufficient statistics;
only k-sized sums reach the driver, which updates the parameters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from cumulus.functions.vectors import matrix
from cumulus.operators.folds import fold, packed
from cumulus.operators.gaussians import LOG_2PI, Gaussians, origin_of
from cumulus.operators.kmeans import assign_centers, best_of_restarts
from cumulus.operators.gaussians import cluster_models
from cumulus.session import check_state, spread

FLOOR = 1e-6  # smallest variance a component may have


@dataclass
class MixtureFit:
    models: Gaussians
    loglik: float
    trace: list[float]


def log_sum(a: np.ndarray) -> np.ndarray:
    top = a.max(1, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(1, keepdims=True)))[:, 0]


def _soft_sums(points: DataFrame, origin: np.ndarray, k: int, kind: str, log_joint, with_id: bool = False):
    """(loglik, N, sums, second moments) under the responsibilities of ``log_joint``, shifted by ``origin``."""
    d = len(origin)
    width = d * d if kind == "full" else d
    check_state(k * (1 + d + width), "mixture statistics")

    def step(batch):
        X = matrix(batch.column("x"))
        joint = log_joint(X, batch.column("id").to_numpy()) if with_id else log_joint(X)
        norm = log_sum(joint)
        R = np.exp(joint - norm[:, None])
        Z = X - origin
        if kind == "full":
            second = np.stack([(Z * R[:, i : i + 1]).T @ Z for i in range(k)])
        else:
            second = R.T @ (Z * Z)
        return np.concatenate([[norm.sum()], R.sum(0), (R.T @ Z).ravel(), second.ravel()])

    flat = fold(points.select("id", "x") if with_id else points.select("x"), step, (1 + k * (1 + d + width),))
    s = flat[1:]
    shape = (k, d, d) if kind == "full" else (k, d)
    return flat[0], s[:k], s[k : k * (1 + d)].reshape(k, d), s[k * (1 + d) :].reshape(shape)


def _moments(N, S, Q):
    safe = np.maximum(N, 1e-12)
    mean = S / safe[:, None]
    if Q.ndim == 3:
        return mean, Q / safe[:, None, None] - mean[:, :, None] * mean[:, None, :]
    return mean, Q / safe[:, None] - mean * mean


def _shape(cov, kind):
    d = cov.shape[1]
    if kind == "full":
        return cov + FLOOR * np.eye(d)
    cov = np.maximum(cov, 0)
    if kind == "spherical":
        cov = np.repeat(cov.mean(1, keepdims=True), d, axis=1)
    return cov + FLOOR


def start_models(points: DataFrame, k: int, kind: str, seed: int, rounds: int = 10) -> Gaussians:
    fit = best_of_restarts(points, k, 1, seed, rounds=rounds)
    fitted = cluster_models(assign_centers(points.select("id", "x"), fit), "cluster", "full" if kind == "full" else "diag", np.arange(1, k + 1))
    fitted.mu = np.where(fitted.n[:, None] > 0, fitted.mu, fit.centers)
    fitted.cov = _shape(fitted.cov, kind)
    fitted.n = np.maximum(fitted.n, 1)
    return Gaussians(fitted.ids, fitted.n, fitted.mu, fitted.cov)


def gaussian_mixture(points: DataFrame, k: int, kind: str = "full", seed: int = 0, tol: float = 1e-3, max_iter: int = 100,
                     restarts: int = 1, start: Gaussians | None = None) -> MixtureFit:
    """Full, diagonal or spherical mixture; of several restarts the likeliest.

    ``tol`` is the gain in mean log-likelihood below which a fit stops; variances are floored at 1e-6.
    """
    best, points = None, spread(points.select("id", "x"))
    rows = packed(points)
    for r in range(restarts):
        models = start or start_models(points, k, kind, seed + r)
        origin, trace = origin_of(points), []
        for _ in range(max_iter):
            models.factors()
            logw = np.log(models.weight)
            ll, N, S, Q = _soft_sums(rows, origin, len(models), "full" if kind == "full" else "diag", lambda X: models.log_density(X) + logw)
            total = N.sum()
            trace.append(ll / total)
            if len(trace) > 1 and trace[-1] - trace[-2] < tol:
                break
            mean, cov = _moments(N, S, Q)
            models = Gaussians(models.ids, N, mean + origin, _shape(cov, kind), N / total)
        fit = MixtureFit(models, trace[-1] * total, trace)
        if best is None or fit.loglik > best.loglik:
            best = fit
    return best


def digamma(x: np.ndarray) -> np.ndarray:
    """Recurrence up to 6, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (x < 6).any():
        out = np.where(x < 6, out - 1 / np.where(x < 6, x, 1), out)
        x = np.where(x < 6, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))


def _uniform(ids: np.ndarray, k: int, seed: int) -> np.ndarray:
    """(n, k) numbers in (0, 1) from the row ids: the same whatever the partitioning."""
    z = ids.astype(np.uint64)[:, None] * np.uint64(k + 1) + np.arange(1, k + 1, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(mult)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 1e-16


def dirichlet_mixture(points: DataFrame, k: int, concentration: float | None = None, kind: str = "diag", seed: int = 0,
                      tol: float = 1e-3, max_iter: int = 100) -> MixtureFit:
    """Truncated Dirichlet-process mixture by variational inference (Blei & Jordan 2006).

    Priors: stick concentration (1/k by default), unit mean precision around the data mean, and the data
    covariance as scale with d degrees of freedom. Unused components keep vanishing weight.
    """
    points = spread(points.select("id", "x"))
    alpha = 1.0 / k if concentration is None else concentration
    wide = "full" if kind == "full" else "diag"
    origin, rows = origin_of(points), packed(points)
    d = len(origin)
    _, n1, s1, q1 = _soft_sums(rows, origin, 1, wide, lambda X: np.zeros((len(X), 1)))
    m0, scale0 = _moments(n1, s1, q1)
    m0, scale0, total = m0[0], _shape(scale0, kind)[0], n1[0]
    trace, joint = [], lambda X, ids: np.log(_uniform(ids, k, seed))
    for i in range(max_iter + 1):
        ll, N, S, Q = _soft_sums(rows if i else points, origin, k, wide, joint, with_id=i == 0)
        if i > 0:
            trace.append(ll / total)
            if len(trace) > 1 and abs(trace[-1] - trace[-2]) < tol or i == max_iter:
                break
        mean, cov = _moments(N, S, Q)
        N = N + 1e-10
        a, b = 1 + N, alpha + np.concatenate([np.cumsum(N[::-1])[::-1][1:], [0]])
        both = digamma(a + b)
        log_pi = digamma(a) - both + np.concatenate([[0], np.cumsum(digamma(b) - both)[:-1]])
        beta = 1 + N
        m = (m0 + N[:, None] * mean) / beta[:, None]
        away = mean - m0
        if kind == "full":
            nu = d + N
            scatter = scale0 + N[:, None, None] * cov + (N / beta)[:, None, None] * away[:, :, None] * away[:, None, :]
            fitted = scatter / nu[:, None, None]
            log_prec = digamma((nu[:, None] - np.arange(d)) / 2).sum(1) + d * math.log(2) - d * np.log(nu)
        else:
            shape = (d + N) / 2
            rate = (scale0 + N[:, None] * np.maximum(cov, 0) + (N / beta)[:, None] * away**2) / 2
            if kind == "spherical":
                shape, rate = (d + N * d) / 2, np.repeat(rate.sum(1, keepdims=True), d, axis=1)
            fitted = rate / shape[:, None]
            log_prec = d * (digamma(shape) - np.log(shape))
        models = Gaussians(np.arange(1, k + 1), N, m + origin, fitted, np.exp(log_pi))
        models.factors()
        extra = log_pi + 0.5 * log_prec - 0.5 * d / beta
        joint = lambda X, models=models, extra=extra: models.log_density(X) + extra
    models.weight = N / N.sum()
    models.n = N
    return MixtureFit(models, trace[-1] * total, trace)


def factor_analysers(points: DataFrame, k: int, factors: int, seed: int = 0, tol: float = 1e-3, max_iter: int = 1000,
                     start: Gaussians | None = None) -> MixtureFit:
    """Mixture of factor analysers (Ghahramani & Hinton 1996): covariance = loadings x loadings' + diagonal noise."""
    points = spread(points.select("id", "x"))
    models = start or start_models(points, k, "full", seed)
    origin, d = origin_of(points), models.dim
    noise = np.stack([np.maximum(np.diag(c), FLOOR) for c in models.cov])
    load = np.empty((len(models), d, factors))
    for i, c in enumerate(models.cov):
        values, vectors = np.linalg.eigh(c)
        rest = values[: d - factors].mean() if d > factors else 0.0
        load[i] = vectors[:, ::-1][:, :factors] * np.sqrt(np.maximum(values[::-1][:factors] - rest, FLOOR))
        noise[i] = np.maximum(np.diag(c) - (load[i] ** 2).sum(1), FLOOR)
    models = Gaussians(models.ids, models.n, models.mu, load @ load.transpose(0, 2, 1) + np.stack([np.diag(p) for p in noise]), models.weight)
    trace, eye, rows = [], np.eye(factors), packed(points)
    for _ in range(max_iter):
        models.factors()
        logw = np.log(models.weight)
        ll, N, S, Q = _soft_sums(rows, origin, len(models), "full", lambda X: models.log_density(X) + logw)
        total = N.sum()
        trace.append(ll / total)
        if len(trace) > 1 and trace[-1] - trace[-2] < tol:
            break
        mean, cov = _moments(N, S, Q)
        for i in range(len(models)):
            if N[i] < 1e-8:
                continue
            beta = np.linalg.solve(models.cov[i], load[i]).T
            inner = eye - beta @ load[i] + beta @ cov[i] @ beta.T
            load[i] = np.linalg.solve(inner.T, (cov[i] @ beta.T).T).T
            noise[i] = np.maximum(np.diag(cov[i] - load[i] @ beta @ cov[i]), FLOOR)
        fitted = load @ load.transpose(0, 2, 1) + np.stack([np.diag(p) for p in noise])
        models = Gaussians(models.ids, N, mean + origin, fitted, np.maximum(N, 1e-300) / total)
    return MixtureFit(models, trace[-1] * total, trace)
