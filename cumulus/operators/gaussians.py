"""Gaussian models of clusters: moments, densities, assignment, pruning.

The model table is small (k components of dimension d, checked); the points are only ever scanned.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulus.functions.vectors import matrix
from cumulus.operators.folds import by_code, fold, fold_groups, map_blocks
from cumulus.session import check_state, materialise

LOG_2PI = float(np.log(2 * np.pi))
JITTER = 1e-5  # added to the diagonal of a covariance that is not positive definite
MODEL_SCHEMA = "run_id string, comp int, n bigint, weight double, mu array<double>, cov array<array<double>>"


@dataclass
class Gaussians:
    """k Gaussians: full covariances (k, d, d) or diagonal ones (k, d)."""

    ids: np.ndarray
    n: np.ndarray
    mu: np.ndarray
    cov: np.ndarray
    weight: np.ndarray | None = None
    _cache: tuple | None = field(default=None, repr=False)

    def __post_init__(self):
        check_state(self.cov.size, "Gaussian models")
        if self.weight is None:
            self.weight = self.n / max(self.n.sum(), 1)

    def __len__(self):
        return len(self.ids)

    @property
    def dim(self):
        return self.mu.shape[1]

    def take(self, keep) -> "Gaussians":
        return Gaussians(self.ids[keep], self.n[keep], self.mu[keep], self.cov[keep], self.weight[keep])

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        """Whitening factors and log determinants, with jitter where needed."""
        if self._cache is None:
            if self.cov.ndim == 2:
                var = np.where(self.cov > 0, self.cov, self.cov + JITTER)
                self._cache = (1 / np.sqrt(var), np.log(var).sum(1))
            else:
                roots, logs = [], []
                for c in self.cov:
                    try:
                        low = np.linalg.cholesky(c)
                    except np.linalg.LinAlgError:
                        low = _repaired_root(c)
                    roots.append(np.linalg.inv(low))
                    logs.append(2 * np.log(np.diag(low)).sum())
                self._cache = (np.array(roots).reshape(self.cov.shape), np.array(logs))
        return self._cache

    def mahalanobis2(self, X: np.ndarray) -> np.ndarray:
        root, _ = self.factors()
        out = np.empty((len(X), len(self)))
        for i in range(len(self)):
            z = X - self.mu[i]
            z = z * root[i] if self.cov.ndim == 2 else z @ root[i].T
            out[:, i] = np.einsum("ij,ij->i", z, z)
        return out

    def log_density(self, X: np.ndarray) -> np.ndarray:
        return -0.5 * (self.dim * LOG_2PI + self.factors()[1] + self.mahalanobis2(X))

    def entropy(self) -> np.ndarray:
        """(log det + d log 2 pi + 1) / 2; Inf where the determinant is not positive."""
        if self.cov.ndim == 2:
            det = np.prod(np.sign(self.cov), axis=1)
            logs = np.log(np.where(self.cov > 0, self.cov, 1)).sum(1)
        else:
            det, logs = np.linalg.slogdet(self.cov)
        return np.where((det > 0) & np.isfinite(logs), (logs + self.dim * LOG_2PI + 1) / 2, np.inf)

    def to_table(self, spark: SparkSession, run: str = "run") -> DataFrame:
        full = self.cov if self.cov.ndim == 3 else np.array([np.diag(c) for c in self.cov])
        rows = [
            (run, int(i), int(n), float(w), m.tolist(), c.tolist())
            for i, n, w, m, c in zip(self.ids, self.n, self.weight, self.mu, full)
        ]
        return spark.createDataFrame(rows, MODEL_SCHEMA)

    @staticmethod
    def from_table(models: DataFrame) -> "Gaussians":
        size = models.agg(F.sum(F.size("mu") * F.size("mu"))).first()[0]
        check_state(size or 0, "stored models")
        rows = models.orderBy("comp").collect()
        pick = lambda c: np.array([r[c] for r in rows], float)
        return Gaussians(pick("comp").astype(int), pick("n").astype(int), pick("mu"), pick("cov"), pick("weight"))


def _repaired_root(c: np.ndarray) -> np.ndarray:
    jitter = JITTER
    eye = np.eye(len(c))
    while True:
        try:
            return np.linalg.cholesky(c + jitter * eye)
        except np.linalg.LinAlgError:
            jitter *= 10


def origin_of(points: DataFrame) -> np.ndarray:
    """A point inside the cloud, subtracted before products are summed so that sums keep their digits."""
    return np.array([r[0] for r in points.select("x").take(64)], float).mean(0)


def cluster_models(points: DataFrame, label: str, kind: str = "full", ids: np.ndarray | None = None) -> Gaussians:
    """Mean and maximum-likelihood covariance of every cluster, in one pass over the points; rows without a label are left out."""
    origin = origin_of(points)
    d = len(origin)
    width = 1 + d + (d * d if kind == "full" else d)

    def step(batch, codes, n):
        X = matrix(batch.column("x")) - origin
        out = np.zeros((n, width))
        for i, own in enumerate(by_code(codes, n)):
            Z = X[own]
            second = Z.T @ Z if kind == "full" else (Z * Z).sum(0)
            out[i] = np.concatenate([[len(Z)], Z.sum(0), second.ravel()])
        return out

    labelled = points.select("x", F.col(label).alias("y")).filter("y is not null")
    found, s = fold_groups(labelled, "y", step, width)
    if ids is not None:
        known = {v: i for i, v in enumerate(found.tolist())}
        s = np.array([s[known[v]] if v in known else np.zeros(width) for v in np.asarray(ids).tolist()]).reshape(len(ids), width)
    else:
        ids = found
    k = len(ids)
    n = s[:, 0]
    safe = np.maximum(n, 1)[:, None]
    mean = s[:, 1 : 1 + d] / safe
    if kind == "full":
        cov = s[:, 1 + d :].reshape(k, d, d) / safe[:, :, None] - mean[:, :, None] * mean[:, None, :]
    else:
        cov = np.maximum(s[:, 1 + d :] / safe - mean * mean, 0)
        if kind == "spherical":
            cov = np.repeat(cov.mean(1, keepdims=True), d, axis=1)
    return Gaussians(np.asarray(ids), n.astype(np.int64), mean + origin, cov)


def assign_models(points: DataFrame, models: Gaussians | list[Gaussians], prior: bool = False, out: str = "comp", keep: list[str] | None = None) -> DataFrame:
    """Every row (its ``keep`` columns, all by default) with the component of highest (prior +) log density; ties go to the smallest id.

    One narrow pass with the models in the task. Models beyond the state bound come as a list of
    slices: the running best is carried from slice to slice through the shared folder.
    """
    if isinstance(models, Gaussians):
        return _assign_slice(points, models, prior, out, None, points.columns if keep is None else keep)
    result, best = points, None
    for piece in models:
        last = piece is models[-1]
        carried = [c for c in points.columns if c == "x" and not last or keep is None or c in keep]
        result = _assign_slice(result, piece, prior, out, best, carried)
        best = (out, f"{out}_score")
        if not last:
            result = materialise(result, "assign")
    return result


def _assign_slice(points, models, prior, out, best, keep):
    ids = models.ids.astype(np.int32)
    models.factors()
    base = np.log(models.weight) if prior else np.zeros(len(models))

    def step(batch):
        score = models.log_density(matrix(batch.column("x"))) + base
        at = score.argmax(1)
        top, comp = score[np.arange(len(at)), at], ids[at]
        if best:
            old = batch.column(best[1]).to_numpy()
            keep = old >= top
            top = np.where(keep, old, top)
            comp = np.where(keep, batch.column(best[0]).to_numpy(), comp).astype(np.int32)
        return {out: pa.array(comp), f"{out}_score": pa.array(top)}

    return map_blocks(points, step, f"`{out}` int, `{out}_score` double", [c for c in keep if not best or c not in best], ("x", *(best or ())))


def assignment_sizes(points: DataFrame, models: Gaussians) -> np.ndarray:
    """Points per component after assignment."""

    def step(batch):
        return np.bincount(models.log_density(matrix(batch.column("x"))).argmax(1), minlength=len(models))

    models.factors()
    return fold(points.select("x"), step, (len(models),)).astype(np.int64)


def prune_models(points: DataFrame, models: Gaussians, min_size: int = 1) -> Gaussians:
    """Drop components that win fewer than ``min_size`` points."""
    sizes = assignment_sizes(points, models)
    kept = models.take(sizes >= min_size)
    kept.n = sizes[sizes >= min_size]
    kept.weight = kept.n / max(kept.n.sum(), 1)
    return kept


def construct_models(points: DataFrame, label: str, min_size: int = 1, kind: str = "full") -> Gaussians:
    """Models of the clusters with more than ``min_size`` points and finite entropy, sized by reassignment."""
    fitted = cluster_models(points, label, kind)
    kept = fitted.take((fitted.n > min_size) & np.isfinite(fitted.entropy()))
    if not len(kept):
        raise ValueError("no cluster has a usable covariance; use kind='diag' or a larger min_size")
    kept.n = assignment_sizes(points, kept)
    kept.weight = kept.n / max(kept.n.sum(), 1)
    return kept


def reassign_outliers(points: DataFrame, label: str, models: Gaussians) -> DataFrame:
    """Rows without a cluster take the nearest model; the others keep theirs."""
    near = assign_models(points, models, out="_near")
    return near.withColumn(label, F.coalesce(F.col(label), F.col("_near"))).drop("_near", "_near_score")
