"""Linear-manifold clustering and manifold forms of clusters.

Candidates are spanned by sampled rows; the distances of all rows to all candidates are histogrammed in one
scan; the candidate whose histogram separates best gives a distance threshold (Haralick & Harpaz 2007;
threshold of Kittler & Illingworth 1986). Found clusters are kept as conditions; rows that are claimed, or left out by
a condition, are taken from the table that the next scans read, so scans grow shorter as clusters are peeled off.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulus.functions.vectors import matrix
from cumulus.operators.folds import fold, map_blocks, packed
from cumulus.operators.gaussians import Gaussians, cluster_models
from cumulus.operators.ordering import seeded_order
from cumulus.session import Rounds, check_state, spread


@dataclass
class Manifold:
    """mu + span(basis), basis (d, dim); rows within ``theta`` of it (and within ``extent`` inside it) belong."""

    mu: np.ndarray
    basis: np.ndarray
    theta: float = math.inf
    extent: float = math.inf
    separation: float = 0.0
    n: int = 0

    @property
    def dim(self):
        return self.basis.shape[1]

    def distance2(self, X):
        """Squared distance to the manifold."""
        Z = X - self.mu
        inside = Z @ self.basis
        return np.maximum((Z * Z).sum(1) - (inside * inside).sum(1), 0)

    def inside2(self, X):
        """Squared distance from the centre, measured within the manifold."""
        inside = (X - self.mu) @ self.basis
        return (inside * inside).sum(1)

    def holds(self, X):
        ok = self.distance2(X) <= self.theta**2
        if math.isfinite(self.extent):
            ok &= self.inside2(X) <= self.extent**2
        return ok


@dataclass
class ManifoldClustering:
    """Clusters 1..k as fitted manifolds. ``claims`` lists, in the order they were made, a cluster number
    (0 for noise) and the conditions its rows meet; a row belongs to the first claim it satisfies."""

    manifolds: list[Manifold] = field(default_factory=list)
    claims: list[tuple[int, list[Manifold]]] = field(default_factory=list)

    def locate(self, X) -> np.ndarray:
        """Cluster number per row, 0 for noise, -1 for rows nothing has claimed."""
        out = np.full(len(X), -1, np.int32)
        for c, conds in self.claims:
            left = np.flatnonzero(out == -1)
            if not len(left):
                break
            ok = np.ones(len(left), bool)
            for m in conds:
                ok &= m.holds(X[left])
            out[left[ok]] = c
        return out

    def assign(self, points: DataFrame, out: str = "cluster") -> DataFrame:
        def step(batch):
            return {out: pa.array(np.maximum(self.locate(matrix(batch.column("x"))), 0))}

        return map_blocks(points, step, f"`{out}` int", points.columns)

    def to_table(self, spark: SparkSession, run: str = "run") -> DataFrame:
        rows = [(run, i + 1, m.dim, m.mu.tolist(), m.basis.tolist(), float(m.theta), int(m.n)) for i, m in enumerate(self.manifolds)]
        return spark.createDataFrame(rows, "run_id string, comp int, dim int, mu array<double>, basis array<array<double>>, theta double, n bigint")


def separation(counts: np.ndarray, width: float) -> tuple[float, float]:
    """(threshold, goodness) of a distance histogram: minimum-error split, goodness = discriminability x depth."""
    n = counts.sum()
    if n < 2:
        return math.inf, 0.0
    x = (np.arange(len(counts)) + 0.5) * width
    p = counts / n
    P1, M1, S1 = np.cumsum(p), np.cumsum(p * x), np.cumsum(p * x * x)
    P2, M2, S2 = 1 - P1, M1[-1] - M1, S1[-1] - S1
    with np.errstate(divide="ignore", invalid="ignore"):
        m1, m2 = M1 / P1, M2 / P2
        v1, v2 = S1 / P1 - m1**2 + width**2 / 12, S2 / P2 - m2**2 + width**2 / 12
        J = 1 + P1 * np.log(v1) + P2 * np.log(v2) - 2 * (P1 * np.log(P1) + P2 * np.log(P2))
    ok = (P1 > 1e-9) & (P2 > 1e-9) & np.isfinite(J)
    if not ok.any():
        return math.inf, 0.0
    J = np.where(ok, J, np.inf)
    t = int(J.argmin())
    seen = np.flatnonzero(ok)
    left, right = J[seen[seen <= t]].max(), J[seen[seen >= t]].max()
    depth = min(left, right) - J[t]
    apart = abs(m1[t] - m2[t]) / math.sqrt(v1[t] + v2[t])
    return (t + 1) * width, float(apart * depth)


def _span(rows: np.ndarray) -> Manifold:
    mu = rows[0]
    if len(rows) == 1:
        return Manifold(mu, np.zeros((len(mu), 0)))
    q, r = np.linalg.qr((rows[1:] - mu).T)
    keep = np.abs(np.diag(r)) > 1e-12
    return Manifold(rows.mean(0), q[:, keep])


def sample_size(heuristic: int, factor: float, clusters: int, dim: int, rows: int, miss: float = 1e-2) -> int:
    """Candidates per dimension: 1 = chance that one sample falls in a single cluster, 2 = share of the rows, 3 = the smaller."""
    hit = (1 / max(clusters, 1)) ** dim
    by_chance = math.ceil(math.log(miss) / math.log(1 - hit)) if 0 < hit < 1 else 1
    by_share = math.ceil(factor * rows)
    return max(1, {1: by_chance, 2: by_share, 3: min(by_chance, by_share)}[heuristic])


def manifold_clusters(
    points: DataFrame, max_dim: int, clusters: int = 10, best_bound: float = 1.0, min_size: int = 20, heuristic: int = 3,
    factor: float = 0.01, candidates: int = 64, bins: int = 100, seed: int = 0, align: bool = True, bounded: bool = False,
    accept=None,
) -> ManifoldClustering:
    """Peel clusters off until fewer than ``min_size`` rows are left or nothing separates.

    The rows still free, and those inside the manifolds chosen so far, are written tables that replace one another.
    ``clusters`` is the expected number and only sets the sample size. ``candidates`` bounds the manifolds tried per
    scan; a larger sample takes more scans. ``accept`` may reject a fitted manifold given its models (see
    ``description_accepts``); its rows then count as noise.
    """
    out = ManifoldClustering()
    base = spread(points.select("id", "x"))
    d = base.select(F.size("x")).first()[0]
    max_dim = min(max_dim, d - 1)
    attempt = 0
    free, cuts, none = base, Rounds("free"), ManifoldClustering()
    while True:
        conds: list[Manifold] = []
        chosen = None
        if out.claims:  # the rows that the last claim left
            free = cuts.cut(_free(free, ManifoldClustering(claims=out.claims[-1:]), []))
        inside, held, rows_in = free, Rounds("inside"), packed(free)
        size = _count(rows_in, none, [])
        if size < min_size:
            break
        while True:
            left = sample_size(heuristic, factor, clusters, max_dim + 1, size)
            best, good = None, -math.inf
            while left:
                attempt += 1
                per_dim = min(left, max(1, candidates // (max_dim + 1)))
                left -= per_dim
                rows = _sample(inside, none, [], per_dim * (max_dim + 1), seed + attempt)
                tries = [_span(rows[i * (max_dim + 1) : i * (max_dim + 1) + m + 1]) for i in range(len(rows) // (max_dim + 1)) for m in range(max_dim + 1)]
                if not tries:
                    break
                one, score = _best_split(rows_in, none, [], tries, bins)
                if best is None or (score, -one.dim) > (good, -best.dim):
                    best, good = one, score
            if best is None or good < best_bound:
                break
            closer = _count(rows_in, none, [best])
            if not min_size <= closer < size:
                break
            chosen, size = best, closer
            conds = conds + [best]
            inside = held.cut(_free(inside, none, [best]))
            rows_in = packed(inside)
        fitted, size = _fit(inside, none, [], chosen.dim if chosen else max_dim, align or chosen is None, chosen)
        fitted.separation = chosen.separation if chosen else 0.0
        if bounded:
            fitted.extent = math.sqrt(_extreme(rows_in, none, [], fitted.inside2))
        if chosen is None:
            fitted.theta = math.sqrt(_extreme(rows_in, none, [], fitted.distance2))
        if accept is not None and not accept(inside, none, [], fitted):
            out.claims.append((0, conds))
            if not conds:
                break
            continue
        out.manifolds.append(fitted)
        out.claims.append((len(out.manifolds), conds))
        if not conds:  # nothing separates any more: the rest is one cluster
            break
    return out


def free_rows(X, found: ManifoldClustering, conds: list[Manifold]) -> np.ndarray:
    ok = found.locate(X) == -1
    for m in conds:
        ok &= m.holds(X)
    return ok


def _free(base, found, conds) -> DataFrame:
    """The rows (id, x) that nothing has claimed and that meet the conditions."""

    def step(batch):
        return {"_ok": pa.array(free_rows(matrix(batch.column("x")), found, conds))}

    return map_blocks(base, step, "_ok boolean", ["id", "x"]).filter("_ok").select("id", "x")


def _count(base, found, conds) -> int:
    return int(fold(base.select("x"), lambda b: np.array([free_rows(matrix(b.column("x")), found, conds).sum()]), (1,))[0])


def _extreme(base, found, conds, measure) -> float:
    def step(batch):
        X = matrix(batch.column("x"))
        X = X[free_rows(X, found, conds)]
        return np.array([measure(X).max() if len(X) else -np.inf])

    return max(float(fold(base.select("x"), step, (1,), "max")[0]), 0.0)


def _sample(base, found, conds, count, seed) -> np.ndarray:
    free = _free(base, found, conds) if found.claims or conds else base
    rows = free.orderBy(seeded_order(seed, "id"), "id").limit(count).select("x").toArrow().column(0)
    return matrix(rows)


def _best_split(base, found, conds, tries, bins):
    check_state(len(tries) * bins, "distance histograms")

    def distances(batch):
        X = matrix(batch.column("x"))
        X = X[free_rows(X, found, conds)]
        return np.stack([np.sqrt(m.distance2(X)) for m in tries], 1) if len(X) else np.empty((0, len(tries)))

    top = fold(base.select("x"), lambda b: np.max(distances(b), axis=0, initial=0.0), (len(tries),), "max")
    width = np.maximum(top, 1e-300) / bins

    def step(batch):
        at = np.minimum((distances(batch) / width).astype(int), bins - 1)
        return np.stack([np.bincount(at[:, i], minlength=bins) for i in range(len(tries))])

    counts = fold(base.select("x"), step, (len(tries), bins))
    scored = [separation(c, w) for c, w in zip(counts, width)]
    i = max(range(len(tries)), key=lambda i: (scored[i][1], -tries[i].dim))
    best = tries[i]
    best.theta, best.separation = scored[i]
    return best, scored[i][1]


def _fit(base, found, conds, dim, align, chosen):
    def step(batch):
        return {"_in": pa.array(free_rows(matrix(batch.column("x")), found, conds).astype(np.int32))}

    inside = map_blocks(base, step, "_in int", ["x"])
    model = cluster_models(inside, "_in", ids=np.array([1]))
    n = int(model.n[0])
    if align or chosen is None:
        values, vectors = np.linalg.eigh(model.cov[0])
        fitted = Manifold(model.mu[0], vectors[:, ::-1][:, :dim], chosen.theta if chosen else math.inf)
    else:
        fitted = Manifold(chosen.mu, chosen.basis, chosen.theta)
    fitted.n = n
    return fitted, n


def in_manifold_reach(assigned: DataFrame, clustering: ManifoldClustering, label: str = "cluster") -> np.ndarray:
    """Largest in-manifold distance of the rows of every cluster."""
    k = len(clustering.manifolds)

    def step(batch):
        X, y = matrix(batch.column("x")), batch.column("y").to_numpy()
        out = np.full(k, -np.inf)
        for i, m in enumerate(clustering.manifolds):
            mine = y == i + 1
            if mine.any():
                out[i] = m.inside2(X[mine]).max()
        return out

    return np.sqrt(np.maximum(fold(assigned.select("x", F.col(label).alias("y")), step, (k,), "max"), 0))


def split_defective(points: DataFrame, clustering: ManifoldClustering, threshold: float = 1.1, min_size: int = 20, max_dim: int = 1, **opts) -> DataFrame:
    """(points, cluster): clusters that reach further than ``threshold`` inside their manifold, or that were
    never separated, are pooled and clustered again with half the minimum size."""
    assigned = clustering.assign(points)
    reach = in_manifold_reach(assigned, clustering)
    bad = [i + 1 for i, m in enumerate(clustering.manifolds) if reach[i] > threshold or m.separation == 0.0]
    if not bad:
        return assigned
    good = [i + 1 for i in range(len(clustering.manifolds)) if i + 1 not in bad]
    pooled = assigned.filter(F.col("cluster").isin(bad))
    again = manifold_clusters(pooled, max_dim, min_size=max(1, min_size >> 1), **opts)
    renumber = F.create_map(*[F.lit(v) for pair in [(0, 0), *((g, i + 1) for i, g in enumerate(good))] for v in pair])
    kept = assigned.filter(~F.col("cluster").isin(bad)).withColumn("cluster", renumber[F.col("cluster")])
    fixed = again.assign(pooled.drop("cluster"))
    fixed = fixed.withColumn("cluster", F.when(F.col("cluster") > 0, F.col("cluster") + len(good)).otherwise(0))
    return kept.unionByName(fixed)


@dataclass
class ManifoldForms:
    """Clusters as centre plus all principal axes, largest spread first; ``dims`` is each one's own dimension."""

    ids: np.ndarray
    n: np.ndarray
    mu: np.ndarray
    axes: np.ndarray
    dims: np.ndarray


def manifold_forms(points: DataFrame, label: str, max_dim: int) -> ManifoldForms:
    """A clustering in manifold form: per-cluster mean and eigenvectors, dimension at most ``max_dim``."""
    return forms_of(cluster_models(points, label), max_dim)


def forms_of(models: Gaussians, max_dim: int) -> ManifoldForms:
    axes = np.stack([np.linalg.eigh(c)[1][:, ::-1] for c in models.cov])
    return ManifoldForms(models.ids, models.n, models.mu, axes, np.full(len(models), min(max_dim, models.dim), int))
