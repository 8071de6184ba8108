"""Agglomeration of model clusters, level scores and level choice.

Merging works on the component table (k models, k x k costs); whatever needs the rows is one scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cumulus.functions.vectors import matrix
from cumulus.operators.agreement import mutual_information
from cumulus.operators.classify import meta_log_density, meta_predict
from cumulus.operators.folds import fold
from cumulus.operators.forest import minimum_forest
from cumulus.operators.gaussians import Gaussians, assign_models
from cumulus.session import check_state

Merge = tuple[int, int, float]  # smallest component ids of the two clusters, cost


def levels_of(ids: list[int], merges: list[Merge]) -> list[list[list[int]]]:
    """Clusters after 0, 1, ... merges, as component lists ordered by their first component."""
    check_state(len(ids) * (len(merges) + 1), "levels")
    owner = {int(i): [int(i)] for i in ids}
    out = [[owner[k] for k in sorted(owner)]]
    for a, b, _ in merges:
        a, b = min(a, b), max(a, b)
        owner = dict(owner)
        owner[a] = sorted(owner[a] + owner.pop(b))
        out.append([owner[k] for k in sorted(owner)])
    return out


def meta_table(spark: SparkSession, levels: list[list[list[int]]], run: str = "run") -> DataFrame:
    """(run_id, level, cluster, comp), clusters from 1."""
    rows = [(run, l, c + 1, comp) for l, level in enumerate(levels) for c, members in enumerate(level) for comp in members]
    return spark.createDataFrame(rows, "run_id string, level int, cluster int, comp int")


def merge_table(spark: SparkSession, merges: list[Merge], run: str = "run") -> DataFrame:
    rows = [(run, i + 1, int(a), int(b), float(c)) for i, (a, b, c) in enumerate(merges)]
    return spark.createDataFrame(rows, "run_id string, step int, a int, b int, cost double")


def merge_trees(edges: DataFrame) -> DataFrame:
    """(run_id, step, a, b, cost): every run's merges in filtration order, from its (run_id, a, b, w, ord) edges.

    The minimum spanning forest is found by joins. What is left of a run is one edge less than it has models, a state
    of checked size, so each run's tree is one small task and runs are handled side by side.
    """

    def unite(tree: pa.Table) -> pa.Table:
        check_state(tree.num_rows * 4, "merge tree")
        root: dict[int, int] = {}

        def find(v):
            while v in root:
                root[v] = v = root.get(root[v], root[v])
            return v

        ends = []
        tree = tree.sort_by("ord")
        for a, b in zip(tree.column("a").to_pylist(), tree.column("b").to_pylist()):
            a, b = sorted((find(a), find(b)))
            root[b] = a
            ends.append((a, b))
        low, high = zip(*ends)
        steps = pa.array(range(1, len(ends) + 1), pa.int32())
        return pa.table({"run_id": tree.column("run_id"), "step": steps, "a": pa.array(low, pa.int32()), "b": pa.array(high, pa.int32()), "cost": tree.column("w")})

    forest = minimum_forest(edges).select("run_id", "ord", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "w")
    return forest.groupBy("run_id").applyInArrow(unite, "run_id string, step int, a int, b int, cost double")


def topological_merges(edges: DataFrame) -> list[Merge]:
    """The merges of one run's edges, see :func:`merge_trees`."""
    return [(r["a"], r["b"], r["cost"]) for r in merge_trees(edges).orderBy("step").collect()]


def _greedy(ids: list[int], cost: np.ndarray, recost: Callable[[int, int, list[int]], np.ndarray]) -> list[Merge]:
    """Merge the cheapest pair until one cluster is left; ``recost(a, b, live)`` gives the new row."""
    live, cost, out = list(range(len(ids))), cost.copy(), []
    cost[np.tril_indices(len(ids))] = np.inf
    while len(live) > 1:
        sub = cost[np.ix_(live, live)]
        i, j = divmod(int(sub.argmin()), len(live))
        a, b = live[i], live[j]
        out.append((int(ids[a]), int(ids[b]), float(sub[i, j])))
        live.pop(j)
        others = [c for c in live if c != a]
        for c, v in zip(others, recost(a, b, others)):
            cost[min(a, c), max(a, c)] = v
    return out


def description_merges(models: Gaussians, beta: float = 2.0, beta_size: float = 1.0) -> list[Merge]:
    """Greedy merging by description length of single Gaussians.

    A cluster of n rows costs beta x its negative log-likelihood, beta_size x the code of its label and
    half a log n per free parameter; the cost of a merge is the change. Everything follows from the moments.
    """
    full = models.cov if models.cov.ndim == 3 else np.stack([np.diag(c) for c in models.cov])
    n, mu, cov = models.n.astype(float).copy(), models.mu.copy(), full.copy()
    d, total = models.dim, max(models.n.sum(), 1)
    free = d + d * (d + 1) / 2

    def length(m, c):
        sign, log = np.linalg.slogdet(c)
        if sign <= 0 or not np.isfinite(log):
            sign, log = np.linalg.slogdet(c + 1e-5 * np.eye(d))
        nll = m / 2 * (log + d * (1 + math.log(2 * math.pi)))
        return beta * nll - beta_size * m * math.log(max(m, 1) / total) + free / 2 * math.log(max(m, 1))

    def joined(a, b):
        m = n[a] + n[b]
        centre = (n[a] * mu[a] + n[b] * mu[b]) / m
        da, db = mu[a] - centre, mu[b] - centre
        return m, centre, (n[a] * (cov[a] + np.outer(da, da)) + n[b] * (cov[b] + np.outer(db, db))) / m

    k = len(models)
    own = np.array([length(n[i], cov[i]) for i in range(k)])

    def change(a, b):
        m, _, c = joined(a, b)
        return length(m, c) - own[a] - own[b]

    def recost(a, b, others):
        n[a], mu[a], cov[a] = joined(a, b)
        own[a] = length(n[a], cov[a])
        return np.array([change(a, c) for c in others])

    cost = np.full((k, k), np.inf)
    for i in range(k):
        for j in range(i + 1, k):
            cost[i, j] = change(i, j)
    return _greedy(models.ids.tolist(), cost, recost)


def bottleneck_merges(points: DataFrame, models: Gaussians, beta: float = 2.0, hard: bool = False) -> list[Merge]:
    """Information-bottleneck merging (Slonim & Tishby 1999): cost (p_i + p_j) JS(p(.|i), p(.|j)).

    ``beta`` sharpens the responsibilities (they are raised to it and normalised); ``hard`` makes them 0/1.
    The first scan gives all pairs, each merge one scan for the pairs of the new cluster.
    """
    k = len(models)
    check_state(k * k, "merge costs")
    models.factors()
    logw = np.log(np.maximum(models.weight, 1e-300))

    def shares(X, groups):
        joint = beta * (models.log_density(X) + logw)
        if hard:
            R = (joint == joint.max(1, keepdims=True)).astype(float)
        else:
            R = np.exp(joint - joint.max(1, keepdims=True))
        R /= R.sum(1, keepdims=True)
        return np.stack([R[:, g].sum(1) for g in groups], 1)

    xlogx = lambda a: np.where(a > 0, a * np.log(np.where(a > 0, a, 1)), 0)

    def first(batch):
        R = shares(matrix(batch.column("x")), [[i] for i in range(k)])
        out = np.zeros((k + 1, k))
        out[k] = R.sum(0)
        for i in range(k):
            out[i] = xlogx(R[:, i : i + 1] + R).sum(0)
            out[i, i] = xlogx(R[:, i]).sum()
        return out

    s = fold(points.select("x"), first, (k + 1, k))
    mass, own, both = s[k].copy(), np.diag(s[:k]).copy(), s[:k]
    total = mass.sum()

    def price(a, c, joint):
        pa, pc = mass[a], mass[c]
        return (own[a] + own[c] - joint + xlogx(pa + pc) - xlogx(pa) - xlogx(pc)) / total

    groups = [[i] for i in range(k)]
    cost = np.full((k, k), np.inf)
    for i in range(k):
        for j in range(i + 1, k):
            cost[i, j] = price(i, j, both[i, j])

    def recost(a, b, others):
        groups[a] = groups[a] + groups[b]
        mass[a] += mass[b]
        if not others:
            return np.empty(0)
        picked = [groups[a]] + [groups[c] for c in others]

        def step(batch):
            R = shares(matrix(batch.column("x")), picked)
            return np.concatenate([[xlogx(R[:, 0]).sum()], xlogx(R[:, :1] + R[:, 1:]).sum(0)])

        v = fold(points.select("x"), step, (1 + len(others),))
        own[a] = v[0]
        return np.array([price(a, c, j) for c, j in zip(others, v[1:])])

    return _greedy(models.ids.tolist(), cost, recost)


def multinomial_complexity(k: int, n: float) -> float:
    """log of the multinomial normaliser by the linear recurrence of Kontkanen & Myllymaki (2007)."""
    if k <= 1 or n < 1:
        return 0.0
    if n <= 1000:
        h = np.arange(0, int(n) + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in h])
            logs += np.where(h > 0, h * np.log(np.maximum(h, 1) / n), 0) + np.where(h < n, (n - h) * np.log(np.maximum(n - h, 1) / n), 0)
        second = float(np.exp(logs).sum())
    else:  # Szpankowski's expansion of the two-value case
        second = math.sqrt(n * math.pi / 2) + 2 / 3 + math.sqrt(2 * math.pi / n) / 24
    before, now = 1.0, second
    for j in range(3, k + 1):
        before, now = now, now + n / (j - 2) * before
    return math.log(now)


def level_scores(points: DataFrame, models: Gaussians, levels: list[list[list[int]]], run: str = "run") -> DataFrame:
    """(run_id, level, clusters, score, nll, complexity) of every level, from one scan.

    Each row counts with its likeliest cluster's mixture density. Complexity: half a log of the cluster size
    per free parameter, plus the multinomial term of the cluster sizes.
    """
    k = len(models)
    check_state(len(levels) * (k + 1), "level sums")
    densities = [meta_log_density(models, level) for level in levels]

    def step(batch):
        X = matrix(batch.column("x"))
        comp = models.log_density(X)
        out = np.zeros((len(levels), k + 1))
        for l, density in enumerate(densities):
            D = density(X, comp)
            at = D.argmax(1)
            out[l, 0] = D[np.arange(len(X)), at].sum()
            out[l, 1 : 1 + D.shape[1]] = np.bincount(at, minlength=D.shape[1])
        return out

    s = fold(points.select("x"), step, (len(levels), k + 1))
    d = models.dim
    per_model = d + (d if models.cov.ndim == 2 else d * (d + 1) / 2)
    rows = []
    for l, level in enumerate(levels):
        sizes = s[l, 1 : 1 + len(level)]
        free = [len(m) * per_model + len(m) - 1 for m in level]
        comp = sum(f / 2 * math.log(max(z, 1)) for f, z in zip(free, sizes)) + multinomial_complexity(len(level), sizes.sum())
        rows.append((run, l, len(level), float(-s[l, 0] + comp), float(-s[l, 0]), float(comp)))
    return points.sparkSession.createDataFrame(rows, "run_id string, level int, clusters int, score double, nll double, complexity double")


def choose_level(scores: DataFrame, floor: bool = False, tol: float = 1e-3) -> DataFrame:
    """(run_id, level): the later of the last global minimum within ``tol`` and the last strict local minimum
    of lowest score, after the two ends are raised to the maximum (or, with ``floor``, scores rounded down).

    One run has as many rows as it has models, so a window per run is bounded.
    """
    by = Window.partitionBy("run_id")
    along = by.orderBy("level")
    if floor:
        flat = scores.withColumn("s", F.floor("score").cast("double"))
    else:
        end = (F.col("level") == F.min("level").over(by)) | (F.col("level") == F.max("level").over(by))
        flat = scores.withColumn("s", F.when(end, F.max("score").over(by)).otherwise(F.col("score")))
    low = flat.withColumn("lowest", F.min("s").over(by)).withColumn(
        "dip", (F.col("s") < F.lag("s").over(along)) & (F.col("s") < F.lead("s").over(along))
    )
    picks = low.groupBy("run_id").agg(
        F.max(F.when(F.col("s") <= F.col("lowest") + tol, F.col("level"))).alias("g"),
        F.max_by(F.when(F.col("dip"), F.col("level")), F.when(F.col("dip"), F.struct(-F.col("s"), F.col("level")))).alias("l"),
    )
    return picks.select("run_id", F.greatest("g", "l").alias("level"))


def cut_level(assignments: DataFrame, meta: DataFrame, level: int) -> DataFrame:
    """(id, cluster) of one level of a stored tree, without refitting."""
    members = meta.filter(F.col("level") == level).select("comp", "cluster")
    return assignments.join(members, "comp").select("id", "cluster")


def level_agreement(assigned: DataFrame, label: str, meta: DataFrame) -> DataFrame:
    """(run_id, level, mi, nmi) for all levels: rows are counted per (label, component) once."""
    counts = assigned.groupBy(label, "comp").agg(F.count("*").alias("n"))
    return mutual_information(counts.join(meta, "comp"), label, "cluster", ["run_id", "level"], weight="n")


def best_level(agreement: DataFrame) -> DataFrame:
    """(run_id, level, nmi): the level that agrees best, the first of equals."""
    return agreement.groupBy("run_id").agg(F.max_by(F.struct("level", "nmi"), F.struct(F.col("nmi"), -F.col("level"))).alias("b")).select("run_id", "b.level", "b.nmi")


def merges_by(rule: str, points: DataFrame, models: Gaussians, edges: DataFrame | None, beta: float = 2.0, beta_size: float = 1.0, hard: bool = False) -> list[Merge]:
    if rule == "topological":
        return topological_merges(edges)
    if rule == "description":
        return description_merges(models, beta, beta_size)
    if rule == "bottleneck":
        return bottleneck_merges(points, models, beta, hard)
    raise ValueError(f"unknown merging rule {rule}")


def metacluster(points: DataFrame, cover, rule: str = "topological", label: str | None = "label", run: str = "run", scorer=level_scores, chooser=choose_level, **opts) -> dict:
    """Cover, merge, score, choose: the whole flow.

    ``cover`` is a fitted cover (see ``covers``). Returns models, levels, merges, the score table, the
    chosen level, the agreement per level, the best level, and ``assigned`` (rows with component and cluster).
    """
    spark = points.sparkSession
    merges = merges_by(rule, points, cover.models, cover.edges, **opts)
    levels = levels_of(cover.models.ids.tolist(), merges)
    scores = scorer(points, cover.models, levels, run)
    level = chooser(scores).first()["level"]
    meta = meta_table(spark, levels, run)
    assigned = assign_models(points, cover.models, keep=[label] if label else [])
    agreement = level_agreement(assigned, label, meta) if label else None
    best = best_level(agreement).first()["level"] if label else None
    clusters = meta_predict(points, cover.models, levels[level], prior=False, out="cluster")
    return {"models": cover.models, "levels": levels, "merges": merges, "scores": scores, "level": level, "meta": meta,
            "agreement": agreement, "best_level": best, "assigned": clusters}
