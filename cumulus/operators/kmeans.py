"""k-means: many fits share every scan of the data."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulus.functions.vectors import matrix, square_distances
from cumulus.operators.agreement import mutual_information
from cumulus.operators.folds import fold, fold_keys, map_blocks, packed
from cumulus.operators.neighbors import knn_join
from cumulus.operators.ordering import number_rows, seeded_order, seeded_pick
from cumulus.session import Rounds, check_state, spread


@dataclass
class KMeansFit:
    run_id: str
    centers: np.ndarray
    cost: float = np.inf
    sizes: np.ndarray | None = None
    rounds: int = 0

    @property
    def k(self):
        return len(self.centers)


def random_centers(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """k distinct rows in the seeded order."""
    check_state(k * 64, "seeds")
    rows = seeded_pick(points, k, seed).collect()
    if len(rows) < k:
        raise ValueError(f"{k} centres asked for, {len(rows)} rows given")
    return np.array([r["x"] for r in rows], float)


def lloyd(points: DataFrame, fits: list[KMeansFit], rounds: int = 100, tol: float = 1e-6) -> list[KMeansFit]:
    """Lloyd rounds for all fits at once: one scan per round, partial sums per partition.

    A fit stops when its cost falls by no more than ``tol`` of itself; cost and sizes belong to the
    returned centres. A centre without points stays where it is. Fits whose centres have fewer axes than the points
    use the leading ones.
    """
    active = list(fits)
    rows = packed(points) if rounds > 2 else points.select("x")
    for done in range(rounds + 1):
        centers = [f.centers for f in active]
        sizes = [(len(c), c.shape[1]) for c in centers]
        state = sum(k * (d + 1) + 1 for k, d in sizes)
        check_state(state, "k-means sums")

        def step(batch, centers=centers):
            rows = matrix(batch.column("x"))
            parts = []
            for c in centers:
                X = rows[:, : c.shape[1]]
                D = square_distances(X, c)
                near = D.argmin(1)
                hot = np.zeros((len(c), len(X)))
                hot[near, np.arange(len(X))] = 1
                parts += [hot.sum(1), (hot @ X).ravel(), [D[np.arange(len(X)), near].sum()]]
            return np.concatenate(parts)

        flat = fold(rows, step, (state,))
        at, still = 0, []
        for f, (k, d) in zip(active, sizes):
            n, s, cost = flat[at : at + k], flat[at + k : at + k * (d + 1)].reshape(k, d), flat[at + k * (d + 1)]
            at += k * (d + 1) + 1
            moved = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], f.centers)
            settled = f.cost - cost <= tol * cost
            f.cost, f.sizes, f.rounds = float(f"{cost:.12g}"), n.astype(np.int64), done  # partial sums meet in any order: their last digits tell nothing
            if not settled and done < rounds and not np.array_equal(moved, f.centers):
                f.centers = moved
                still.append(f)
        active = still
        if not active:
            break
    return fits


def kmeans(points: DataFrame, k: int, seed: int = 0, rounds: int = 100, tol: float = 1e-6) -> KMeansFit:
    return lloyd(points, [KMeansFit("kmeans", random_centers(points, k, seed))], rounds, tol)[0]


def kmeans_grid(points: DataFrame, ks: list[int], seeds: list[int], rounds: int = 100, tol: float = 1e-6) -> list[KMeansFit]:
    """A fit for every k and seed; the fits of one seed start from the same seeded order."""
    fits, points = [], spread(points.select("id", "x"))
    for s in seeds:
        start = random_centers(points, max(ks), s)
        fits += [KMeansFit(f"k{k}-s{s}", start[:k].copy()) for k in ks]
    return lloyd(points, fits, rounds, tol)


def best_of_restarts(points: DataFrame, k: int, restarts: int = 1, seed: int = 0, keep: str = "best", **opts) -> KMeansFit:
    """Lowest cost over restarts; ``keep="worst"`` keeps the highest instead."""
    fits = kmeans_grid(points, [k], [seed + i for i in range(restarts)], **opts)
    return (min if keep == "best" else max)(fits, key=lambda f: f.cost)


def best_over_k(points: DataFrame, classes: int, restarts: int = 1, seed: int = 0, **opts) -> KMeansFit:
    """Lowest cost over k = 2 .. 4 x classes and restarts. Cost falls with k, so this favours the largest k."""
    fits = kmeans_grid(points, list(range(2, 4 * classes + 1)), [seed + i for i in range(restarts)], **opts)
    return min(fits, key=lambda f: f.cost)


def assign_fits(points: DataFrame, fits: list[KMeansFit], keep: list[str]) -> DataFrame:
    """(keep, run_id, cluster): the clusters of all fits from one scan."""
    names = [f.run_id for f in fits]
    centers = [f.centers for f in fits]

    def step(batch):
        X = matrix(batch.column("x"))
        labels = np.stack([square_distances(X[:, : c.shape[1]], c).argmin(1) for c in centers], 1).astype(np.int32) + 1
        offsets = pa.array(np.arange(0, labels.size + 1, labels.shape[1], dtype=np.int32))
        return {"_labels": pa.ListArray.from_arrays(offsets, pa.array(labels.ravel()))}

    wide = map_blocks(points, step, "_labels array<int>", keep)
    long = wide.select(*keep, F.posexplode("_labels").alias("_f", "cluster"))
    return long.select(*keep, F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_f") + 1).alias("run_id"), "cluster")


def best_by_agreement(points: DataFrame, label: str, fits: list[KMeansFit]) -> KMeansFit:
    """The fit whose clusters agree best with the labels."""
    scores = mutual_information(assign_fits(points, fits, [label]), label, "cluster", ["run_id"]).collect()
    nmi = {r["run_id"]: r["nmi"] for r in scores}
    return max(fits, key=lambda f: nmi[f.run_id])


def assign_centers(points: DataFrame, fit: KMeansFit, out: str = "cluster", keep: list[str] | None = None) -> DataFrame:
    """1-based cluster and squared distance of every row (its ``keep`` columns, all by default)."""
    centers = fit.centers

    def step(batch):
        D = square_distances(matrix(batch.column("x"))[:, : centers.shape[1]], centers)
        at = D.argmin(1)
        return {out: pa.array(at.astype(np.int32) + 1), "dist2": pa.array(D[np.arange(len(at)), at])}

    return map_blocks(points, step, f"`{out}` int, dist2 double", points.columns if keep is None else keep)


def _sums(batch, codes, n):
    """Number and sum of the vectors of each code."""
    X = matrix(batch.column("x"))
    order = np.argsort(codes, kind="stable")
    starts = np.searchsorted(codes[order], np.arange(n))
    return np.column_stack([np.bincount(codes, minlength=n), np.add.reduceat(X[order], starts, axis=0)])


def kmeans_share(points: DataFrame, share: float, seed: int = 0, rounds: int = 20) -> DataFrame:
    """(id, cluster, dist): k-means with k a share of the rows, after ``rounds`` Lloyd rounds.

    Such a k grows with the data, so the centres are a table: rows find theirs by the nearest-neighbour
    join, and the means are grouped sums. Nothing of size k is collected or broadcast by hand.
    """
    base = points.select("id", "x")
    k = max(1, round(share * base.count()))
    seeds = number_rows(base, [], [seeded_order(seed, "id"), F.col("id")], "cluster").filter(F.col("cluster") <= k)
    cuts = Rounds("centres")
    centers = cuts.cut(seeds.select(F.col("cluster").cast("bigint").alias("id"), "x"))
    for _ in range(rounds):
        near = knn_join(base, centers, 1).select("id", F.col("neighbor").alias("cluster"))
        sums = fold_keys(base.join(near, "id").select("cluster", "x"), "cluster", _sums)
        vector = F.sort_array(F.collect_list(F.struct("slot", "value")))
        # the first number counts the rows; a sum of 0 is left out of the fold
        parts = sums.groupBy("cluster").agg(F.map_from_entries(vector).alias("s")).join(centers.withColumnRenamed("id", "cluster"), "cluster")
        mean = F.transform(F.sequence(F.lit(1).cast("long"), F.size("x").cast("long")), lambda i: F.coalesce(F.element_at("s", i), F.lit(0.0)) / F.element_at("s", F.lit(0).cast("long")))
        moved = parts.select(F.col("cluster").alias("id"), mean.alias("_x"))
        centers = cuts.cut(centers.join(moved, "id", "left").select("id", F.coalesce("_x", "x").alias("x")))
    return knn_join(base, centers, 1).select("id", F.col("neighbor").alias("cluster"), "dist")
