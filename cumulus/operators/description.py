"""Description length of manifold clusterings, in bits.

Model: precision x (N + M N - M (M + 1) / 2). Rows: data precision x n M for the coordinates inside, and n
times the entropy of every residual axis, binned so that the quantisation error stays within eps.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulus.functions.vectors import matrix
from cumulus.operators.folds import map_blocks
from cumulus.operators.gaussians import cluster_models
from cumulus.operators.manifolds import ManifoldForms, forms_of, free_rows
from cumulus.session import check_state, materialise


def raw_bits(points: DataFrame, bits: int = 32, keys: list[str] = []) -> DataFrame:
    """``bits`` per stored number."""
    return points.groupBy(*keys).agg((F.sum(F.size("x")) * bits).alias("bits"))


def axis_entropies(points: DataFrame, label: str, forms: ManifoldForms, errors: list[float]) -> DataFrame:
    """(cluster, axis, eps, n, entropy) with axes from 1 in the order of the forms.

    Rows are binned once, at the smallest error; coarser errors must be whole multiples of it and are rolled
    up from the counted bins.
    """
    check_state(forms.axes.size, "manifold forms")
    fine = min(errors)
    factors = [round(e / fine) for e in errors]
    if any(abs(f * fine - e) > 1e-9 * e for f, e in zip(factors, errors)):
        raise ValueError("errors must be whole multiples of the smallest one")
    place = {int(c): i for i, c in enumerate(forms.ids)}
    width = 2 * fine

    def step(batch):
        X, y = matrix(batch.column("x")), batch.column("y").to_numpy()
        out = np.zeros(X.shape, np.int64)
        for c in np.unique(y):
            i = place[int(c)]
            mine = y == c
            out[mine] = np.floor((X[mine] - forms.mu[i]) @ forms.axes[i] / width)
        offsets = pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32))
        return {"_bins": pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))}

    binned = map_blocks(points.select("x", F.col(label).cast("int").alias("y")), step, "_bins array<bigint>", ["y"])
    counts = binned.select("y", F.posexplode("_bins").alias("axis", "bin")).groupBy("y", "axis", "bin").agg(F.count("*").alias("c"))
    counts = materialise(counts, "bins")
    scales = F.array(*[F.struct(F.lit(float(e)).alias("eps"), F.lit(int(f)).alias("f")) for e, f in zip(errors, factors)])
    wide = counts.select("y", "axis", "bin", "c", F.explode(scales).alias("s"))
    rolled = wide.groupBy("y", "axis", F.col("s.eps").alias("eps"), F.floor(F.col("bin") / F.col("s.f")).alias("b")).agg(F.sum("c").alias("c"))
    per_axis = rolled.groupBy("y", "axis", "eps").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return per_axis.select(F.col("y").alias("cluster"), (F.col("axis") + 1).alias("axis"), "eps", "n", (F.log2("n") - F.col("s") / F.col("n")).alias("entropy"))


def description_bits(points: DataFrame, label: str, forms: ManifoldForms, model_precision: int, data_precision: int, errors: list[float], dims: list[int] = [-1]) -> DataFrame:
    """(cluster, n, eps, d, m, bits) on the grid of errors and dimensions; d < 0 keeps each cluster's own."""
    N = forms.mu.shape[1]
    axes = axis_entropies(points, label, forms, errors)
    own = F.create_map(*[F.lit(int(v)) for c, m in zip(forms.ids, forms.dims) for v in (c, m)])
    grid = axes.select("*", F.explode(F.array(*[F.lit(int(v)) for v in dims])).alias("d"))
    m = F.when(F.col("d") < 0, own[F.col("cluster")]).otherwise(F.least(F.col("d"), F.lit(N)))
    tail = grid.withColumn("m", m).groupBy("cluster", "n", "eps", "d", "m").agg(
        F.sum(F.when(F.col("axis") > F.col("m"), F.col("entropy")).otherwise(0.0)).alias("h")
    )
    model = model_precision * (N + F.col("m") * N - F.col("m") * (F.col("m") + 1) / 2)
    data = data_precision * F.col("n") * F.col("m") + F.col("n") * F.col("h")
    return tail.select("cluster", "n", "eps", "d", "m", (model + data).alias("bits"))


def compression(points: DataFrame, label: str, forms: ManifoldForms, algorithm: str, model_precision: int = 32, data_precision: int = 16,
                errors: list[float] = [1e-3], dims: list[int] = [-1], raw_precision: int = 32) -> DataFrame:
    """(algorithm, d, eps, bits, ratio): description length of a whole clustering and raw / description."""
    raw = raw_bits(points, raw_precision).first()["bits"]
    parts = description_bits(points, label, forms, model_precision, data_precision, errors, dims)
    return parts.groupBy("d", "eps").agg(F.sum("bits").alias("bits")).select(F.lit(algorithm).alias("algorithm"), "d", "eps", "bits", (F.lit(float(raw)) / F.col("bits")).alias("ratio"))


def manifold_summary(clusters: DataFrame) -> DataFrame:
    """(algorithm, clusters, avg_dim) of a table (algorithm, cluster, dim)."""
    return clusters.groupBy("algorithm").agg(F.count("*").alias("clusters"), F.avg("dim").alias("avg_dim"))


def description_accepts(ratio: float, error: float, model_precision: int = 32, data_precision: int = 16):
    """Acceptance rule for manifold clustering: the cluster must compress by at least ``ratio``."""
    def accept(base, found, conds, fitted):
        def step(batch):
            return {"cluster": pa.array(free_rows(matrix(batch.column("x")), found, conds).astype(np.int32))}

        inside = map_blocks(base, step, "cluster int", ["x"]).filter("cluster = 1")
        forms = forms_of(cluster_models(inside, "cluster", ids=np.array([1])), fitted.dim)
        got = compression(inside, "cluster", forms, "candidate", model_precision, data_precision, [error]).first()
        return got is not None and math.isfinite(got["ratio"]) and got["ratio"] >= ratio

    return accept
