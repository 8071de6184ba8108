"""Manifold clusterings, description lengths, covers and reduction."""

from __future__ import annotations

from pyspark.sql import functions as F

import numpy as np

from cumulus.functions import vectors as V
from cumulus.functions.columns import padded_label
from cumulus.operators import covers as O
from cumulus.operators import description as B
from cumulus.operators import manifolds as L
from cumulus.operators import projected as R
from cumulus.operators.gaussians import cluster_models
from cumulus.operators.kmeans import assign_centers, kmeans
from cumulus.operators.summary import mean_std
from cumulus.plans.clouds import points
from cumulus.plans.registry import query, table
from cumulus.plans.reports import RUNS, r6, runs
from cumulus.plans.topology import lots

ERRORS = [0.1, 0.01, 0.001]
AXIS = {"A": 0, "N": 1, "R": 2}


def cube(spark, sf):
    """Order lines in quantity, discount and tax, clustered by return flag."""
    return table(spark, sf, "lineitem").select(
        F.array(F.col("l_quantity") / 50, "l_discount", "l_tax").alias("x"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("cluster"),
    )


def unit_forms(dim: int = 1) -> L.ManifoldForms:
    """Manifolds along the coordinate axes through the origin, as the description-length experiments use."""
    return L.ManifoldForms(np.arange(3), np.zeros(3, int), np.zeros((3, 3)), np.stack([np.eye(3)] * 3), np.full(3, dim))


BITS = """WITH p AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS cluster, [l_quantity / 50, l_discount, l_tax] AS x FROM lineitem),
  f AS (SELECT cluster, i AS axis, floor(x[i] / 0.002)::BIGINT AS bin, count(*) AS c FROM p, (SELECT unnest([1, 2, 3]) AS i) GROUP BY ALL),
  g AS (SELECT cluster, axis, eps, floor(bin / k::DOUBLE) AS b, sum(c) AS c FROM f, (SELECT unnest([0.1, 0.01, 0.001])::DOUBLE AS eps, unnest([100, 10, 1]) AS k) GROUP BY ALL),
  h AS (SELECT cluster, axis, eps, sum(c)::BIGINT AS n, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy FROM g GROUP BY ALL),
  t AS (SELECT cluster, n, eps, d, CASE WHEN d < 0 THEN 1 ELSE least(d, 3) END AS m, axis, entropy FROM h, (SELECT unnest([-1, 0, 1, 2])::INTEGER AS d)),
  s AS (SELECT cluster, n, eps, d, m, sum(CASE WHEN axis > m THEN entropy ELSE 0 END) AS h FROM t GROUP BY ALL),
  bits AS (SELECT cluster, n, eps, d, m, 24 * (3 + m * 3 - m * (m + 1) / 2) + 16 * n * m + n * h AS bits FROM s)
"""


@query(BITS + "SELECT cluster, n, eps, d, m, round(bits, 3) AS bits FROM bits")
def mdl_bits(spark, sf):
    """Optimal-quantisation length on a grid of errors and dimensions, per cluster."""
    out = B.description_bits(cube(spark, sf), "cluster", unit_forms(), 24, 16, ERRORS, [-1, 0, 1, 2])
    return r6(out, "bits", digits=3)


@query(BITS + "SELECT cluster, axis, eps, n, round(entropy, 6) AS entropy FROM h")
def axis_entropies(spark, sf):
    return r6(B.axis_entropies(cube(spark, sf), "cluster", unit_forms(), ERRORS), "entropy")


@query(BITS + "SELECT 'axes' AS algorithm, d, eps, round(sum(bits), 3) AS bits, round((SELECT 96 * count(*) FROM p) / sum(bits), 6) AS ratio FROM bits GROUP BY ALL")
def compression_ratio(spark, sf):
    out = B.compression(cube(spark, sf), "cluster", unit_forms(), "axes", 24, 16, ERRORS, [-1, 0, 1, 2])
    return r6(r6(out, "bits", digits=3), "ratio")


@query("WITH p AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS cluster FROM lineitem) SELECT cluster, count(*) * 96 AS bits FROM p GROUP BY ALL")
def raw_description(spark, sf):
    return B.raw_bits(cube(spark, sf), keys=["cluster"])


@query(RUNS + """SELECT 'N =' || lpad(dimension::VARCHAR, 2, ' ') AS dimension, eps, round(avg(score), 6) AS bits_mean, round(stddev_samp(score), 6) AS bits_std
  FROM (SELECT *, regexp_extract(dataset, 'D(\\d+)$', 1)::INTEGER AS dimension FROM runs) GROUP BY ALL""")
def mdl_sweep_summary(spark, sf):
    rows = runs(spark, sf).select(F.regexp_extract("dataset", r"D(\d+)$", 1).cast("int").alias("dimension"), "eps", F.col("score").alias("bits"))
    out = mean_std(rows, ["dimension", "eps"], ["bits"]).withColumn("dimension", padded_label("N =", "dimension"))
    return r6(out, "bits_mean", "bits_std")


@query("""WITH c AS (SELECT l_returnflag AS algorithm, l_linenumber AS cluster, max(l_linenumber % 3) AS dim FROM lineitem GROUP BY ALL)
  SELECT algorithm, count(*) AS clusters, round(avg(dim), 6) AS avg_dim FROM c GROUP BY ALL""")
def manifold_summary(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("algorithm"), F.col("l_linenumber").alias("cluster")).agg(F.max(F.col("l_linenumber") % 3).alias("dim"))
    return r6(B.manifold_summary(c), "avg_dim")


@query("""WITH p AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS cluster, l_quantity / 50 AS q, l_discount AS d, l_tax AS t FROM lineitem)
  SELECT cluster, round(max(abs(q)), 6) AS reach FROM p GROUP BY ALL""")
def manifold_reach(spark, sf):
    """Largest distance inside the manifold of each cluster, here the quantity axis."""
    axis = np.eye(3)[:, :1]
    lines = L.ManifoldClustering([L.Manifold(np.zeros(3), axis) for _ in range(3)])
    reach = L.in_manifold_reach(cube(spark, sf).withColumn("cluster", F.col("cluster") + 1), lines)
    return spark.createDataFrame([(i, round(float(r), 6)) for i, r in enumerate(reach)], "cluster int, reach double")


@query()
def compression_by_algorithm(spark, sf):
    """k-means and projected clusters in manifold form, compared in bits."""
    pts = lots(spark, sf)
    km = assign_centers(pts, kmeans(pts, 6, 1, rounds=8))
    oc = R.assign_projected(pts, R.projected_clusters(pts, 6, 1, 12, 1))
    parts = [
        B.compression(rows, "cluster", L.manifold_forms(rows, "cluster", 1), name, errors=[0.1, 0.01], dims=[-1, 0, 1])
        for name, rows in (("kmeans", km), ("projected", oc))
    ]
    return parts[0].unionByName(parts[1])


def _sizes(rows, extra=()):
    return rows.groupBy("cluster").agg(F.count("*").alias("n"), *extra)


@query()
def manifold_clusters(spark, sf):
    pts = lots(spark, sf)
    return _sizes(L.manifold_clusters(pts, 1, clusters=4, best_bound=0.4, min_size=50, candidates=24, seed=3).assign(pts))


@query()
def manifold_clusters_mdl(spark, sf):
    """The same with compression as acceptance test and bounded clusters."""
    pts = lots(spark, sf)
    accept = B.description_accepts(1.0, 1e-2)
    return _sizes(L.manifold_clusters(pts, 1, clusters=3, best_bound=0.35, min_size=50, candidates=24, seed=3, bounded=True, accept=accept).assign(pts))


@query()
def manifold_split(spark, sf):
    pts = lots(spark, sf)
    found = L.manifold_clusters(pts, 1, clusters=3, best_bound=0.4, min_size=50, candidates=24, seed=3)
    return _sizes(L.split_defective(pts, found, threshold=6.0, min_size=50, clusters=3, best_bound=0.4, candidates=24, seed=9))


@query()
def projected_clusters(spark, sf):
    pts = points(spark, sf)
    return _sizes(R.assign_projected(pts, R.projected_clusters(pts, 5, 8, 15, 2)), [F.sum("dist2").alias("energy")])


@query()
def pca_reduce(spark, sf):
    """Fitted on the training part, applied to both."""
    pts = points(spark, sf)
    red = R.fit_reduction(pts.filter("split = 'train'"), 8)
    return R.reduce_points(pts, red).select("id", "split", F.posexplode("x").alias("axis", "value"))


@query("""WITH m AS (SELECT i, var_pop(embedding[i]::DOUBLE) AS v FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY ALL) SELECT round(sum(v), 6) AS variance FROM m""")
def pca_variance(spark, sf):
    """All components together carry the total variance."""
    red = R.fit_reduction(points(spark, sf), 64)
    return spark.createDataFrame([(round(float(red.variance.sum()), 6),)], "variance double")


@query("""WITH m AS (SELECT i, avg(embedding[i]::DOUBLE) AS mu FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY ALL)
  SELECT vec_id AS id, round(sum((embedding[i]::DOUBLE - mu) ** 2), 6) AS norm FROM embeddings, m GROUP BY ALL""")
def pca_norms(spark, sf):
    """With all components kept, the reduced rows keep their distance to the mean."""
    pts = points(spark, sf).select("id", "x")
    out = R.reduce_points(pts, R.fit_reduction(pts, 64))
    return out.select("id", F.round(V.dot(F.col("x"), F.col("x")), 6).alias("norm"))


def _cover(spark, sf, method, classes, multiplier, **opts):
    c = O.cover(lots(spark, sf), method, classes, multiplier, seed=3, **opts)
    sizes = spark.createDataFrame([(method, int(i), int(n)) for i, n in zip(c.models.ids, c.models.n)], "method string, comp int, n bigint")
    reach = c.edges.select(F.col("a").alias("comp"), "w").unionByName(c.edges.select(F.col("b").alias("comp"), "w")).groupBy("comp").agg(F.min("w").alias("nearest"))
    return sizes.join(reach.withColumn("comp", F.col("comp").cast("int")), "comp", "left")


@query()
def cover_kmeans(spark, sf):
    return _cover(spark, sf, "kmeans", 5, 2, rounds=10)


@query()
def cover_factors(spark, sf):
    return _cover(spark, sf, "factors", 4, 2)


@query()
def cover_mixture(spark, sf):
    return _cover(spark, sf, "mixture", 4, 2, max_iter=6, restarts=1)


@query()
def cover_mixture_full(spark, sf):
    return _cover(spark, sf, "mixture", 4, 2, kind="full", max_iter=6, restarts=1)


@query()
def cover_dirichlet(spark, sf):
    return _cover(spark, sf, "dirichlet", 4, 2, max_iter=8)


@query()
def cover_manifold(spark, sf):
    return _cover(spark, sf, "manifold", 2, 2, entropy_bound=10.0, search={"best_bound": 0.4, "min_size": 50, "candidates": 24})
