"""Point clouds: agreement, neighbours, Gaussian models, classifiers and clusterings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulus.functions import vectors as V
from cumulus.operators import agreement as G
from cumulus.operators import classify as L
from cumulus.operators import density as D
from cumulus.operators import gaussians as M
from cumulus.operators import kmeans as K
from cumulus.operators import mixtures as X
from cumulus.operators import neighbors as N
from cumulus.operators.ordering import seeded_pick
from cumulus.operators.summary import mean_std
from cumulus.plans.registry import query, table
from cumulus.plans.reports import r6

DIM = 64
AXES = f"(SELECT unnest(generate_series(1, {DIM})) AS i)"


def points(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings as a labelled cloud: classes 1 to 10."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), V.as_double("embedding").alias("x"), (F.col("label") + 1).alias("label"),
        F.when(F.col("vec_id") % 4 == 0, "test").otherwise("train").alias("split"),
    )


PTS = """WITH pts AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label + 1 AS label,
  CASE WHEN vec_id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM embeddings)
"""


def trades(spark: SparkSession, sf: str, label: str = "l_linenumber") -> DataFrame:
    """Order lines in the plane of quantity and price (thousands), clustered by line number."""
    return table(spark, sf, "lineitem").select(
        V.pack("l_quantity", "l_extendedprice").alias("raw"), F.col(label).alias("label")
    ).select(F.array(F.col("raw")[0], F.col("raw")[1] / 1000).alias("x"), "label")


PLANE = """WITH t AS (SELECT l_quantity AS q, l_extendedprice / 1000 AS p, l_linenumber AS label FROM lineitem),
  m AS (SELECT label, count(*) AS n, avg(q) AS mq, avg(p) AS mp, var_pop(q) AS vq, var_pop(p) AS vp, covar_pop(q, p) AS c FROM t GROUP BY ALL),
  g AS (SELECT *, vq * vp - c * c AS det FROM m)
"""
MAHA = "((q - mq) ** 2 * vp - 2 * (q - mq) * (p - mp) * c + (p - mp) ** 2 * vq) / det"


def balances(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), V.pack("c_acctbal").alias("x"), F.col("c_nationkey").alias("label"))


def _seeded(k: int, seed: int) -> str:
    return f"(SELECT x, row_number() OVER (ORDER BY md5('{seed}:' || id), id) AS c FROM pts QUALIFY c <= {k})"


def _assigned(k: int, seed: int) -> str:
    return f"SELECT p.id, p.label, arg_min(s.c, list_distance(p.x, s.x)) AS cluster FROM pts p, {_seeded(k, seed)} s GROUP BY ALL"


def seed_clusters(spark, sf, k=10, seed=3):
    pts = points(spark, sf)
    return K.assign_centers(pts, K.KMeansFit("seeds", K.random_centers(pts, k, seed)), keep=["id", "label"])


MI = """, c AS (SELECT label, cluster, count(*) AS n FROM a GROUP BY ALL), r AS (SELECT label, sum(n) AS n FROM c GROUP BY ALL),
  s AS (SELECT cluster, sum(n) AS n FROM c GROUP BY ALL), t AS (SELECT sum(n)::DOUBLE AS n FROM c),
  i AS (SELECT sum(c.n / t.n * ln(t.n * c.n / (r.n * s.n))) AS mi FROM c JOIN r USING (label) JOIN s ON s.cluster = c.cluster, t),
  h AS (SELECT -(SELECT sum(r.n / t.n * ln(r.n / t.n)) FROM r, t) - (SELECT sum(s.n / t.n * ln(s.n / t.n)) FROM s, t) AS h)
  SELECT round(mi, 6) AS mi, round(2 * mi / h, 6) AS nmi FROM i, h"""
RAND = """, c AS (SELECT label, cluster, count(*) AS n FROM a GROUP BY ALL), r AS (SELECT sum(n) AS n FROM c GROUP BY label),
  s AS (SELECT sum(n) AS n FROM c GROUP BY cluster),
  v AS (SELECT (SELECT sum(n * (n - 1) / 2)::DOUBLE FROM c) AS ab, (SELECT sum(n * (n - 1) / 2)::DOUBLE FROM r) AS a,
    (SELECT sum(n * (n - 1) / 2)::DOUBLE FROM s) AS b, (SELECT sum(n) * (sum(n) - 1) / 2::DOUBLE FROM c) AS p)
  SELECT round((ab - a * b / p) / ((a + b) / 2 - a * b / p), 6) AS adjusted_rand, round((p + 2 * ab - a - b) / p, 6) AS rand,
    round((a + b - 2 * ab) / p, 6) AS mirkin, round((p + 4 * ab - 2 * a - 2 * b) / p, 6) AS hubert FROM v"""


@query(PTS + f", a AS ({_assigned(10, 3)})" + MI)
def nmi(spark, sf):
    """Agreement of the classes with the nearest of ten seeded rows."""
    return r6(G.mutual_information(seed_clusters(spark, sf), "label", "cluster"), "mi", "nmi")


@query("WITH a AS (SELECT quality AS label, toxic AS cluster FROM labels)" + MI)
def nmi_labels(spark, sf):
    return r6(G.mutual_information(table(spark, sf, "labels"), "quality", "toxic"), "mi", "nmi")


@query(PTS + f", a AS ({_assigned(10, 3)})" + RAND)
def rand_indices(spark, sf):
    return r6(G.rand_indices(seed_clusters(spark, sf), "label", "cluster"), "adjusted_rand", "rand", "mirkin", "hubert")


@query("WITH a AS (SELECT quality AS label, toxic AS cluster FROM labels)" + RAND)
def rand_indices_labels(spark, sf):
    return r6(G.rand_indices(table(spark, sf, "labels"), "quality", "toxic"), "adjusted_rand", "rand", "mirkin", "hubert")


@query(PTS + f", a AS ({_assigned(10, 3)}) SELECT label, cluster::INTEGER AS cluster, count(*) AS n FROM a GROUP BY ALL")
def confusion(spark, sf):
    return G.confusion(seed_clusters(spark, sf), "label", "cluster")


@query(PTS + f""", a AS ({_assigned(10, 3)}), c AS (SELECT label, cluster, count(*) AS n FROM a GROUP BY ALL),
  f AS (SELECT l.label, s.cluster, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT label FROM a) l CROSS JOIN (SELECT DISTINCT cluster FROM a) s
    LEFT JOIN c ON c.label = l.label AND c.cluster = s.cluster),
  w AS (SELECT label, list({{'n': -n, 'c': cluster}} ORDER BY -n, cluster) AS row FROM f GROUP BY ALL),
  o AS (SELECT list_reduce(list_prepend([]::BIGINT[], list(list_transform(row, lambda e: e.c) ORDER BY label)),
      lambda used, cand: list_append(used, list_filter(cand, lambda e: NOT list_contains(used, e))[1])) AS used FROM w)
  SELECT f.label, f.cluster::INTEGER AS cluster, list_position(used, f.cluster)::INTEGER AS col, n FROM f, o""")
def confusion_matched(spark, sf):
    return G.matched_confusion(seed_clusters(spark, sf), "label", "cluster")


@query("SELECT round(avg((quality = toxic)::INTEGER), 6) AS accuracy FROM labels")
def accuracy(spark, sf):
    return r6(G.accuracy(table(spark, sf, "labels"), "quality", "toxic"), "accuracy")


@query(PTS + f", a AS ({_assigned(10, 3)}) SELECT 'seeds' AS run_id, id, cluster::INTEGER AS cluster FROM a")
def export_assignments(spark, sf):
    return G.export_assignments(seed_clusters(spark, sf), "seeds", "cluster")


# --- vectors and moments ------------------------------------------------------------------------

@query(PTS + f"SELECT id, round(sum((x[i] - 0.1) * (1 + i % 3)), 6) AS total FROM pts, {AXES} GROUP BY id")
def scale_vectors(spark, sf):
    moved = V.scale(V.shift(F.col("x"), [0.1] * DIM), [1 + (i + 1) % 3 for i in range(DIM)])
    return r6(points(spark, sf).select("id", F.aggregate(moved, F.lit(0.0), lambda a, b: a + b).alias("total")), "total")


@query("SELECT 32 * sum(len(embedding))::BIGINT AS bits FROM embeddings")
def raw_bits(spark, sf):
    return table(spark, sf, "embeddings").agg((32 * F.sum(F.size("embedding"))).alias("bits"))


@query(PTS + f""", m AS (SELECT label, i, avg(x[i]) AS mu FROM pts, {AXES} GROUP BY ALL),
  d AS (SELECT p.label, p.id, m.i, p.x[m.i] - m.mu AS v FROM pts p JOIN m ON p.label = m.label)
  SELECT a.label, a.i, b.i AS j, round(avg(a.v * b.v), 8) AS cov FROM d a JOIN d b ON a.id = b.id AND a.i <= b.i GROUP BY ALL""")
def cluster_moments(spark, sf):
    """Full 64 x 64 covariance of every class."""
    models = M.cluster_models(points(spark, sf), "label").to_table(spark)
    rows = models.select(F.col("comp").alias("label"), F.posexplode("cov").alias("i", "row")).select("label", "i", F.posexplode("row").alias("j", "cov"))
    return rows.filter("i <= j").select("label", (F.col("i") + 1).cast("bigint").alias("i"), (F.col("j") + 1).cast("bigint").alias("j"), F.round("cov", 8).alias("cov"))


@query(PLANE + "SELECT label, n, round((ln(det) + 2 * ln(2 * pi()) + 1) / 2, 6) AS entropy FROM g")
def model_entropy(spark, sf):
    models = M.cluster_models(trades(spark, sf), "label")
    rows = [(int(c), int(n), round(float(e), 6)) for c, n, e in zip(models.ids, models.n, models.entropy())]
    return spark.createDataFrame(rows, "label int, n bigint, entropy double")


@query(PLANE + f""", s AS (SELECT t.*, g.label AS comp, -0.5 * (2 * ln(2 * pi()) + ln(det) + {MAHA}) AS d FROM t, g),
  b AS (SELECT q, p, label, arg_max(comp, d) AS comp, max(d) AS d FROM s GROUP BY ALL)
  SELECT b.comp, count(*) AS n, round(sum(d), 3) AS loglik FROM b JOIN (SELECT q, p, label, count(*) AS w FROM t GROUP BY ALL) u USING (q, p, label), generate_series(1, w) GROUP BY ALL""")
def assign_models(spark, sf):
    """Every order line to the full-covariance model of highest density."""
    pts = trades(spark, sf)
    out = M.assign_models(pts, M.cluster_models(pts, "label"), keep=[])
    return out.groupBy("comp").agg(F.count("*").alias("n"), F.round(F.sum("comp_score"), 3).alias("loglik"))


@query(PLANE + f""", s AS (SELECT t.q, t.p, t.label, g.label AS comp, -0.5 * (2 * ln(2 * pi()) + ln(det) + {MAHA}) AS d FROM t, g),
  b AS (SELECT q, p, label, arg_max(comp, d) AS comp FROM s GROUP BY ALL),
  z AS (SELECT comp, sum(w)::BIGINT AS n FROM b JOIN (SELECT q, p, label, count(*) AS w FROM t GROUP BY ALL) u USING (q, p, label) GROUP BY ALL)
  SELECT comp, n FROM z WHERE n >= (SELECT count(*) FROM t) // 20""")
def prune_models(spark, sf):
    pts = trades(spark, sf)
    kept = M.prune_models(pts, M.cluster_models(pts, "label"), pts.count() // 20)
    return spark.createDataFrame([(int(i), int(n)) for i, n in zip(kept.ids, kept.n)], "comp int, n bigint")


@query(PLANE + f""", u AS (SELECT * FROM g WHERE n > (SELECT count(*) FROM t) // 7), s AS (SELECT t.q, t.p, u.label AS comp, -0.5 * (ln(det) + {MAHA}) AS d, w FROM (SELECT q, p, count(*) AS w FROM t GROUP BY ALL) t, u),
  b AS (SELECT q, p, any_value(w) AS w, arg_max(comp, d) AS comp FROM s GROUP BY ALL), z AS (SELECT comp, sum(w)::BIGINT AS n FROM b GROUP BY ALL)
  SELECT u.label AS comp, coalesce(z.n, 0) AS n, round(u.mq, 6) AS quantity FROM u LEFT JOIN z ON z.comp = u.label""")
def construct_models(spark, sf):
    """Models of the clusters above a minimum size with finite entropy, sized by reassigning every row."""
    pts = trades(spark, sf)
    kept = M.construct_models(pts, "label", pts.count() // 7)
    return spark.createDataFrame([(int(i), int(n), round(float(m[0]), 6)) for i, n, m in zip(kept.ids, kept.n, kept.mu)], "comp int, n bigint, quantity double")


def diag_sql(where: str = "") -> str:
    return f"""m AS (SELECT label AS c, i, avg(x[i]) AS mu, var_pop(x[i]) AS v FROM pts, {AXES} {where} GROUP BY ALL),
  w AS (SELECT label AS c, ln(count(*) / (SELECT count(*) FROM pts {where})) AS lw FROM pts {where} GROUP BY ALL),
  d AS (SELECT id, c, -0.5 * ({DIM} * ln(2 * pi()) + sum(ln(v) + (x[i] - mu) ** 2 / v)) AS d FROM pts, m GROUP BY ALL)"""


@query(PTS + f", {diag_sql()} SELECT id, arg_max(c, d + lw)::INTEGER AS pred FROM d JOIN w USING (c) GROUP BY ALL")
def bayes_classify(spark, sf):
    pts = points(spark, sf)
    return L.bayes_predict(pts, L.bayes_fit(pts, "label", "diag"), keep=["id"]).select("id", "pred")


@query(PTS + f", {diag_sql()} SELECT id, arg_max(c, d)::INTEGER AS pred FROM d GROUP BY ALL")
def likelihood_classify(spark, sf):
    pts = points(spark, sf)
    return L.likelihood_predict(pts, L.bayes_fit(pts, "label", "diag"), keep=["id"]).select("id", "pred")


META_SQL = f""", {diag_sql()}, z AS (SELECT c, (c - 1) // 2 + 1 AS g, lw FROM w), y AS (SELECT g, ln(sum(exp(lw))) AS lg FROM z GROUP BY ALL),
  b AS (SELECT id, g, max(d + lw - lg) AS top FROM d JOIN z USING (c) JOIN y USING (g) GROUP BY ALL),
  e AS (SELECT id, g, lg, any_value(top) + ln(sum(exp(d + lw - lg - top))) AS s FROM d JOIN z USING (c) JOIN y USING (g) JOIN b USING (id, g) GROUP BY ALL)"""
PAIRS = [[2 * i + 1, 2 * i + 2] for i in range(5)]


@query(PTS + META_SQL + " SELECT id, arg_max(g, s + lg)::INTEGER AS pred FROM e GROUP BY ALL")
def meta_bayes_classify(spark, sf):
    """Meta-clusters of two classes each, as mixtures weighted by their counts, with prior."""
    pts = points(spark, sf)
    return L.meta_predict(pts, M.cluster_models(pts, "label", "diag"), PAIRS, keep=["id"])


@query(PTS + META_SQL + " SELECT id, arg_max(g, s)::INTEGER AS pred FROM e GROUP BY ALL")
def meta_likelihood_classify(spark, sf):
    pts = points(spark, sf)
    return L.meta_predict(pts, M.cluster_models(pts, "label", "diag"), PAIRS, prior=False, keep=["id"])


@query(PTS + f", {diag_sql()} SELECT id, arg_max(c, d)::INTEGER AS comp FROM d GROUP BY ALL")
def mixture_component(spark, sf):
    pts = points(spark, sf)
    return L.mixture_component(pts, M.cluster_models(pts, "label", "diag"), keep=["id"]).select("id", "comp")


@query(PTS + f""", o AS (SELECT *, CASE WHEN list_max(x) > 0.35 THEN NULL ELSE label END AS kept FROM pts), {diag_sql()},
  n AS (SELECT id, arg_max(c, d)::INTEGER AS near FROM d GROUP BY ALL) SELECT id, coalesce(kept, near) AS label FROM o JOIN n USING (id)""")
def reassign_outliers(spark, sf):
    pts = points(spark, sf)
    models = M.cluster_models(pts, "label", "diag")
    dropped = pts.withColumn("label", F.when(F.array_max("x") <= 0.35, F.col("label")))
    return M.reassign_outliers(dropped, "label", models).select("id", "label")


@query(PTS + f""", {diag_sql("WHERE split = 'train'")}, b AS (SELECT id, arg_max(c, d + lw)::INTEGER AS pred FROM d JOIN w USING (c) GROUP BY ALL),
  l AS (SELECT id, arg_max(c, d)::INTEGER AS pred FROM d GROUP BY ALL),
  n AS (SELECT q.id, arg_min(t.label, list_distance(q.x, t.x)) AS pred FROM pts q, pts t WHERE t.split = 'train' GROUP BY ALL),
  u AS (SELECT 'bayes' AS algorithm, * FROM b UNION ALL SELECT 'likelihood', * FROM l UNION ALL SELECT 'neighbor', * FROM n),
  a AS (SELECT algorithm, split, label, pred FROM u JOIN pts USING (id)),
  c AS (SELECT algorithm, split, label, pred, count(*) AS n FROM a GROUP BY ALL),
  f AS (SELECT algorithm, split, sum(n)::DOUBLE AS n FROM c GROUP BY ALL),
  x AS (SELECT algorithm, split, sum(n * ln(n)) AS v FROM c GROUP BY ALL),
  y AS (SELECT algorithm, split, sum(n * ln(n)) AS v FROM (SELECT algorithm, split, label, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL),
  z AS (SELECT algorithm, split, sum(n * ln(n)) AS v FROM (SELECT algorithm, split, pred, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL),
  h AS (SELECT f.algorithm, f.split, ln(f.n) - y.v / f.n AS ha, ln(f.n) - z.v / f.n AS hb, ln(f.n) - x.v / f.n AS hab
    FROM f JOIN x USING (algorithm, split) JOIN y USING (algorithm, split) JOIN z USING (algorithm, split))
  SELECT algorithm, split, round(2 * (ha + hb - hab) / (ha + hb), 6) AS nmi FROM h""")
def split_agreement(spark, sf):
    """Three classifiers fitted on the training part, scored on both parts in one grouped pass."""
    pts = points(spark, sf)
    train = pts.filter("split = 'train'")
    models = L.bayes_fit(train, "label", "diag")
    parts = [
        L.bayes_predict(pts, models, keep=["id", "label", "split"]).select("id", "label", "split", "pred", F.lit("bayes").alias("algorithm")),
        L.likelihood_predict(pts, models, keep=["id", "label", "split"]).select("id", "label", "split", "pred", F.lit("likelihood").alias("algorithm")),
        N.nearest_label(pts, train, "label").select("id", "pred", F.lit("neighbor").alias("algorithm")).join(pts.select("id", "label", "split"), "id"),
    ]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return r6(G.mutual_information(both, "label", "pred", ["algorithm", "split"]).select("algorithm", "split", "nmi"), "nmi")


# --- neighbours ---------------------------------------------------------------------------------

@query(PTS + """SELECT q.id, arg_min(t.label, list_distance(q.x, t.x)) AS pred, round(min(list_distance(q.x, t.x)), 6) AS dist
  FROM pts q, pts t WHERE t.split = 'train' GROUP BY q.id""")
def nearest_label(spark, sf):
    pts = points(spark, sf)
    return r6(N.nearest_label(pts, pts.filter("split = 'train'"), "label").select("id", "pred", "dist"), "dist")


@query(PTS + """SELECT a.id, b.id AS neighbor, round(list_distance(a.x, b.x), 6) AS dist,
  row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id)::INTEGER AS rank FROM pts a JOIN pts b ON a.id <> b.id QUALIFY rank <= 12""")
def nearest_neighbors(spark, sf):
    pts = points(spark, sf)
    return r6(N.knn_join(pts, pts, 12, exclude_self=True), "dist")


@query("""SELECT a.c_custkey AS id, b.c_custkey AS neighbor, round(abs(a.c_acctbal - b.c_acctbal), 6) AS dist,
  row_number() OVER (PARTITION BY a.c_custkey ORDER BY abs(a.c_acctbal - b.c_acctbal), b.c_custkey)::INTEGER AS rank
  FROM customer a JOIN customer b ON a.c_custkey <> b.c_custkey QUALIFY rank <= 3""")
def nearest_balances(spark, sf):
    pts = balances(spark, sf)
    return r6(N.knn_join(pts, pts, 3, exclude_self=True), "dist")


@query(PTS + """SELECT a.id AS a, b.id AS b, round(list_distance(a.x, b.x), 6) AS dist FROM pts a JOIN pts b ON a.id < b.id
  WHERE list_distance(a.x, b.x) <= 1.2""")
def pairs_within(spark, sf):
    return r6(N.pairs_within(points(spark, sf), 1.2), "dist")


@query("""SELECT a.c_custkey AS a, b.c_custkey AS b, round(abs(a.c_acctbal - b.c_acctbal), 6) AS dist FROM customer a
  JOIN customer b ON a.c_custkey < b.c_custkey AND b.c_acctbal BETWEEN a.c_acctbal - 2.5 AND a.c_acctbal + 2.5""")
def pairs_within_grid(spark, sf):
    return r6(N.pairs_within(balances(spark, sf), 2.5), "dist")


@query(PTS + f"SELECT p.id, s.c::INTEGER AS landmark, round(list_distance(p.x, s.x), 6) AS dist FROM pts p, {_seeded(20, 5)} s")
def landmark_distances(spark, sf):
    pts = points(spark, sf)
    return r6(N.landmark_distances(pts, K.random_centers(pts, 20, 5)), "dist")


@query(PTS + ", s AS (SELECT id, row_number() OVER (ORDER BY id) AS sub_id, label FROM pts WHERE label > 5) SELECT id, label FROM s")
def subset_back(spark, sf):
    from cumulus.operators.ordering import number_rows

    sub = number_rows(points(spark, sf).filter("label > 5").select("id", "label"), [], ["id"], "sub_id")
    return N.parent_ids(sub.select("sub_id", "label"), sub.select("sub_id", "id")).select("id", "label")


# --- clustering ---------------------------------------------------------------------------------

def lloyd_sql(k: int, seed: int, rounds: int) -> str:
    out = f", c0 AS {_seeded(k, seed)}"
    for r in range(rounds + 1):
        out += f", a{r} AS (SELECT p.id, any_value(p.x) AS x, arg_min(c.c, list_distance(p.x, c.x)) AS c, min(list_distance(p.x, c.x)) ** 2 AS d2 FROM pts p, c{r} c GROUP BY p.id)"
        if r < rounds:
            out += f", c{r + 1} AS (SELECT c, list(v ORDER BY i) AS x FROM (SELECT c, i, avg(x[i]) AS v FROM a{r}, {AXES} GROUP BY ALL) GROUP BY c)"
    return out


@query(PTS + lloyd_sql(10, 1, 3) + " SELECT c::INTEGER AS cluster, count(*) AS n, round(sum(d2), 6) AS cost FROM a3 GROUP BY ALL")
def kmeans_steps(spark, sf):
    """Three Lloyd rounds from ten seeded rows, then sizes and cost."""
    pts = points(spark, sf)
    fit = K.kmeans(pts, 10, seed=1, rounds=3, tol=-1.0)
    return r6(K.assign_centers(pts, fit, keep=[]).groupBy("cluster").agg(F.count("*").alias("n"), F.sum("dist2").alias("cost")), "cost")


SHARE = """, k AS (SELECT greatest(1, round_even(0.02 * count(*), 0)) AS k FROM pts),
  c0 AS (SELECT x, row_number() OVER (ORDER BY md5('6:' || id), id) AS c FROM pts QUALIFY c <= (SELECT k FROM k))"""
for _r in range(3):
    SHARE += f", a{_r} AS (SELECT p.id, any_value(p.x) AS x, arg_min(c.c, list_distance(p.x, c.x)) AS c, min(list_distance(p.x, c.x)) AS d FROM pts p, c{_r} c GROUP BY p.id)"
    SHARE += f", c{_r + 1} AS (SELECT c, list(v ORDER BY i) AS x FROM (SELECT c, i, avg(x[i]) AS v FROM a{_r}, {AXES} GROUP BY ALL) GROUP BY c)"


@query(PTS + SHARE + " SELECT id, c AS cluster, round(d, 6) AS dist FROM a2")
def kmeans_proportional(spark, sf):
    """k is two percent of the rows, so the centres stay a table."""
    return r6(K.kmeans_share(points(spark, sf), 0.02, seed=6, rounds=2), "dist")


def grid_sql(ks: list[int], seeds: list[int], rounds: int) -> str:
    """Lloyd rounds of many fits side by side."""
    out = ", f AS (SELECT unnest(" + str(ks) + ") AS k), c0 AS (SELECT k, s, c, x FROM f, (" + " UNION ALL ".join(
        f"SELECT {s} AS s, x, row_number() OVER (ORDER BY md5('{s}:' || id), id) AS c FROM pts" for s in seeds
    ) + ") WHERE c <= k)"
    for r in range(rounds + 1):
        out += f""", a{r} AS MATERIALIZED (SELECT k, s, p.id, any_value(p.label) AS label, any_value(p.x) AS x, arg_min(c.c, list_distance(p.x, c.x)) AS c,
    min(list_distance(p.x, c.x)) ** 2 AS d2 FROM pts p, c{r} c GROUP BY k, s, p.id)"""
        if r < rounds:
            out += f""", c{r + 1} AS MATERIALIZED (SELECT k, s, c, list(v ORDER BY i) AS x FROM (SELECT k, s, c, i, avg(x[i]) AS v FROM a{r}, {AXES} GROUP BY ALL) GROUP BY ALL)"""
    return out + f", cost AS (SELECT k, s, sum(d2) AS cost FROM a{rounds} GROUP BY ALL)"


def _fit_table(spark, fits):
    rows = [(f.run_id, f.k, round(float(f.cost), 6)) for f in fits]
    return spark.createDataFrame(rows, "run_id string, k int, cost double")


_BEST = " SELECT 'k' || k || '-s' || s AS run_id, k, round(cost, 6) AS cost FROM cost"


@query(PTS + grid_sql([10], [1, 2, 3], 4) + _BEST + " ORDER BY cost.cost LIMIT 1")
def kmeans_restarts(spark, sf):
    """Three restarts in shared scans; lowest cost after four rounds."""
    return _fit_table(spark, [K.best_of_restarts(points(spark, sf), 10, 3, 1, rounds=4, tol=-1.0)])


@query(PTS + grid_sql(list(range(2, 21)), [1, 2], 2) + _BEST + " ORDER BY cost.cost LIMIT 1")
def kmeans_over_k(spark, sf):
    """k = 2 .. 20 and two restarts in shared scans; lowest cost after two rounds."""
    return _fit_table(spark, [K.best_over_k(points(spark, sf), 5, 2, 1, rounds=2, tol=-1.0)])


@query(PTS + grid_sql(list(range(2, 21)), [1], 2) + """, n AS (SELECT k, label, c, count(*) AS n FROM a2 GROUP BY ALL), t AS (SELECT count(*)::DOUBLE AS n FROM pts),
  x AS (SELECT k, sum(n * ln(n)) AS v FROM n GROUP BY ALL), y AS (SELECT k, sum(n * ln(n)) AS v FROM (SELECT k, label, sum(n) AS n FROM n GROUP BY ALL) GROUP BY ALL),
  z AS (SELECT k, sum(n * ln(n)) AS v FROM (SELECT k, c, sum(n) AS n FROM n GROUP BY ALL) GROUP BY ALL),
  h AS (SELECT k, ln(t.n) - y.v / t.n AS ha, ln(t.n) - z.v / t.n AS hb, ln(t.n) - x.v / t.n AS hab FROM x JOIN y USING (k) JOIN z USING (k), t),
  best AS (SELECT arg_max(k, (ha + hb - hab) / (ha + hb)) AS k FROM h)
  SELECT 'k' || k || '-s' || s AS run_id, k, round(cost, 6) AS cost FROM cost JOIN best USING (k)""")
def kmeans_by_agreement(spark, sf):
    """The k of 2 .. 20 whose clusters agree best with the classes."""
    pts = points(spark, sf)
    fits = K.kmeans_grid(pts, list(range(2, 21)), [1], rounds=2, tol=-1.0)
    return _fit_table(spark, [K.best_by_agreement(pts, "label", fits)])


def em_sql(rounds: int, spherical: bool = False) -> str:
    """Rounds of EM from the class models; a spherical component has the mean of its axis variances."""
    var = "avg(v) OVER (PARTITION BY c)" if spherical else "v"
    out = f""", s0 AS (SELECT label AS c, i, avg(x[i]) AS mu, var_pop(x[i]) + 1e-6 AS v FROM pts, {AXES} GROUP BY ALL), m0 AS (SELECT c, i, mu, {var} AS v FROM s0),
  w0 AS (SELECT label AS c, count(*)::DOUBLE / (SELECT count(*) FROM pts) AS w FROM pts GROUP BY ALL)"""
    for r in range(rounds):
        out += f""", d{r} AS (SELECT id, c, ln(any_value(w)) - 0.5 * ({DIM} * ln(2 * pi()) + sum(ln(v) + (x[i] - mu) ** 2 / v)) AS d FROM pts, m{r} JOIN w{r} USING (c) GROUP BY id, c),
  r{r} AS (SELECT id, c, exp(d - max(d) OVER (PARTITION BY id)) AS e FROM d{r}), q{r} AS (SELECT id, c, e / sum(e) OVER (PARTITION BY id) AS r FROM r{r}),
  s{r + 1} AS (SELECT c, i, sum(r * x[i]) / sum(r) AS mu, greatest(sum(r * x[i] * x[i]) / sum(r) - (sum(r * x[i]) / sum(r)) ** 2, 0) + 1e-6 AS v FROM q{r} JOIN pts USING (id), {AXES} GROUP BY ALL),
  m{r + 1} AS (SELECT c, i, mu, {var} AS v FROM s{r + 1}), w{r + 1} AS (SELECT c, sum(r) / (SELECT count(*) FROM pts) AS w FROM q{r} GROUP BY ALL)"""
    return out


EM_RESULT = " SELECT c AS comp, round(w, 6) AS weight, i - 1 AS axis, round(mu, 6) AS mu, round(v, 6) AS var FROM m2 JOIN w2 USING (c)"


def label_start(pts):
    start = M.cluster_models(pts, "label", "diag")
    return M.Gaussians(start.ids, start.n, start.mu, start.cov + X.FLOOR)


@query(PTS + em_sql(2) + EM_RESULT)
def mixture_steps(spark, sf):
    """Two rounds of diagonal expectation-maximisation from the class models."""
    pts = points(spark, sf)
    return _axis_table(spark, X.gaussian_mixture(pts, 10, "diag", tol=-1e9, max_iter=2, start=label_start(pts)))


def _axis_table(spark, fit):
    rows = fit.models.to_table(spark).select("comp", F.round("weight", 6).alias("weight"), F.posexplode("mu").alias("axis", "mu"), "cov")
    return rows.select("comp", "weight", F.col("axis").cast("bigint").alias("axis"), F.round("mu", 6).alias("mu"), F.round(F.col("cov")[F.col("axis")][F.col("axis")], 6).alias("var"))


def em_plane_sql(rounds: int) -> str:
    out = """WITH t AS (SELECT l_quantity AS q, l_extendedprice / 1000 AS p, count(*) AS n FROM lineitem GROUP BY ALL), z AS (SELECT sum(n)::DOUBLE AS z FROM t),
  g0 AS (SELECT l_linenumber AS c, count(*) / any_value(z) AS w, avg(l_quantity) AS mq, avg(l_extendedprice / 1000) AS mp, var_pop(l_quantity) + 1e-6 AS vq,
    var_pop(l_extendedprice / 1000) + 1e-6 AS vp, covar_pop(l_quantity, l_extendedprice / 1000) AS c2 FROM lineitem, z GROUP BY ALL)"""
    for r in range(rounds):
        out += f""", d{r} AS (SELECT q, p, n, c, ln(w) - 0.5 * (2 * ln(2 * pi()) + ln(vq * vp - c2 * c2) + ((q - mq) ** 2 * vp - 2 * (q - mq) * (p - mp) * c2 + (p - mp) ** 2 * vq) / (vq * vp - c2 * c2)) AS d FROM t, g{r}),
  e{r} AS (SELECT *, exp(d - max(d) OVER (PARTITION BY q, p)) AS e FROM d{r}), r{r} AS (SELECT q, p, n, c, n * e / sum(e) OVER (PARTITION BY q, p) AS r FROM e{r}),
  m{r} AS (SELECT c, sum(r) AS s, sum(r * q) / sum(r) AS mq, sum(r * p) / sum(r) AS mp FROM r{r} GROUP BY ALL),
  g{r + 1} AS (SELECT c, any_value(s) / any_value(z) AS w, any_value(mq) AS mq, any_value(mp) AS mp, sum(r * (q - mq) ** 2) / any_value(s) + 1e-6 AS vq,
    sum(r * (p - mp) ** 2) / any_value(s) + 1e-6 AS vp, sum(r * (q - mq) * (p - mp)) / any_value(s) AS c2 FROM r{r} JOIN m{r} USING (c), z GROUP BY c)"""
    return out


@query(em_plane_sql(2) + " SELECT c AS comp, round(w, 6) AS weight, round(mq, 5) AS mq, round(mp, 5) AS mp, round(vq, 4) AS vq, round(vp, 4) AS vp, round(c2, 4) AS cov FROM g2")
def mixture_steps_full(spark, sf):
    """Two rounds of full-covariance expectation-maximisation from the line-number models."""
    pts = trades(spark, sf).withColumn("id", F.lit(0).cast("bigint"))
    start = M.cluster_models(pts, "label")
    start = M.Gaussians(start.ids, start.n, start.mu, start.cov + X.FLOOR * np.eye(2))
    m = X.gaussian_mixture(pts, len(start), "full", tol=-1e9, max_iter=2, start=start).models
    rows = [
        (int(c), round(float(w), 6), *[round(float(v), 5) for v in mu], round(float(s[0, 0]), 4), round(float(s[1, 1]), 4), round(float(s[0, 1]), 4))
        for c, w, mu, s in zip(m.ids, m.weight, m.mu, m.cov)
    ]
    return spark.createDataFrame(rows, "comp int, weight double, mq double, mp double, vq double, vp double, cov double")


@query(PTS + em_sql(2, spherical=True) + EM_RESULT)
def mixture_steps_spherical(spark, sf):
    """Two rounds with one variance per component."""
    pts = points(spark, sf)
    first = M.cluster_models(pts, "label", "spherical")
    start = M.Gaussians(first.ids, first.n, first.mu, first.cov + X.FLOOR)
    return _axis_table(spark, X.gaussian_mixture(pts, 10, "spherical", tol=-1e9, max_iter=2, start=start))


def _mixture_summary(spark, name, fit):
    rows = [(name, int(c), float(w), float(fit.loglik), len(fit.trace)) for c, w in zip(fit.models.ids, fit.models.weight)]
    return spark.createDataFrame(rows, "method string, comp int, weight double, loglik double, rounds int")


@query()
def mixture_full(spark, sf):
    pts = table(spark, sf, "lineitem").select(V.pack("l_quantity", "l_discount", "l_tax").alias("x"), F.col("l_orderkey").alias("id"))
    return _mixture_summary(spark, "full", X.gaussian_mixture(pts, 4, "full", seed=2, max_iter=8))


@query()
def mixture_spherical(spark, sf):
    return _mixture_summary(spark, "spherical", X.gaussian_mixture(points(spark, sf), 8, "spherical", seed=2, max_iter=8, restarts=2))


@query()
def mixture_dirichlet(spark, sf):
    return _mixture_summary(spark, "dirichlet", X.dirichlet_mixture(points(spark, sf), 12, kind="diag", seed=2, max_iter=10))


@query()
def mixture_factors(spark, sf):
    return _mixture_summary(spark, "factors", X.factor_analysers(points(spark, sf), 6, 2, seed=2, max_iter=6))


@query("""WITH o AS (SELECT c_custkey AS id, c_acctbal AS v, CASE WHEN c_acctbal - lag(c_acctbal) OVER (ORDER BY c_acctbal, c_custkey) <= 12 THEN 0 ELSE 1 END AS cut FROM customer),
  g AS (SELECT id, v, sum(cut) OVER (ORDER BY v, id) AS g FROM o),
  s AS (SELECT g, min(id) AS first, count(*) AS n FROM g GROUP BY ALL), k AS (SELECT g, row_number() OVER (ORDER BY first) AS cluster FROM s WHERE n >= 5)
  SELECT id, coalesce(cluster, (SELECT coalesce(max(cluster), 0) + 1 FROM k))::INTEGER AS cluster FROM g LEFT JOIN k USING (g)""")
def density_clusters(spark, sf):
    """On a line, density clusters are runs without a gap above the radius."""
    return D.dbscan(balances(spark, sf), 12.0, 5)


@query("""WITH RECURSIVE pts AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings),
  e AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON list_distance(a.x, b.x) <= 1.12),
  core AS (SELECT a AS id FROM e GROUP BY a HAVING count(*) >= 2),
  ce AS (SELECT e.a, e.b FROM e JOIN core c ON e.a = c.id JOIN core d ON e.b = d.id),
  r(id, root) AS (SELECT id, id FROM core UNION SELECT ce.b, r.root FROM r JOIN ce ON ce.a = r.id WHERE r.root < ce.b),
  l AS (SELECT id, min(root) AS root FROM r GROUP BY ALL), s AS (SELECT root, count(*) AS n FROM l GROUP BY ALL),
  k AS (SELECT root, row_number() OVER (ORDER BY root) AS cluster FROM s WHERE n >= 2)
  SELECT p.id, coalesce(k.cluster, (SELECT coalesce(max(cluster), 0) + 1 FROM k))::INTEGER AS cluster FROM pts p LEFT JOIN l ON p.id = l.id LEFT JOIN k ON l.root = k.root""")
def density_clusters_core(spark, sf):
    """Core points need a neighbour besides themselves; all other points are noise."""
    return D.dbscan(points(spark, sf), 1.12, min_cluster_size=2, min_neighbors=2)


@query(PTS + """, d AS (SELECT a.id, list_distance(a.x, b.x) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS r FROM pts a, pts b)
  SELECT round(avg(d), 6) AS bandwidth FROM d WHERE r = greatest(1, floor((SELECT count(*) FROM pts) * 0.1))""")
def bandwidth(spark, sf):
    return spark.createDataFrame([(round(D.estimate_bandwidth(points(spark, sf), 0.1), 6),)], "bandwidth double")


@query()
def mean_shift(spark, sf):
    out, _ = D.mean_shift(balances(spark, sf), 900.0, max_rounds=30)
    return out.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("dist2").alias("spread"))


@query()
def spectral_clusters(spark, sf):
    return D.spectral(points(spark, sf), "label", 3, gamma=2.0, rounds=6, tol=1e-3).groupBy("cluster").agg(F.count("*").alias("n"))


@query(PTS + f", a AS ({_assigned(10, 3)}), s AS (SELECT cluster, count(*) AS n FROM a GROUP BY ALL) SELECT round(avg(n), 6) AS n_mean, round(stddev_samp(n), 6) AS n_std FROM s")
def size_statistics(spark, sf):
    sizes = seed_clusters(spark, sf).groupBy("cluster").agg(F.count("*").alias("n"))
    return r6(mean_std(sizes, [], ["n"]), "n_mean", "n_std")
