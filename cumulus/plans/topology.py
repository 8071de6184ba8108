"""Complexes, persistence and merging of clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from cumulus.operators import complexes as T
from cumulus.operators import covers as O
from cumulus.operators import gaussians as M
from cumulus.operators import kmeans as K
from cumulus.operators import merging as H
from cumulus.operators import persistence as P
from cumulus.functions import columns as C
from cumulus.functions import vectors as V
from cumulus.operators.agreement import mutual_information
from cumulus.operators.reshape import union_modes
from cumulus.operators.summary import medians
from cumulus.session import materialise, spread
from cumulus.plans.clouds import DIM, MAHA, PAIRS, PLANE, PTS, _seeded, diag_sql, points, trades
from cumulus.plans.registry import query, table
from cumulus.plans.reports import RUNS, r6, runs

RADIUS = 1.2


def lots(spark, sf):
    """Order lines as points of quantity, price and discount on comparable scales, classed by line number."""
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.array(F.col("l_quantity") / 10, F.col("l_extendedprice") / 10000, F.col("l_discount") * 50).alias("x"),
        F.col("l_linenumber").alias("label"), "l_returnflag",
    )


# --- complexes ----------------------------------------------------------------------------------

VR = PTS + f""", e AS (SELECT a.id AS a, b.id AS b, list_distance(a.x, b.x) AS w FROM pts a JOIN pts b ON a.id < b.id WHERE list_distance(a.x, b.x) <= {RADIUS}),
  t AS (SELECT e.a, e.b, f.b AS c, greatest(e.w, f.w, g.w) AS w FROM e JOIN e f ON e.a = f.a AND e.b < f.b JOIN e g ON g.a = e.b AND g.b = f.b),
  cells AS (SELECT 0 AS dim, [id] AS verts, 0.0::DOUBLE AS w FROM pts UNION ALL SELECT 1, [a, b], w FROM e UNION ALL SELECT 2, [a, b, c], w FROM t)
"""


def rips_cells(spark, sf, dim=2, counted=False):
    return T.expand(*T.rips_graph(points(spark, sf), RADIUS, counted=counted), dim)


def _flat(cells):
    """Vertices as text, so that results compare across engines."""
    return cells.withColumn("verts", F.concat_ws("-", F.col("verts").cast("array<string>"))).withColumn("w", F.round("w", 6))


@query(VR + "SELECT a, b, round(w, 6) AS w FROM e")
def rips_edges(spark, sf):
    return r6(T.rips_graph(points(spark, sf), RADIUS)[1].select("a", "b", "w"), "w")


@query(VR + "SELECT dim, array_to_string(verts, '-') AS verts, round(w, 6) AS w FROM cells WHERE dim = 2")
def triangles(spark, sf):
    return _flat(rips_cells(spark, sf).filter("dim = 2").select("dim", "verts", "w"))


@query(VR + "SELECT dim, array_to_string(verts, '-') AS verts, round(w, 6) AS w, row_number() OVER (ORDER BY cells.w, dim, cells.verts) AS ord FROM cells")
def filtration(spark, sf):
    return _flat(T.filtration(rips_cells(spark, sf)).select("dim", "verts", "w", "ord"))


@query(VR + """, s AS (SELECT w, sum(CASE WHEN dim % 2 = 0 THEN 1 ELSE -1 END) AS d FROM cells GROUP BY ALL)
  SELECT round(w, 6) AS w, (sum(d) OVER (ORDER BY s.w))::BIGINT AS euler FROM s""")
def euler_curve(spark, sf):
    return r6(T.euler_curve(rips_cells(spark, sf, counted=True)).select("w", "euler"), "w")


@query(VR + """, s AS (SELECT w, sum(CASE WHEN dim % 2 = 0 THEN 1 ELSE -1 END) AS d FROM cells GROUP BY ALL)
  SELECT round(w, 6) AS w, (sum(d) OVER (ORDER BY s.w))::BIGINT AS euler FROM s""")
def euler_from_betti(spark, sf):
    """The same curve from the Betti numbers of the persistence pairs: b0 - b1 + b2."""
    cells = materialise(T.filtration(rips_cells(spark, sf)))
    curve = P.betti_curve(cells, P.persistence_pairs(cells, cliques=True), 2)
    return r6(curve.select("w", (F.col("b0") - F.col("b1") + F.col("b2")).cast("bigint").alias("euler")), "w")


def _witness_sql(nu: int) -> str:
    m = "0" if nu == 0 else f"list_sort(list(d) OVER (PARTITION BY id))[{nu}]"
    return PTS + f""", d AS (SELECT p.id, s.c, list_distance(p.x, s.x) AS d FROM pts p, {_seeded(20, 5)} s), n AS (SELECT id, c, d - {m} AS d FROM d)
  SELECT a.c AS a, b.c AS b, round(greatest(min(greatest(a.d, b.d)), 0), 6) AS w FROM n a JOIN n b ON a.id = b.id AND a.c < b.c GROUP BY ALL"""


def _witness(spark, sf, nu):
    pts = points(spark, sf)
    return r6(T.witness_graph(pts, K.random_centers(pts, 20, 5), nu)[1].select("a", "b", "w"), "w")


@query(_witness_sql(0))
def witness_edges(spark, sf):
    return _witness(spark, sf, 0)


@query(_witness_sql(2))
def witness_edges_relaxed(spark, sf):
    return _witness(spark, sf, 2)


def _maxmin_sql(n: int) -> str:
    out = PTS + f", l1 AS {_seeded(1, 4)}, s1 AS (SELECT 1 AS c, x FROM l1)"
    for i in range(2, n + 1):
        out += f""", f{i} AS (SELECT p.id, p.x, min(list_distance(p.x, s.x)) AS d FROM pts p, s{i - 1} s GROUP BY ALL),
  s{i} AS (SELECT * FROM s{i - 1} UNION ALL SELECT * FROM (SELECT {i} AS c, x FROM f{i} ORDER BY d DESC, id LIMIT 1))"""
    return out + f" SELECT c::INTEGER AS landmark, id FROM s{n} JOIN pts USING (x)"


@query(_maxmin_sql(6))
def spread_landmarks(spark, sf):
    pts = points(spark, sf)
    marks = T.spread_landmarks(pts, 6, K.random_centers(pts, 1, 4)[0])
    rows = spark.createDataFrame([(i + 1, m.tolist()) for i, m in enumerate(marks)], "landmark int, x array<double>")
    return rows.join(pts.select("id", "x"), "x").select("landmark", "id")


CLUSTER = PLANE + f""", k AS (SELECT l_returnflag AS run_id, l_quantity AS q, l_extendedprice / 1000 AS p FROM lineitem),
  d AS (SELECT k.run_id, k.q, k.p, g.label AS c, sqrt(min({MAHA})) AS d FROM (SELECT DISTINCT * FROM k) k, g GROUP BY ALL),
  e AS (SELECT a.run_id, a.c AS a, b.c AS b, min(greatest(a.d, b.d)) AS w FROM d a JOIN d b ON a.run_id = b.run_id AND a.q = b.q AND a.p = b.p AND a.c < b.c GROUP BY ALL)
"""


def cluster_edges(spark, sf):
    """One run per return flag that the table holds: its own rows, the same seven line-number models, one scan for all."""
    models = M.cluster_models(trades(spark, sf), "label")
    rows = table(spark, sf, "lineitem").select(F.array(F.col("l_quantity"), F.col("l_extendedprice") / 1000).alias("x"), "l_returnflag")
    return T.cluster_graph(rows, models, key="l_returnflag")


@query(CLUSTER + "SELECT run_id, a, b, round(w, 6) AS w FROM e")
def cluster_complex(spark, sf):
    return r6(cluster_edges(spark, sf)[1], "w").select("run_id", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "w")


REACH = """, o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY w, a, b) AS ord FROM e),
  r(run_id, top, v, u) AS (SELECT v.run_id, o.ord, v.v, v.v FROM o JOIN (SELECT DISTINCT run_id, a AS v FROM e UNION SELECT run_id, b FROM e) v ON o.run_id = v.run_id
    UNION SELECT r.run_id, r.top, r.v, CASE WHEN o.a = r.u THEN o.b ELSE o.a END FROM r JOIN o ON o.run_id = r.run_id AND o.ord <= r.top AND (o.a = r.u OR o.b = r.u)),
  z AS (SELECT run_id, top, v, min(u) AS root FROM r GROUP BY ALL), c AS (SELECT run_id, top AS ord, count(DISTINCT root) AS b0, count(DISTINCT v) AS n FROM z GROUP BY ALL)
"""
CLUSTER_R = CLUSTER.replace("WITH ", "WITH RECURSIVE ", 1)
BETTI = CLUSTER_R + REACH + """, h AS (SELECT run_id, w, b0, ord - n + b0 AS b1 FROM o JOIN c USING (run_id, ord) WHERE (run_id, ord) IN (SELECT (run_id, max(ord)) FROM o GROUP BY run_id, w)
    UNION ALL SELECT run_id, 0.0, n, 0 FROM (SELECT DISTINCT run_id, n FROM c))"""


@query(BETTI + " SELECT run_id, round(w, 6) AS w, b0::INTEGER AS b0, b1::INTEGER AS b1 FROM h")
def betti_curve(spark, sf):
    cells = materialise(T.filtration(T.expand(*cluster_edges(spark, sf), 1)))
    return r6(P.betti_curve(cells, P.persistence_pairs(cells), 1), "w")


@query(BETTI + """, hm AS (SELECT *, (b0 = 2 AND b1 = 0) AS hit, max(w) OVER (PARTITION BY run_id) AS scale FROM h),
  i AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY w) AS isl, lead(w) OVER (PARTITION BY run_id ORDER BY w) AS nxt FROM hm),
  s AS (SELECT run_id, isl, scale, min(w) AS r0, max(coalesce(nxt, scale)) AS r1 FROM i WHERE hit GROUP BY ALL),
  b AS (SELECT run_id, arg_max(r0, r1 - r0) AS r0, arg_max(r1, r1 - r0) AS r1 FROM s GROUP BY ALL)
  SELECT x.run_id, round((r1 - r0) / x.scale, 6) AS dominance, round(r0, 6) AS r0, round(r1, 6) AS r1, round(x.scale, 6) AS scale,
    (SELECT count(*) FROM e WHERE e.run_id = x.run_id AND e.w <= r0) + CASE WHEN r0 IS NULL THEN 0 ELSE 7 END AS cells
  FROM (SELECT DISTINCT run_id, scale FROM hm) x LEFT JOIN b ON b.run_id = x.run_id""")
def dominance(spark, sf):
    """For how long the seven models form two components without a loop."""
    cells = materialise(T.filtration(T.expand(*cluster_edges(spark, sf), 1)))
    targets = cells.select("run_id").distinct().withColumn("betti", F.array(F.lit(2), F.lit(0)))
    return r6(P.dominance(cells, P.persistence_pairs(cells), targets, 1), "dominance", "r0", "r1", "scale")


@query()
def persistence_pairs(spark, sf):
    cells = materialise(T.filtration(rips_cells(spark, sf)))
    return P.persistence_pairs(cells, cliques=True).groupBy("dim").agg(F.count("*").alias("pairs"), F.sum("birth").alias("births"), F.sum("death").alias("deaths"))


# --- merging ------------------------------------------------------------------------------------

MERGES = CLUSTER_R + REACH + """, before AS (SELECT o.run_id, o.ord, o.a, o.b, o.w, x.root AS ra, y.root AS rb FROM o
    LEFT JOIN z x ON x.run_id = o.run_id AND x.top = o.ord - 1 AND x.v = o.a LEFT JOIN z y ON y.run_id = o.run_id AND y.top = o.ord - 1 AND y.v = o.b)
  SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY ord)::INTEGER AS step, least(coalesce(ra, a), coalesce(rb, b))::INTEGER AS a, greatest(coalesce(ra, a), coalesce(rb, b))::INTEGER AS b,
    round(w, 6) AS cost FROM before WHERE coalesce(ra, a) <> coalesce(rb, b)"""


@query(MERGES)
def merge_tree(spark, sf):
    """Topological merging of the line-number models over the rows of every return flag."""
    cells = materialise(T.filtration(T.expand(*cluster_edges(spark, sf), 1)))
    return r6(H.merge_trees(O.Cover(None, cells).edges), "cost")


LEVELS = [[[i] for i in range(1, 11)], PAIRS, [[1, 2, 3, 4], [5, 6], [7, 8, 9, 10]]]
_META = "meta AS (SELECT * FROM (VALUES " + ", ".join(f"({l}, {g + 1}, {c})" for l, lev in enumerate(LEVELS) for g, m in enumerate(lev) for c in m) + ") v(level, cluster, comp))"


@query(PTS + f""", {diag_sql()}, {_META}, n AS (SELECT c AS comp, exp(lw) AS w FROM w), y AS (SELECT level, cluster, sum(w) AS t FROM meta JOIN n USING (comp) GROUP BY ALL),
  b AS (SELECT id, level, cluster, d + ln(w / t) AS s FROM d JOIN meta ON meta.comp = d.c JOIN n ON n.comp = d.c JOIN y USING (level, cluster)),
  e AS (SELECT id, level, cluster, max(s) + ln(sum(exp(s - m))) AS s FROM (SELECT *, max(s) OVER (PARTITION BY id, level, cluster) AS m FROM b) GROUP BY ALL)
  SELECT level, count(DISTINCT cluster)::INTEGER AS clusters, round(-sum(s), 4) AS nll FROM (SELECT level, id, max(s) AS s, 1 AS one FROM e GROUP BY ALL) JOIN (SELECT level, cluster FROM y) USING (level) GROUP BY ALL""".replace(
    "round(-sum(s), 4)", "round(-sum(s) / count(DISTINCT cluster), 4)"))
def level_likelihood(spark, sf):
    """Negative log-likelihood of three given levels over the class models, from one scan."""
    pts = points(spark, sf)
    scores = H.level_scores(pts, M.cluster_models(pts, "label", "diag"), LEVELS)
    return scores.select("level", "clusters", F.round("nll", 4).alias("nll"))


_C = "c1 AS (SELECT 1.0::DOUBLE AS c), c2 AS (SELECT CASE WHEN n <= 1000 THEN (SELECT sum(exp(lgamma(n + 1) - lgamma(h + 1) - lgamma(n - h + 1) " \
    "+ CASE WHEN h > 0 THEN h * ln(h / n) ELSE 0 END + CASE WHEN h < n THEN (n - h) * ln((n - h) / n) ELSE 0 END)) FROM (SELECT unnest(generate_series(0, n::BIGINT)) AS h)) " \
    "ELSE sqrt(n * pi() / 2) + 2 / 3.0::DOUBLE + sqrt(2 * pi() / n) / 24 END AS c FROM t)" + "".join(
        f", c{j} AS (SELECT c{j - 1}.c + n / {j - 2} * c{j - 2}.c AS c FROM c{j - 1}, c{j - 2}, t)" for j in range(3, 11))


@query(PTS + f""", {diag_sql()}, {_META}, n AS (SELECT c AS comp, exp(lw) AS w FROM w), y AS (SELECT level, cluster, sum(w) AS t, count(*) AS m FROM meta JOIN n USING (comp) GROUP BY ALL),
  b AS (SELECT id, level, cluster, d + ln(w / t) AS s FROM d JOIN meta ON meta.comp = d.c JOIN n ON n.comp = d.c JOIN y USING (level, cluster)),
  e AS (SELECT id, level, cluster, max(s) + ln(sum(exp(s - m))) AS s FROM (SELECT *, max(s) OVER (PARTITION BY id, level, cluster) AS m FROM b) GROUP BY ALL),
  a AS (SELECT level, id, arg_max(cluster, s) AS cluster, max(s) AS s FROM e GROUP BY ALL), l AS (SELECT level, -sum(s) AS nll FROM a GROUP BY ALL),
  z AS (SELECT y.level, y.cluster, y.m, greatest(count(a.id), 1) AS n FROM y LEFT JOIN a USING (level, cluster) GROUP BY ALL),
  f AS (SELECT level, count(*)::INTEGER AS clusters, sum(({2 * DIM} * m + m - 1) / 2.0 * ln(n)) AS half FROM z GROUP BY ALL),
  t AS (SELECT count(*)::DOUBLE AS n FROM pts), {_C}, k AS (SELECT 10 AS k, ln(c) AS v FROM c10 UNION ALL SELECT 5, ln(c) FROM c5 UNION ALL SELECT 3, ln(c) FROM c3)
  SELECT level, clusters, round(nll + half + v, 4) AS score, round(nll, 4) AS nll, round(half + v, 4) AS complexity FROM f JOIN l USING (level) JOIN k ON k.k = clusters""")
def level_scores(spark, sf):
    """Total, likelihood and complexity of three given levels."""
    pts = points(spark, sf)
    return r6(H.level_scores(pts, M.cluster_models(pts, "label", "diag"), LEVELS).drop("run_id"), "score", "nll", "complexity", digits=4)


_ASSIGN = f"{diag_sql()}, a AS (SELECT id, arg_max(c, d) AS comp FROM d GROUP BY ALL)"


@query(PTS + f", {_ASSIGN}, {_META} SELECT id, cluster FROM a JOIN meta USING (comp) WHERE level = 2")
def cut_level(spark, sf):
    pts = points(spark, sf)
    assigned = M.assign_models(pts, M.cluster_models(pts, "label", "diag"), keep=["id"])
    return H.cut_level(assigned, H.meta_table(spark, LEVELS), 2)


AGREE = PTS + f""", {_ASSIGN}, {_META}, j AS (SELECT level, label, cluster FROM a JOIN meta USING (comp) JOIN pts USING (id)),
  c AS (SELECT level, label, cluster, count(*) AS n FROM j GROUP BY ALL), f AS (SELECT level, sum(n)::DOUBLE AS n FROM c GROUP BY ALL),
  x AS (SELECT level, sum(n * ln(n)) AS v FROM c GROUP BY ALL), y AS (SELECT level, sum(n * ln(n)) AS v FROM (SELECT level, label, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL),
  z AS (SELECT level, sum(n * ln(n)) AS v FROM (SELECT level, cluster, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL),
  h AS (SELECT level, ln(f.n) - y.v / f.n AS ha, ln(f.n) - z.v / f.n AS hb, ln(f.n) - x.v / f.n AS hab FROM f JOIN x USING (level) JOIN y USING (level) JOIN z USING (level)),
  g AS (SELECT level, ha + hb - hab AS mi, 2 * (ha + hb - hab) / (ha + hb) AS nmi FROM h)
"""


def _agreement(spark, sf):
    pts = points(spark, sf)
    return H.level_agreement(M.assign_models(pts, M.cluster_models(pts, "label", "diag"), keep=["label"]), "label", H.meta_table(spark, LEVELS))


@query(AGREE + "SELECT level, round(mi, 6) AS mi, round(nmi, 6) AS nmi FROM g")
def level_agreement(spark, sf):
    return r6(_agreement(spark, sf).drop("run_id"), "mi", "nmi")


@query(AGREE + "SELECT arg_max(level, nmi) AS level, round(max(nmi), 6) AS nmi FROM g")
def best_level(spark, sf):
    return r6(H.best_level(_agreement(spark, sf)).drop("run_id"), "nmi")


def _choose_sql(flat: str) -> str:
    return RUNS + f""", t AS (SELECT dataset AS run_id, cells AS level, median(score) AS score FROM runs WHERE score IS NOT NULL GROUP BY ALL),
  f AS (SELECT run_id, level, {flat} AS s FROM t),
  d AS (SELECT *, min(s) OVER (PARTITION BY run_id) AS lo, s < lag(s) OVER w AND s < lead(s) OVER w AS dip FROM f WINDOW w AS (PARTITION BY run_id ORDER BY level)),
  g AS (SELECT run_id, max(level) AS level FROM d WHERE s <= lo + 0.001 GROUP BY ALL), l AS (SELECT run_id, arg_max(level, (-s, level)) AS level FROM d WHERE dip GROUP BY ALL)
  SELECT g.run_id, greatest(g.level, coalesce(l.level, g.level)) AS level FROM g LEFT JOIN l USING (run_id)"""


def _score_rows(spark, sf):
    rows = runs(spark, sf).filter("score is not null").select(F.col("dataset").alias("run_id"), F.col("cells").alias("level"), "score")
    return medians(rows, ["run_id", "level"], ["score"], suffix="")


@query(_choose_sql("CASE WHEN level = min(level) OVER (PARTITION BY run_id) OR level = max(level) OVER (PARTITION BY run_id) THEN max(score) OVER (PARTITION BY run_id) ELSE score END"))
def choose_level(spark, sf):
    return H.choose_level(_score_rows(spark, sf))


@query(_choose_sql("floor(score)"))
def choose_level_floored(spark, sf):
    return H.choose_level(_score_rows(spark, sf), floor=True)


def _merges(spark, sf, rule, **opts):
    pts = trades(spark, sf)
    models = M.cluster_models(pts, "label")
    return H.merge_table(spark, H.merges_by(rule, pts, models, None, **opts), rule)


@query()
def description_merges(spark, sf):
    return _merges(spark, sf, "description")


@query()
def bottleneck_merges(spark, sf):
    return _merges(spark, sf, "bottleneck")


@query()
def bottleneck_merges_hard(spark, sf):
    return _merges(spark, sf, "bottleneck", hard=True)


def _flow(spark, sf, rule):
    pts = spread(lots(spark, sf).select("id", "x", "label"))
    out = H.metacluster(pts, O.kmeans_cover(pts, 10, 3, rounds=12), rule, run=rule)
    scores = out["scores"].join(out["agreement"].select("level", "nmi"), "level")
    return scores.select("run_id", "level", "clusters", "score", "nll", "complexity", "nmi", (F.col("level") == out["level"]).alias("chosen"), (F.col("level") == out["best_level"]).alias("best"))


@query()
def metacluster_topological(spark, sf):
    """k-means cover, topological merging: scores and agreement by clusters left, chosen and best level."""
    return _flow(spark, sf, "topological")


@query()
def metacluster_description(spark, sf):
    return _flow(spark, sf, "description")


@query()
def metacluster_bottleneck(spark, sf):
    return _flow(spark, sf, "bottleneck")


@query(RUNS + """, t AS (SELECT method, mode, dataset, cells, max(score) AS score FROM runs WHERE score IS NOT NULL GROUP BY ALL),
  n AS (SELECT *, row_number() OVER (PARTITION BY method, mode, dataset ORDER BY cells) AS i, count(*) OVER (PARTITION BY method, mode, dataset) AS k FROM t)
  SELECT method, mode, dataset, p.i AS level, score FROM n JOIN (SELECT unnest(generate_series(1, 100)) AS i) p ON n.i = p.i OR (n.i = n.k AND p.i > n.k)""")
def score_traces(spark, sf):
    """Padded traces of both modes in long form; a report pivots them only at the end."""
    both = runs(spark, sf).filter("score is not null")
    tagged = union_modes([both.filter(F.col("mode") == m).drop("mode") for m in (0, 1)])
    best = tagged.groupBy("method", "mode", "dataset", "cells").agg(F.max("score").alias("score"))
    rows = best.groupBy("method", "mode", "dataset").agg(F.sort_array(F.collect_list(F.struct("cells", "score"))).alias("s"))
    padded = rows.select("method", "mode", "dataset", C.pad_trace(F.col("s.score"), 100).alias("trace"))
    return padded.select("method", "mode", "dataset", F.posexplode("trace").alias("p", "score")).select(
        "method", "mode", "dataset", (F.col("p") + 1).cast("bigint").alias("level"), "score"
    )


@query()
def likelihood_by_clusters(spark, sf):
    """Likelihood against the number of clusters for covers of several sizes, sorted."""
    pts = spread(lots(spark, sf).select("id", "x"))
    out = None
    for size in (4, 8, 12):
        models = O.construct_models(K.assign_centers(pts, K.kmeans(pts, size, 5, rounds=8)), "cluster")
        row = H.level_scores(pts, models, [[[int(i)] for i in models.ids]], f"kmeans-{size}").select("run_id", "clusters", "nll")
        out = row if out is None else out.unionByName(row)
    return out.orderBy("clusters")
