"""Result analytics: long tables to grouped, tested and pivoted reports.

``events`` stands for stored run results: event_type is the method, the user picks the data set and the
noise level, the JSON property is the number of cells, and runs with k divisible by 10 failed (NULL score).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulus.functions import columns as C
from cumulus.operators import ordering as W
from cumulus.operators import reshape as R
from cumulus.operators import summary as A
from cumulus.operators.spread import CENTRE, FAR_TAIL, NEAR_TAIL, fligner_killeen
from cumulus.plans.registry import query, table

METHODS = ["click", "error", "purchase", "signup", "view"]
CODES = ["seen", "failed", "bought", "joined", "viewed"]


def runs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("run"),
        F.col("event_type").alias("method"),
        F.concat(F.lit("Set-"), F.col("user_id") % 4 + 2, F.lit("-D"), F.col("user_id") % 3 + 2).alias("dataset"),
        ((F.col("user_id") % 3 + 1) / 10).alias("eps"),
        (F.col("event_id") % 2).cast("int").alias("mode"),
        "ts",
        k.alias("cells"),
        F.when(k % 10 != 0, F.col("value")).alias("score"),
    )


RUNS = """WITH runs AS (
  SELECT event_id AS run, event_type AS method,
         'Set-' || (user_id % 4 + 2) || '-D' || (user_id % 3 + 2) AS dataset,
         (user_id % 3 + 1) / 10.0::DOUBLE AS eps, CAST(event_id % 2 AS INTEGER) AS mode, ts,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS cells,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 <> 0 THEN value END AS score
  FROM events)
"""


def r6(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c).cast("double"), digits).alias(c) if c in names else F.col(c) for c in df.columns])


# --- grouped statistics -------------------------------------------------------------------------

@query(RUNS + """SELECT method, dataset, round(median(score), 6) AS score_med, round(mad(score), 6) AS score_mad,
  round(median(cells), 6)::DOUBLE AS cells_med, round(mad(cells), 6)::DOUBLE AS cells_mad FROM runs GROUP BY ALL""")
def median_mad_by_group(spark, sf):
    out = A.median_mad(runs(spark, sf), ["method", "dataset"], ["score", "cells"])
    return r6(out, "score_med", "score_mad", "cells_med", "cells_mad")


@query("""SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 4) AS l_extendedprice_med,
  round(mad(l_extendedprice), 4) AS l_extendedprice_mad FROM lineitem GROUP BY ALL""")
def median_mad_split_by_value(spark, sf):
    """The form for groups too large for one task: values are counted, then ordered by range."""
    out = A.median_mad(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_extendedprice"])
    return r6(out, "l_extendedprice_med", "l_extendedprice_mad", digits=4)


@query(RUNS + """SELECT method, dataset, round(avg(score), 6) AS score_mean, round(stddev_samp(score), 6) AS score_std
  FROM runs GROUP BY ALL""")
def mean_std_by_group(spark, sf):
    return r6(A.mean_std(runs(spark, sf), ["method", "dataset"], ["score"]), "score_mean", "score_std")


@query("""SELECT l_linenumber, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max,
  min(l_extendedprice) AS l_extendedprice_min, max(l_extendedprice) AS l_extendedprice_max FROM lineitem GROUP BY ALL""")
def extrema_by_group(spark, sf):
    return A.extrema(table(spark, sf, "lineitem"), ["l_linenumber"], ["l_quantity", "l_extendedprice"])


@query(RUNS + """, s AS (SELECT method, dataset, count(score) AS successes, count(*) AS total, median(score) AS m,
    mad(score) AS d, median(cells) AS cm, mad(cells) AS cd FROM runs GROUP BY ALL)
  SELECT method, dataset, successes, total, round(100.0 * successes / total, 6)::DOUBLE AS success_pct,
    round(coalesce(m, 0), 6) AS score_med, round(coalesce(d, 0), 6) AS score_mad,
    round(CASE WHEN coalesce(m, 0) = 0 THEN 0 ELSE cm END, 6)::DOUBLE AS cells_med,
    round(CASE WHEN coalesce(m, 0) = 0 THEN 0 ELSE cd END, 6)::DOUBLE AS cells_mad FROM s""")
def success_rate_cells(spark, sf):
    out = A.success_summary(runs(spark, sf), ["method", "dataset"], "score", "cells")
    return r6(out, "success_pct", "score_med", "score_mad", "cells_med", "cells_mad")


@query(RUNS + """, s AS (SELECT method, dataset, median(score) AS m, mad(score) AS d FROM runs GROUP BY ALL)
  SELECT ceil(max(m + d) * 100) / 100 AS ceiling FROM s""")
def axis_ceiling(spark, sf):
    return A.ceiling(A.median_mad(runs(spark, sf), ["method", "dataset"], ["score"]), "score_med", "score_mad", digits=2)


@query(RUNS + "SELECT dataset, max(coalesce(score, 0)) AS top FROM runs GROUP BY ALL")
def group_maximum(spark, sf):
    return runs(spark, sf).groupBy("dataset").agg(F.max(A.fenced_statistic(F.col("score"))).alias("top"))


@query(RUNS + "SELECT method, dataset, count(DISTINCT cells) AS clusters FROM runs GROUP BY ALL")
def distinct_clusters(spark, sf):
    return A.distinct_clusters(runs(spark, sf), ["method", "dataset"], "cells")


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL")
def cluster_sizes(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query(RUNS + """, s AS (SELECT method, dataset, mode, median(score) AS m, mad(score) AS d FROM runs GROUP BY ALL)
  SELECT a.method, a.dataset, round(b.m - a.m, 6) AS median_diff, round(sqrt(a.d * a.d + b.d * b.d), 6) AS error
  FROM s a JOIN s b ON a.method = b.method AND a.dataset = b.dataset AND a.mode = 0 AND b.mode = 1""")
def median_difference_error(spark, sf):
    both = runs(spark, sf)
    tagged = R.union_modes([both.filter(F.col("mode") == m).drop("mode") for m in (0, 1)])
    return r6(A.median_difference(tagged, ["method", "dataset"], "mode", "score", (0, 1)), "median_diff", "error")


@query(RUNS + """, b AS (SELECT method, eps, count(score) AS n, quantile_cont(score, 0.25) AS q1, median(score) AS med,
    quantile_cont(score, 0.75) AS q3 FROM runs GROUP BY ALL)
  SELECT b.method, b.eps, any_value(n) AS n, round(any_value(q1), 6) AS q1, round(any_value(med), 6) AS med,
    round(any_value(q3), 6) AS q3,
    min(score) FILTER (score BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_lo,
    max(score) FILTER (score BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_hi,
    count(score) FILTER (score NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
  FROM b JOIN runs r ON b.method = r.method AND b.eps = r.eps GROUP BY b.method, b.eps""")
def box_summary(spark, sf):
    return r6(A.box_summary(runs(spark, sf), ["method", "eps"], "score"), "q1", "med", "q3")


@query("""SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1,
  round(median(l_extendedprice), 4) AS med, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3 FROM lineitem GROUP BY ALL""")
def quartiles_split_by_value(spark, sf):
    out = A.quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.75])
    return r6(out.select("l_returnflag", "n", *[F.element_at("q", i + 1).alias(c) for i, c in enumerate(("q1", "med", "q3"))]), "q1", "med", "q3", digits=4)


@query("""SELECT l_returnflag, l_linestatus, CASE WHEN l_extendedprice < 0 THEN 0 WHEN l_extendedprice >= 100000 THEN 21
    ELSE CAST(floor(l_extendedprice / 5000.0) AS BIGINT) + 1 END AS bin, count(*) AS n FROM lineitem GROUP BY ALL""")
def histogram_summary(spark, sf):
    return A.histogram(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", 0, 100000, 20)


# --- equal-spread test --------------------------------------------------------------------------

def _horner(cs, r):
    out = repr(cs[-1])
    for c in reversed(cs[:-1]):
        out = f"({out} * {r} + {c!r})"
    return f"CAST({out} AS DOUBLE)"


def _quantile_sql(p):
    q, t = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    ratio = lambda t, r: f"({_horner(t[0], r)} / {_horner(t[1], r)})"
    return (f"CASE WHEN abs{q} <= 0.425 THEN {q} * {ratio(CENTRE, f'(0.180625 - {q} * {q})')} WHEN {t} <= 5 "
            f"THEN sign{q} * {ratio(NEAR_TAIL, f'({t} - 1.6)')} ELSE sign{q} * {ratio(FAR_TAIL, f'({t} - 5)')} END")


SPREAD = RUNS + f""", x AS (SELECT dataset, method, ln(score) AS v FROM runs WHERE score > 0),
  m AS (SELECT dataset, method, median(v) AS c FROM x GROUP BY ALL),
  d AS (SELECT x.dataset, x.method, abs(v - c) AS z FROM x JOIN m ON x.dataset = m.dataset AND x.method = m.method),
  r AS (SELECT dataset, method, rank() OVER (PARTITION BY dataset ORDER BY z) + (count(*) OVER (PARTITION BY dataset, z) - 1) / 2.0 AS r,
          count(*) OVER (PARTITION BY dataset) AS n FROM d),
  p AS (SELECT dataset, method, CAST(0.5 + r / (2.0 * (n + 1)) AS DOUBLE) AS p FROM r),
  a AS (SELECT dataset, method, {_quantile_sql('p')} AS a FROM p),
  t AS (SELECT dataset, count(*) AS n, avg(a) AS am, var_samp(a) AS v2 FROM a GROUP BY ALL),
  g AS (SELECT dataset, method, count(*) AS n, avg(a) AS am FROM a GROUP BY ALL),
  s AS (SELECT g.dataset, sum(g.n * (g.am - t.am) ** 2) / any_value(v2) AS chi2, CAST(count(*) - 1 AS INTEGER) AS df
        FROM g JOIN t ON g.dataset = t.dataset GROUP BY g.dataset)
  SELECT dataset, round(chi2, 6) AS chi2, df, round(exp(-chi2 / 2) * (1 + chi2 / 2), 6) AS p_value,
    exp(-chi2 / 2) * (1 + chi2 / 2) < 0.05 AS reject FROM s"""


@query(SPREAD, name="fligner_killeen")
def fligner_killeen_query(spark, sf):
    """log transform, then the rank test of equal spread over the five methods of each data set"""
    rows = runs(spark, sf).withColumn("x", C.log_positive("score"))
    return r6(fligner_killeen(rows, ["dataset"], "method", "x"), "chi2", "p_value")


# --- filters, names, nulls, traces --------------------------------------------------------------

@query(RUNS + "SELECT run, dataset, score FROM runs WHERE method = 'click' AND eps >= 0.1 AND eps <= 0.25 AND score > 40")
def conjunctive_filter(spark, sf):
    return runs(spark, sf).filter((F.col("method") == "click") & F.col("eps").between(0.1, 0.25) & (F.col("score") > 40)).select("run", "dataset", "score")


@query(RUNS + "SELECT run, round(ln(score), 6) AS log_score FROM runs")
def log_values(spark, sf):
    return r6(runs(spark, sf).select("run", C.log_positive("score").alias("log_score")), "log_score")


@query(RUNS + r"""SELECT method, dataset, regexp_matches(dataset, '^Set-\d+-D3$') AS d3, starts_with(method, 'p') AS p_method,
  ends_with(dataset, '-D2') AS d2, count(*) AS n FROM runs GROUP BY ALL""")
def name_predicates(spark, sf):
    return runs(spark, sf).groupBy(
        "method", "dataset", F.col("dataset").rlike(r"^Set-\d+-D3$").alias("d3"),
        F.col("method").startswith("p").alias("p_method"), F.col("dataset").endswith("-D2").alias("d2"),
    ).agg(F.count("*").alias("n"))


@query(RUNS + """SELECT run, CASE WHEN dataset LIKE '%-D2' THEN substr(dataset, 1, length(dataset) - 3) || '-plane'
  WHEN dataset LIKE '%-D3' THEN substr(dataset, 1, length(dataset) - 3) || '-space' ELSE dataset END AS dataset FROM runs""")
def rename_suffix(spark, sf):
    return runs(spark, sf).select("run", C.rename_suffix("dataset", [("-D2", "-plane"), ("-D3", "-space")]).alias("dataset"))


@query(RUNS + r"""SELECT run, CAST(nullif(regexp_extract(dataset, '(\d+)-D(\d+)$', 1), '') AS INTEGER) AS components,
  CAST(nullif(regexp_extract(dataset, '(\d+)-D(\d+)$', 2), '') AS INTEGER) AS dimension,
  CAST(nullif(regexp_extract(method, '(\d+)-D(\d+)$', 1), '') AS INTEGER) AS no_match FROM runs""")
def parse_run_name(spark, sf):
    c, d = C.run_components("dataset")
    return runs(spark, sf).select("run", c.alias("components"), d.alias("dimension"), C.run_components("method")[0].alias("no_match"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(make_timestamp((1700000000 + l_orderkey) * 1000000) AS VARCHAR) AS t FROM lineitem")
def run_time(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", C.run_time(F.col("l_orderkey") + 1700000000).cast("string").alias("t"))


@query(RUNS + """SELECT run, dataset || ',' || substr(method, 6) AS label, 'N =' || lpad(CAST(cells AS VARCHAR), 2, ' ') AS size_label,
  replace(dataset, 'Set-', '') AS short FROM runs""")
def label_text(spark, sf):
    return runs(spark, sf).select(
        "run", C.described("method", "dataset").alias("label"), C.padded_label("N =", "cells").alias("size_label"),
        F.replace("dataset", F.lit("Set-"), F.lit("")).alias("short"),
    )


@query(RUNS + """SELECT method, count(*) AS all_rows, count(score) AS kept, round(avg(score), 6) AS skip_mean,
  round(avg(coalesce(score, 0)), 6) AS zero_mean FROM runs GROUP BY ALL""")
def null_handling(spark, sf):
    rows = runs(spark, sf).withColumn("score", C.null_if_nan(F.coalesce(F.col("score"), F.lit(float("nan")))))
    kept = rows.dropna(subset=["score"]).groupBy("method").agg(F.count("*").alias("kept"))
    out = rows.groupBy("method").agg(
        F.count("*").alias("all_rows"), F.avg("score").alias("skip_mean"), F.avg(A.fenced_statistic(F.col("score"))).alias("zero_mean")
    ).join(kept, "method").select("method", "all_rows", "kept", "skip_mean", "zero_mean")
    return r6(out, "skip_mean", "zero_mean")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 8, 1) AS ties_to_even FROM lineitem")
def round_digits(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", C.round_half_even(F.col("l_quantity") / 8, 1).alias("ties_to_even")
    )


@query("SELECT vec_id, label + 1 AS label FROM embeddings")
def shift_labels(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", (F.col("label") + 1).alias("label"))


def _series(spark, sf):
    """Per method, data set and batch of a hundred runs, the score and cell series as a stored document holds them."""
    rows = runs(spark, sf).groupBy("method", "dataset", F.floor(F.col("run") / 100)).agg(F.sort_array(F.collect_list(F.struct("run", "score", "cells"))).alias("s"))
    return rows.select("method", "dataset", F.col("s.run").alias("run"), F.col("s.score").alias("score"), F.col("s.cells").alias("cells"))


@query(RUNS + "SELECT method, dataset, run, score, cells FROM runs")
def explode_parallel(spark, sf):
    """Documents hold one array per parameter; the report wants one row per run."""
    return C.explode_parallel(_series(spark, sf), ["run", "score", "cells"])


@query(RUNS + """, s AS (SELECT dataset, eps, method, max(score) AS nmi, max(cells) AS size FROM runs WHERE score IS NOT NULL GROUP BY ALL)
  SELECT dataset, eps, method AS algorithm, nmi, size FROM s""")
def explode_maps(spark, sf):
    s = runs(spark, sf).filter("score is not null").groupBy("dataset", "eps", "method").agg(F.max("score").alias("nmi"), F.max("cells").alias("size"))
    entry = lambda c: F.map_from_entries(F.collect_list(F.struct("method", c))).alias(c)
    maps = s.groupBy("dataset", "eps").agg(entry("nmi"), entry("size"))
    return C.explode_maps(maps, "nmi", ["size"], "algorithm")


TRACES = """, t AS (SELECT method, dataset, cells, max(score) AS score FROM runs WHERE score IS NOT NULL GROUP BY ALL),
  n AS (SELECT *, row_number() OVER (PARTITION BY method, dataset ORDER BY cells) AS i, count(*) OVER (PARTITION BY method, dataset) AS k FROM t)
"""


def _traces(spark, sf):
    """Best score by number of cells: one bounded trace (at most 100 values of k) per method and data set."""
    best = runs(spark, sf).filter("score is not null").groupBy("method", "dataset", "cells").agg(F.max("score").alias("score"))
    rows = best.groupBy("method", "dataset").agg(F.sort_array(F.collect_list(F.struct("cells", "score"))).alias("s"))
    return rows.select("method", "dataset", F.col("s.score").alias("trace"))


@query(RUNS + TRACES + """SELECT method, dataset, p.i AS level, n.score FROM n JOIN (SELECT unnest(generate_series(1, 100)) AS i) p
  ON n.i = p.i OR (n.i = n.k AND p.i > n.k)""")
def pad_trace(spark, sf):
    padded = _traces(spark, sf).withColumn("trace", C.pad_trace("trace", 100))
    return padded.select("method", "dataset", F.posexplode("trace").alias("p", "score")).select("method", "dataset", (F.col("p") + 1).cast("bigint").alias("level"), "score")


@query(RUNS + TRACES + "SELECT method, dataset, CAST(i - 8 AS INTEGER) AS pos, score, CAST(k - 7 - (i - 8) AS INTEGER) AS clusters FROM n WHERE i >= 8")
def trim_trace(spark, sf):
    return C.trim_trace(_traces(spark, sf), "trace", 8)


@query("SELECT p_partkey, p_size, p_size * 4 AS cover_size FROM part")
def cover_size(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_size", (F.col("p_size") * 4).alias("cover_size"))


@query(RUNS + """, m AS (SELECT DISTINCT method FROM runs), c AS (SELECT method, row_number() OVER (ORDER BY method) AS p FROM m)
  SELECT method, ['seen', 'failed', 'bought', 'joined', 'viewed'][p] AS code, count(*) AS n FROM runs JOIN c USING (method) GROUP BY ALL""")
def recode_methods(spark, sf):
    return R.recode(runs(spark, sf), "method", CODES, "code").groupBy("method", "code").agg(F.count("*").alias("n"))


# --- joins and reshaping ------------------------------------------------------------------------

@query(RUNS + """SELECT r.run, r.score, s.cells FROM (SELECT run, score FROM runs WHERE score IS NOT NULL) r
  JOIN (SELECT run, cells FROM runs WHERE cells > 5) s USING (run)""")
def align_parameters(spark, sf):
    """Two parameters of the same runs, matched by key and not by position."""
    base = runs(spark, sf)
    return base.filter("score is not null").select("run", "score").join(base.filter("cells > 5").select("run", "cells"), "run")


@query(RUNS + """, p AS (SELECT dataset, min(eps) AS eps, max(cells) AS m FROM runs GROUP BY ALL)
  SELECT run, method, score, p.eps, p.m FROM runs JOIN p ON runs.dataset = p.dataset""")
def attach_parameters(spark, sf):
    base = runs(spark, sf)
    params = base.groupBy("dataset").agg(F.min("eps").alias("eps"), F.max("cells").alias("m"))
    return base.select("run", "method", "score", "dataset").join(params, "dataset").drop("dataset")


@query(RUNS + """, s AS (SELECT method, eps, median(score) AS v FROM runs GROUP BY ALL),
  c AS (SELECT method, eps, median(cells)::DOUBLE AS v FROM runs GROUP BY ALL),
  l AS (SELECT row_number() OVER (ORDER BY eps, method) AS row_id, * FROM s), r AS (SELECT row_number() OVER (ORDER BY eps, method) AS row_id, * FROM c)
  SELECT l.row_id, l.method, l.eps, round(l.v, 6) AS v, r.method AS method_1, r.eps AS eps_1, round(r.v, 6) AS v_1
  FROM l JOIN r ON l.row_id = r.row_id""")
def row_number_join(spark, sf):
    base = runs(spark, sf)
    part = lambda c: A.medians(base, ["method", "eps"], [c]).withColumnRenamed(f"{c}_med", "v")
    return r6(R.join_by_row_number(part("score"), part("cells"), ["eps", "method"]), "v", "v_1")


@query(RUNS + """, g AS (SELECT m.method, e.eps, d.d FROM (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS method) m,
    (SELECT unnest([0.1, 0.2, 0.3])::DOUBLE AS eps) e, (SELECT unnest([0, 1])::INTEGER AS d) d)
  SELECT g.method, g.eps, g.d, count(score) AS runs FROM g LEFT JOIN runs r ON g.method = r.method AND abs(g.eps - r.eps) < 1e-9 AND g.d = r.mode GROUP BY ALL""")
def parameter_grid(spark, sf):
    """Every parameter combination with its number of finished runs, 0 where a restart has to begin."""
    grid = R.parameter_grid(spark, method=METHODS, eps=[0.1, 0.2, 0.3], d=[0, 1])
    done = runs(spark, sf).groupBy("method", F.round("eps", 1).alias("eps"), F.col("mode").alias("d")).agg(F.count("score").alias("runs"))
    return grid.join(done, ["method", "eps", "d"], "left").withColumn("runs", F.coalesce("runs", F.lit(0)))


@query("""SELECT c.cell_id, c.lat, c.lon, CASE WHEN c_acctbal > 0 THEN c_nationkey::DOUBLE ELSE -1e30 END AS cluster
  FROM (SELECT c_custkey AS cell_id, (c_custkey // 360)::DOUBLE AS lat, (c_custkey % 360)::DOUBLE AS lon, c_acctbal, c_nationkey FROM customer) c""")
def grid_scatter(spark, sf):
    """Customers as grid cells; cells with a positive balance are observed, the nation is their cluster."""
    c = table(spark, sf, "customer")
    grid = c.select(F.col("c_custkey").alias("cell_id"), F.floor(F.col("c_custkey") / 360).cast("double").alias("lat"), (F.col("c_custkey") % 360).cast("double").alias("lon"))
    mask = c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("cell_id"), (F.col("c_custkey") + 1).alias("id"))
    values = c.select((F.col("c_custkey") + 1).alias("id"), F.col("c_nationkey").alias("cluster"))
    return R.scatter_on_grid(grid, mask, values, "cluster")


@query("""WITH s AS (SELECT c_nationkey AS cluster, count(*) AS size FROM customer GROUP BY ALL)
  SELECT cluster, size, CAST(row_number() OVER (ORDER BY size DESC, cluster) AS INTEGER) AS rank FROM s""")
def size_ranks(spark, sf):
    return W.rank_clusters_by_size(table(spark, sf, "customer").select(F.col("c_nationkey").alias("cluster")), "cluster")


@query("""WITH s AS (SELECT c_nationkey AS cluster, count(*) AS size FROM customer GROUP BY ALL),
  o AS (SELECT cluster AS other, row_number() OVER (ORDER BY size DESC, cluster) AS i FROM s), n AS (SELECT *, row_number() OVER (ORDER BY cluster) AS i FROM s)
  SELECT cluster, size, other AS rank FROM n JOIN o USING (i)""")
def size_permutation(spark, sf):
    return W.rank_clusters_by_size(table(spark, sf, "customer").select(F.col("c_nationkey").alias("cluster")), "cluster", quirk=True)


@query(RUNS + """SELECT DISTINCT method FROM runs WHERE method NOT IN (SELECT method FROM runs WHERE score > 350)""")
def name_difference(spark, sf):
    base = runs(spark, sf)
    return R.names_missing(base, base.filter("score > 350"), "method")


_PIV = ", ".join(f"max(m) FILTER (method = '{m}') AS {m}" for m in METHODS)


@query(RUNS + f", s AS (SELECT dataset, eps, method, round(median(score), 6) AS m FROM runs GROUP BY ALL) SELECT dataset, eps, {_PIV} FROM s GROUP BY ALL")
def pivot_median(spark, sf):
    stats = r6(A.medians(runs(spark, sf), ["dataset", "eps", "method"], ["score"]), "score_med")
    return R.pivot(stats, ["dataset", "eps"], "method", "score_med", METHODS)


@query(RUNS + """, s AS (SELECT dataset, method, median(score) AS m FROM runs GROUP BY ALL)
  SELECT dataset, method, round(m, 6) AS score_med, coalesce(m, 0) = max(coalesce(m, 0)) OVER (PARTITION BY dataset) AS is_max FROM s""")
def mark_row_max(spark, sf):
    return r6(W.mark_maxima(A.medians(runs(spark, sf), ["dataset", "method"], ["score"]), ["dataset"], "score_med"), "score_med")


@query(RUNS + ", s AS (SELECT method, count(*)::DOUBLE AS n, round(avg(score), 6) AS mean FROM runs GROUP BY ALL), "
  "u AS (SELECT 'n' AS \"desc\", method, n AS m FROM s UNION ALL SELECT 'mean', method, mean FROM s) "
  f"SELECT \"desc\", {_PIV} FROM u GROUP BY ALL")
def unpivot_pivot(spark, sf):
    s = runs(spark, sf).groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))
    return R.transpose_summary(s, "method", ["n", "mean"], METHODS)


@query(RUNS + ", s AS (SELECT dataset, method, count(*) AS m FROM runs GROUP BY ALL) "
  f"SELECT dataset AS d, {_PIV} FROM s GROUP BY ALL")
def rename_and_move(spark, sf):
    wide = R.pivot(runs(spark, sf).groupBy("dataset", "method").agg(F.count("*").alias("n")), ["dataset"], "method", "n", METHODS)
    return R.move_column(wide.withColumnRenamed("dataset", "d"), "view", 1)


@query(RUNS + "SELECT DISTINCT dataset, eps FROM runs")
def distinct_values(spark, sf):
    return runs(spark, sf).select("dataset", "eps").distinct()


@query(RUNS + """, s AS (SELECT method, dataset, avg(score) AS cost FROM runs GROUP BY ALL)
  SELECT method, min_by(dataset, cost) AS dataset, round(min(cost), 6) AS cost FROM s GROUP BY method""")
def best_run(spark, sf):
    s = runs(spark, sf).groupBy("method", "dataset").agg(F.avg("score").alias("cost"))
    return r6(W.best_run(s, ["method"], "cost", tie="dataset"), "cost")


@query(RUNS + """, n AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY ts, run) AS p FROM runs)
  SELECT run, method, dataset FROM n WHERE (method, p) IN (('click', 1), ('error', 10), ('purchase', 25), ('view', 50))""")
def representative_rows(spark, sf):
    base = runs(spark, sf).select("method", "ts", "run", "dataset")
    return W.rows_at(base, ["method"], ["ts", "run"], {"click": 1, "error": 10, "purchase": 25, "view": 50}).select("run", "method", "dataset")


@query(RUNS + "SELECT method, run, row_number() OVER (PARTITION BY method ORDER BY ts, run) AS n FROM runs")
def row_numbers_split_by_range(spark, sf):
    """The form for groups too large for one task: ranges are numbered side by side."""
    return W.number_rows(runs(spark, sf).select("method", "ts", "run"), ["method"], ["ts", "run"], "n").drop("ts")


@query(RUNS + "SELECT dataset, method, round(median(score), 6) AS score_med FROM runs GROUP BY ALL ORDER BY dataset, score_med DESC, method")
def sorted_report(spark, sf):
    return r6(A.medians(runs(spark, sf), ["dataset", "method"], ["score"]), "score_med").orderBy("dataset", F.desc("score_med"), "method")


@query("""WITH d AS (SELECT label, count(*) AS n FROM embeddings GROUP BY ALL),
  i AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
  g AS (SELECT label, n, unnest(generate_series(1, 60)) AS k FROM d),
  u AS (SELECT label, k, floor(CAST(('0x' || substr(md5('7:' || label || ':' || k), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE * n)::BIGINT + 1 AS i FROM g)
  SELECT row_number() OVER (ORDER BY md5('8:' || label || ':' || k)) AS draw_no, vec_id, label + 1 AS label FROM u JOIN i USING (label, i)""")
def stratified_sample(spark, sf):
    """Sixty draws with replacement from each class, shuffled."""
    return W.stratified_sample(table(spark, sf, "embeddings").select("vec_id", "label"), "label", 60, 7, id="vec_id", offset=1).select("draw_no", "vec_id", "label")
