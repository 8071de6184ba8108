"""Round trips through the sources and sinks, on documents and tables Spark derives from the given ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from cumulus.functions.columns import explode_maps, explode_parallel, run_components
from cumulus.operators import gaussians as M
from cumulus.operators import merging as H
from cumulus.operators.reshape import scatter_on_grid
from cumulus.operators.summary import cache_table, median_mad
from cumulus.plans.clouds import PTS, _assigned, diag_sql, points, seed_clusters
from cumulus.plans.registry import query, table
from cumulus.plans.reports import RUNS, r6, runs
from cumulus.plans.topology import LEVELS
from cumulus.session import materialise, scratch_path
from cumulus.sources import points as SP
from cumulus.sources import runs as SR
from cumulus.sources import store as SS


@query("""SELECT l_linenumber + 1 AS label, count(*) AS n, round(avg(l_quantity), 6) AS quantity, round(avg(floor(l_extendedprice)), 4) AS price FROM lineitem GROUP BY ALL""")
def delimited_points(spark, sf):
    """Order lines written as space-padded text and read back as points."""
    path = scratch_path(spark, "text")
    pad = lambda c: F.lpad(F.floor(c).cast("string"), 8, " ")
    table(spark, sf, "lineitem").select(
        F.concat_ws(",", pad("l_quantity"), pad("l_extendedprice"), F.lpad(F.col("l_linenumber").cast("string"), 2, " "))
    ).write.text(path)
    pts = SP.read_delimited_points(spark, path, 2)
    return pts.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.col("x")[0]), 6).alias("quantity"), F.round(F.avg(F.col("x")[1]), 4).alias("price"))


@query(PTS + "SELECT id, label, round(list_sum(x), 6) AS total FROM pts WHERE split = 'train'")
def split_vectors(spark, sf):
    path = scratch_path(spark, "vectors")
    SP.write_vectors(points(spark, sf), path)
    rows = SP.read_vectors(spark, path, "train")
    return rows.select("id", "label", F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


@query("""SELECT c_custkey AS cell_id, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE -1e30 END AS balance FROM customer""")
def masked_matrix(spark, sf):
    base = scratch_path(spark, "matrix")
    c = table(spark, sf, "customer")
    c.filter("c_acctbal > 0").select((F.col("c_custkey") + 1).alias("id"), F.array("c_acctbal").alias("x")).write.parquet(f"{base}/points")
    c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("cell_id"), (F.col("c_custkey") + 1).alias("id")).write.parquet(f"{base}/mask")
    pts, mask = SP.read_masked_matrix(spark, f"{base}/points", f"{base}/mask")
    return scatter_on_grid(c.select(F.col("c_custkey").alias("cell_id")), mask, pts.select("id", F.col("x")[0].alias("balance")), "balance")


def dataset_documents(spark, sf) -> str:
    """One document per method and batch of a hundred runs; every data set in it holds its score and cell
    series. Failed runs are NaN, as a job would write them."""
    path = scratch_path(spark, "documents")
    series = runs(spark, sf).withColumn("batch", F.floor(F.col("run") / 100)).groupBy("method", "batch", "dataset").agg(
        F.sort_array(F.collect_list(F.struct("run", F.coalesce("score", F.lit(float("nan"))).alias("score"), "cells"))).alias("s")
    )
    entry = F.struct(
        F.col("dataset").alias("name"), F.transform("s", lambda r: r["score"]).alias("RelDom"), F.transform("s", lambda r: r["cells"].cast("bigint")).alias("Cells")
    )
    docs = series.groupBy("method", "batch").agg(F.collect_list(entry).alias("results")).select(
        "method", (F.lit(1700000000) + F.col("batch")).cast("bigint").alias("time"),
        F.create_map(F.lit("k"), F.length("method").cast("string")).alias("parameters"), "results",
    )
    SR.save_runs(docs, path, "complex-compare")
    return path


@query(RUNS + """SELECT method, CAST(make_timestamp((1700000000 + run // 100) * 1000000) AS VARCHAR) AS ts, score, cells::BIGINT AS cells FROM runs WHERE dataset = 'Set-2-D2'""")
def dataset_runs(spark, sf):
    """Two parameters of one data set, read from the documents and aligned by run key."""
    path = dataset_documents(spark, sf)
    read = lambda p: SR.read_dataset_runs(spark, path, "Set-2-D2", p, "compare")
    both = read("RelDom").withColumnRenamed("value", "score").join(read("Cells").withColumnRenamed("value", "cells"), ["method", "ts"])
    return explode_parallel(both, ["score", "cells"]).withColumn("ts", F.col("ts").cast("string"))


@query(RUNS + """SELECT DISTINCT method, CAST(make_timestamp((1700000000 + run // 100) * 1000000) AS VARCHAR) AS ts, length(method)::VARCHAR AS k FROM runs""")
def run_parameters(spark, sf):
    return SR.run_parameters(spark, dataset_documents(spark, sf), "complex-.*").select("method", F.col("ts").cast("string").alias("ts"), F.col("parameters")["k"].alias("k"))


def keyed_documents(spark, sf) -> str:
    """One document per data set: agreement per method and iteration, gathered from long rows. Data sets of dimension 4 store no score."""
    path = scratch_path(spark, "keyed")
    best = runs(spark, sf).filter("score is not null").groupBy("dataset", "eps", "mode", "method").agg(F.max("score").alias("value"), F.max("cells").alias("cells"))
    rows = best.select(F.col("dataset").alias("run"), F.col("mode").alias("iter"), F.lit("NMI").alias("name"), F.col("method").alias("key"), "value")
    maps = SR.accumulate(rows).filter("name = 'NMI'").select("run", F.col("maps").alias("NMI"))
    stored = best.filter("mode = 0").groupBy(F.col("dataset").alias("run")).agg(F.array_sort(F.collect_set(F.array(F.array("value")))).alias("DATA"))
    docs = maps.join(stored, "run").select(
        F.concat(F.lit("Moons"), F.regexp_replace("run", "^Set-", "")).alias("method"), F.lit(1700000000).cast("bigint").alias("time"),
        F.create_map(F.lit("c"), F.lit("2")).alias("parameters"),
        F.struct(F.when(~F.col("run").endswith("-D4"), F.col("NMI")).alias("NMI"), "DATA", F.array(F.lit(0), F.lit(1)).alias("ITR")).alias("results"),
    )
    SR.save_runs(docs, path, "merge-perturb")
    return path


@query(RUNS + """, b AS (SELECT dataset, mode, method, max(score) AS nmi FROM runs WHERE score IS NOT NULL GROUP BY ALL)
  SELECT 'Moons' || replace(dataset, 'Set-', '') AS run, regexp_extract(dataset, '(\\d+)-D(\\d+)$', 1)::INTEGER AS components, mode AS itr, method AS algorithm, nmi
  FROM b WHERE dataset NOT LIKE '%-D4'""")
def keyed_runs(spark, sf):
    """Documents to one row per run, iteration and algorithm; runs that lack the parameter are skipped."""
    docs = SR.read_keyed_runs(spark, keyed_documents(spark, sf), "Moons", ["NMI", "ITR"], r"merge-\w+")
    rows = explode_parallel(docs.withColumnRenamed("method", "run").drop("ts"), ["NMI", "ITR"])
    return explode_maps(rows, "NMI", [], "algorithm").select("run", run_components("run")[0].alias("components"), F.col("ITR").alias("itr"), "algorithm", F.col("NMI").alias("nmi"))


@query(RUNS + """, b AS (SELECT dataset, method, max(score) AS v FROM runs WHERE score IS NOT NULL AND mode = 0 GROUP BY ALL)
  SELECT 'Moons' || replace(dataset, 'Set-', '') AS method, count(DISTINCT v)::INTEGER AS stored FROM b GROUP BY ALL""")
def run_catalogue(spark, sf):
    return SR.run_catalogue(spark, keyed_documents(spark, sf), "Moons").select("method", "stored")


@query(PTS + f", a AS ({_assigned(10, 3)}) SELECT 'click' AS method, id, cluster::INTEGER AS cluster FROM a")
def stored_clusterings(spark, sf):
    """Assignments of a method with a document are found, those of a method without one are not."""
    a = seed_clusters(spark, sf).select("id", "cluster")
    payload = a.select(F.lit("click").alias("method"), F.lit("Set").alias("dataset"), "id", "cluster").unionByName(
        a.select(F.lit("absent").alias("method"), F.lit("Set").alias("dataset"), "id", "cluster")
    )
    return SR.stored_clusterings(spark, dataset_documents(spark, sf), materialise(payload, "payload"), "Set")


@query(PTS + f", {diag_sql()}, a AS (SELECT id, arg_max(c, d) AS comp FROM d GROUP BY ALL) SELECT id, (comp + 1) // 2 AS cluster FROM a")
def model_store(spark, sf):
    """Models, assignments and the tree are saved, loaded and cut again without refitting."""
    pts = points(spark, sf)
    models = M.cluster_models(pts, "label", "diag")
    merges = [(2 * i + 1, 2 * i + 2, float(i)) for i in range(5)]
    path = scratch_path(spark, "store")
    SS.save_clustering(
        path, "pairs", models=models.to_table(spark), assignments=M.assign_models(pts, models).select("id", "comp"),
        meta=H.meta_table(spark, H.levels_of(models.ids.tolist(), merges)), merges=H.merge_table(spark, merges),
        scores=H.level_scores(pts, models, LEVELS[:2]),
    )
    back = SS.load_clustering(spark, path, "pairs")
    assigned = M.assign_models(pts, back.gaussians())
    return H.cut_level(assigned, back.meta, 5)


@query(RUNS + "SELECT method, round(median(score), 6) AS score_med, round(mad(score), 6) AS score_mad FROM runs GROUP BY ALL")
def result_table(spark, sf):
    """A long result table is written once, and the report reads the written copy."""
    stored = cache_table(runs(spark, sf).select("method", "dataset", "score"))
    return r6(median_mad(stored, ["method"], ["score"]), "score_med", "score_mad")
