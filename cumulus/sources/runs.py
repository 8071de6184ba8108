"""Run documents: experiment results as JSON, written once per run and read back by method, file and parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cumulus.functions.columns import null_if_nan, run_time

_HEAD = "method string, time bigint, parameters map<string,string>"
DATASET_RUN = _HEAD + ", results array<struct<name:string,RelDom:array<double>,Cells:array<bigint>,Clusters:array<bigint>>>"
KEYED_RUN = _HEAD + """, results struct<
  NMI:array<map<string,double>>, NMI_TEST:array<map<string,double>>, RAND:array<map<string,array<double>>>,
  ASSIGN:array<map<string,array<int>>>, TMDL:array<map<string,array<double>>>, TERR:array<map<string,array<double>>>,
  TCOMP:array<map<string,array<double>>>, TCLUS:array<map<string,array<array<array<int>>>>>,
  DATA:array<array<array<double>>>, EPS:array<double>, COVER:array<int>, ITR:array<int>>"""


def save_runs(runs: DataFrame, path: str, experiment: str) -> None:
    """Append documents under ``experiment=<name>``; earlier runs stay as they are."""
    runs.withColumn("experiment", F.lit(experiment)).write.mode("append").option("ignoreNullFields", "true").partitionBy("experiment").json(path)


def _documents(spark: SparkSession, path: str, schema: str, multi_line: bool) -> DataFrame:
    named = T.StructType.fromDDL(schema).add("experiment", "string")
    docs = spark.read.schema(named).option("multiLine", multi_line).json(path)
    # a saved run goes by its experiment, any other document by its file's own name: folders above never match
    return docs.withColumn("file", F.coalesce("experiment", F.col("_metadata.file_name"))).withColumn("ts", run_time("time"))


def read_dataset_runs(spark: SparkSession, path: str, dataset: str, parameter: str, file_text: str = "", multi_line: bool = False) -> DataFrame:
    """(method, ts, value): one parameter of one data set from the files whose name holds ``file_text``.

    Runs without the data set or the parameter are skipped; NaN in a series becomes NULL.
    """
    docs = _documents(spark, path, DATASET_RUN, multi_line)
    rows = docs.filter(F.col("file").contains(file_text)).select("method", "ts", F.explode("results").alias("r")).filter(F.col("r.name") == dataset)
    value = F.col(f"r.{parameter}")
    if parameter == "RelDom":
        value = F.transform(value, null_if_nan)
    return rows.filter(F.col(f"r.{parameter}").isNotNull()).select("method", "ts", value.alias("value"))


def read_keyed_runs(spark: SparkSession, path: str, method_prefix: str, parameters: list[str], file_pattern: str = ".*", multi_line: bool = False) -> DataFrame:
    """(method, ts, <parameters>): runs whose method starts with the prefix and that hold every parameter."""
    docs = _documents(spark, path, KEYED_RUN, multi_line).filter(F.col("file").rlike(file_pattern) & F.col("method").startswith(method_prefix))
    for p in parameters:
        docs = docs.filter(F.col(f"results.{p}").isNotNull())
    return docs.select("method", "ts", *[F.col(f"results.{p}").alias(p) for p in parameters])


def run_catalogue(spark: SparkSession, path: str, method_prefix: str = "", file_pattern: str = ".*", multi_line: bool = False) -> DataFrame:
    """(method, ts, file, stored): the number of data sets every run keeps."""
    docs = _documents(spark, path, KEYED_RUN, multi_line).filter(F.col("file").rlike(file_pattern) & F.col("method").startswith(method_prefix))
    return docs.select("method", "ts", "file", _size("results.DATA").alias("stored"))


def _size(c: str) -> Column:
    return F.when(F.col(c).isNull(), 0).otherwise(F.size(c))


def run_parameters(spark: SparkSession, path: str, file_pattern: str = "", multi_line: bool = False) -> DataFrame:
    """(method, ts, parameters)."""
    docs = _documents(spark, path, _HEAD, multi_line).filter(F.col("file").rlike(file_pattern or ".*"))
    return docs.select("method", "ts", "parameters")


def stored_clusterings(spark: SparkSession, path: str, payload: DataFrame, dataset: str, multi_line: bool = False) -> DataFrame:
    """(method, id, cluster) of one data set, for methods that have both a document and stored assignments."""
    methods = _documents(spark, path, _HEAD, multi_line).select("method").distinct()
    return payload.filter(F.col("dataset") == dataset).join(methods, "method").select("method", "id", "cluster")


def accumulate(rows: DataFrame) -> DataFrame:
    """Long rows (run, iter, name, key, value) to (run, name, maps): one map per iteration, in iteration order.

    A row without a key is a plain value and is stored under the empty key. One document holds one run, which
    bounds the collected lists.
    """
    entry = F.struct(F.coalesce("key", F.lit("")).alias("key"), "value")
    maps = rows.groupBy("run", "name", "iter").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("m"))
    ordered = maps.groupBy("run", "name").agg(F.sort_array(F.collect_list(F.struct("iter", F.map_entries("m").alias("e")))).alias("s"))
    return ordered.select("run", "name", F.transform("s", lambda r: F.map_from_entries(r["e"])).alias("maps"))
