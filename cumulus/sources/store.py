"""Fitted models as Parquet tables: models, assignments, meta-clusters, merges and scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulus.operators.gaussians import Gaussians

TABLES = ("models", "assignments", "meta", "merges", "scores")


@dataclass
class StoredClustering:
    models: DataFrame
    assignments: DataFrame
    meta: DataFrame
    merges: DataFrame
    scores: DataFrame

    def gaussians(self) -> Gaussians:
        return Gaussians.from_table(self.models)


def save_clustering(path: str, run: str, **tables: DataFrame) -> None:
    """Write the given tables of one run, partitioned by run; saving a run again replaces only its own part."""
    for name, table in tables.items():
        if name not in TABLES:
            raise ValueError(f"unknown table {name}")
        rows = table.withColumn("run_id", F.lit(run))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/{name}")


def load_clustering(spark: SparkSession, path: str, run: str) -> StoredClustering:
    return StoredClustering(*[spark.read.parquet(f"{path}/{t}").filter(F.col("run_id") == run) for t in TABLES])
