"""Point-cloud, clustering and experiment-result analytics as Spark jobs."""
