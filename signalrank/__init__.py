"""signalrank: entity resolution, scoring and ranking of scholarly feeds as Spark DataFrame jobs."""
